"""Fixture tests of the library's own operators."""

from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators import chunks as C
from archivolt.operators import graph as K
from archivolt.operators import search as R
from archivolt.operators import tables as G


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_fixes_run_again_until_done(spark):
    fixes = [("金小江", "金沙江"), ("巧度金沙江", "巧渡金沙江")]
    assert one(spark, lambda c: X.apply_fixes(c, fixes), "巧度金小江边") == "巧渡金沙江边"
    assert one(spark, lambda c: X.apply_fixes(c, fixes), "") == ""


def test_clean_joins_han_and_drops_page_numbers(spark):
    assert one(spark, X.clean_ocr_text, "  红 军\n\n\n\nab\n12\ncd ") == "红军\n\nab\ncd"


def test_normal_forms(spark):
    assert one(spark, X.normalize, "ＡＢＣ１２３") == "ABC123"
    assert one(spark, X.normalize_name, " 会泽县 ") == "会泽"
    assert [one(spark, X.parse_page, p) for p in ("23", "23-30", "-", "无", None)] == [23, 23, None, None, None]


def test_line_chunks_carry_short_blocks_over_and_keep_pages():
    text = "[PAGE:1]\nshort\n\n" + "a" * 120 + "\n[PAGE:2]\n\n" + "b" * 50
    got = C.merge_lines(text)
    assert got == [("short" + "a" * 120 + "b" * 50, 9, 1)]
    assert C.merge_lines("tiny") == []


def test_char_terms_follow_the_padding_rule(spark):
    got = one(spark, lambda c: R.char_terms(c, 2, 4), "a bcd")
    assert got == [" a", "a ", " a ", " b", "bc", "cd", "d ", " bc", "bcd", "cd ", " bcd", "bcd "]


def test_resolution_follows_the_first_owner(spark):
    rows = [(0, True, "a", ["a", "b"]), (1, False, "c", ["c", "b"]), (2, False, "b", ["b", "d"]), (3, False, "d", ["d"]), (4, False, "", [""])]
    df = spark.createDataFrame(rows, "ord long, is_base boolean, name_key string, keys array<string>")
    assert dict(K.resolve(df, lambda x: x.cache()).collect()) == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4}


def test_levels_and_weather(spark):
    assert [one(spark, G.level, r, "double") for r in (0.1, 0.4, 0.75, 0.95)] == ["comfortable", "moderate", "crowded", "alert"]
    pairs = [("rain", "20", 0.75), ("clear", "35", 0.8), ("clear", "-3", 0.85), ("cloudy", "24", 0.9), ("clear", "24", 1.0), (None, None, 1.0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "t string, d string")
    assert [r[0] for r in df.select(G.weather_factor(F.col("t"), F.col("d"))).collect()] == [p[2] for p in pairs]


def test_as_of_is_strictly_younger_than_the_tolerance(spark):
    left = spark.sql("SELECT 1 AS k, timestamp'2026-01-01 10:15:00' AS ts UNION ALL SELECT 1, timestamp'2026-01-01 10:14:59'")
    right = spark.sql("SELECT 1 AS k, timestamp'2026-01-01 10:00:00' AS ts, 'x' AS v")
    got = {r.ts.minute: r.v for r in G.as_of(left, right, "k", "ts", "v", 900).collect()}
    assert got == {15: None, 14: "x"}


def test_streamed_load_equals_the_batch(spark, tmp_path):
    from archivolt.streaming.load import hourly_load

    rows = [(f"2026-01-01 {h:02d}:{m:02d}:00", "a" if m % 2 else "b") for h in range(5) for m in range(0, 60, 7)] + [("2026-01-02 12:00:00", "a")]
    ev = spark.createDataFrame(rows, "t string, site string").select(F.to_timestamp("t").alias("ts"), "site")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    cap = spark.createDataFrame([("a", 5), ("b", 8)], "site string, capacity long")
    q = hourly_load(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), cap).writeStream.format("memory").queryName("load_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in G.hourly_load(ev, cap).collect() if r.hour.day == 1}
    assert {tuple(r) for r in spark.table("load_out").select("site", "hour", "visitors", "ratio", "level").collect()} == batch
