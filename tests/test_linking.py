"""Fixture tests of repairs, anchors, links by similarity and streams, against brute force where one is at hand."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from archivolt.functions import repair as P
from archivolt.functions import text as X
from archivolt.operators import chunks as C
from archivolt.operators import graph as K
from archivolt.operators import pairs as L
from archivolt.operators import tables as G
from archivolt.sources import tables as S


def test_near_misses_are_mended_longest_first_and_real_names_stay():
    near = P.NearTerms(["皎平渡", "金沙江边", "寻甸"])
    assert near.mended("过较平渡到金砂江边") == "过皎平渡到金沙江边"
    assert near.mended("皎平县寻店") == "皎平县寻店"
    assert near.mended("") == ""


def test_answers_are_read_in_spite_of_fences_and_noise(spark):
    said = ['{"entities": [1]}', '```json\n{"entities": [2]}\n```', 'x {"a": 1} {"entities": [3]} y', "{bad", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = dict(df.select("i", P.read_json(F.col("s"), "struct<entities: array<int>>")["entities"][0]).collect())
    assert got == {0: 1, 1: 2, 2: 3, 3: None, 4: None, 5: None}


def test_at_most_two_words_are_misspelt(spark):
    df = spark.createDataFrame([("ab cd ef", ["ab", "zz", "cd", "ef"]), (None, ["ab"]), ("ab", None)], "s string, w array<string>")
    got = [r[0] for r in df.select(P.with_typos(F.col("s"), F.col("w"), {"a": "x", "c": "y", "e": "z"})).collect()]
    assert got == ["xb yd ef", None, "ab"]


def test_titles_are_anchored_behind_the_contents():
    text = "甲章1乙章2丙章3" + "前" * 20 + "甲章" + "文" * 30 + "乙章" + "文" * 30 + "丙章" + "文" * 30
    got = C.anchor_segments(text, [("甲章", 1), ("乙章", 2), ("丁章", 9), ("丙章", 3)])
    assert [g[1] for g in got][-1] == "丙章" and got[-1][4] == len(text)
    assert C.anchor_segments("无", [("甲", 1)]) == []


def test_similar_names_lose_no_pair(spark):
    a, b = ["abcdef", "abcxef", "zzz", "a", "", "fedcba"], ["abcdef", "abcdeg", "zzzy", "b", "ba", "abdcfe"]
    got = {(r.a, r.b) for r in L.similar(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), 0.55).collect()}
    assert got == {(x, y) for x in a for y in b if x and SequenceMatcher(None, x, y).ratio() >= 0.55}


def test_timeline_finds_labels_starts_and_blank_descriptions(spark):
    docs = spark.createDataFrame([(1, "the long crossing of the river"), (2, "nothing"), (3, None)], "doc_id long, text string")
    events = spark.createDataFrame([(1, "crossing", "x y z", "ford"), (2, "", None, None), (3, "absent", "the long crossing and more", "pass")], "eid long, label string, description string, place string")
    met, placed = K.timeline_mentions(docs, events)
    assert {tuple(r) for r in met.collect()} == {(1, 1), (1, 2), (2, 2), (1, 3)}
    assert {tuple(r) for r in placed.collect()} == {(1, 1, "ford"), (1, 3, "pass")}


def test_streamed_memory_equals_the_log(spark, tmp_path):
    from archivolt.streaming.memory import memory_stream

    turns = spark.createDataFrame([(c, t, "user", f"{c}-{t}") for c in (1, 2) for t in range(9 + 11 * c)], "conv_id long, turn long, role string, text string")
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = memory_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("memory_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.conv_id, r.batch, r.turn) for r in G.memory_batches(turns).where("batch IS NOT NULL").collect()}
    assert {(r.conv_id, r.batch, t) for r in spark.table("memory_out").collect() for t in r.turns} == want


def test_idle_conversations_leave_the_state(spark, tmp_path):
    from archivolt.streaming.memory import memory_stream

    def feed(name, rows):  # (conversation, turn, second)
        df = spark.createDataFrame([(c, t, "user", f"{c}-{t}", s) for c, t, s in rows], "conv_id long, turn long, role string, text string, s long")
        df.withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    feed("a", [(1, t, 1000 + t) for t in range(7)] + [(2, t, 1000 + t) for t in range(7)])
    schema = "conv_id long, turn long, role string, text string, at timestamp"
    stream = memory_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle="100 seconds", at="at")
    q = stream.writeStream.format("memory").queryName("idle_out").outputMode("append").start()
    held = lambda: q.lastProgress["stateOperators"][0]["numRowsTotal"]
    try:
        q.processAllAvailable()
        both = held()
        feed("b", [(2, t, 1050 + t) for t in range(7, 16)])  # the second conversation goes on, the first is idle
        q.processAllAvailable()
        feed("c", [(2, t, 1130 + t) for t in range(16, 21)])  # now the first is idle for more than 100 s
        q.processAllAvailable()
        feed("d", [(1, t, 1160 + t) for t in range(7, 10)] + [(2, 21, 1161)])  # and begins anew: no batch of ten turns
        q.processAllAvailable()
        assert both > 0
    finally:
        q.stop()
    got = {(r.conv_id, r.batch): r.turns for r in spark.table("idle_out").collect()}
    log = spark.createDataFrame([(2, t, "user", f"2-{t}") for t in range(22)], "conv_id long, turn long, role string, text string")
    want = {}
    for r in G.memory_batches(log).where("batch IS NOT NULL").orderBy("turn").collect():
        want.setdefault((r.conv_id, r.batch), []).append(r.turn)
    assert got == want and all(c == 2 for c, _ in got)


def test_only_new_files_are_ingested(spark, tmp_path):
    from archivolt.streaming.memory import ingest

    (tmp_path / "in").mkdir()
    at = [str(tmp_path / x) for x in ("in", "out", "checkpoint")]
    for n, name in enumerate("ab", 1):
        (tmp_path / "in" / f"{name}.txt").write_text("river " * 40)
        assert {r[0] for r in ingest(spark, *at, X.strip, ("river",)).select("source").collect()} == {f"{x}.txt" for x in "ab"[:n]}
    assert ingest(spark, *at, X.strip, ("river",)).count() == 2


def test_turns_and_graphs_come_back(spark, tmp_path):
    turns = spark.createDataFrame([(c, t) for c in range(5) for t in range(3)], "conv_id long, turn long")
    S.save_turns(turns, str(tmp_path / "turns"))
    assert S.load_turns(spark, str(tmp_path / "turns"), 3).count() == 3 and S.load_turns(spark, str(tmp_path / "turns")).count() == 15
    S.write_graph(turns, turns, str(tmp_path / "graph"))
    assert [x.count() for x in S.load_graph(spark, str(tmp_path / "graph"))] == [15, 15]
