"""Book links, load under weather and calendar, quotes, itineraries, order within hot keys, slices, odd vectors, evidence pages."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from archivolt.functions import repair as P
from archivolt.operators import chunks as C
from archivolt.operators import graph as K
from archivolt.operators import pairs as L
from archivolt.operators import search as R
from archivolt.operators import tables as G
from archivolt.operators.order import numbered, with_blocks
from archivolt.plans.wider import QUERIES
from archivolt.sources import tables as S


def test_files_meet_books_by_containment_either_way(spark):
    titles = ["红军长征过云南", "金沙江的记忆 1935-2006 红军长征过云南纪实", "贵州历史考察记", "Old Book", "Old Bock", " -- ", None]
    files = ["红军长征过云南 -- 编写组 -- 1985.txt", "金沙江的记忆 1935-2006 红军长征过云南纪实 (史石编).txt", "贵州历史考察记上册", "Old", "ＯＬＤ", "unknown", "()", "", None, "贵州 历史考察"]
    got = C.match_book(spark.createDataFrame(list(enumerate(files)), "fid long, name string"), spark.createDataFrame(list(enumerate(titles)), "ord long, title string"))
    assert dict(got.collect()) == {0: titles[0], 1: titles[1], 2: titles[2], 3: "Old Book", 9: titles[2]}


def test_copies_of_names_and_titles_are_not_paired(spark, monkeypatch):
    search, met = C.found_phrases, []

    def counted(*args):
        out = search(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(C, "found_phrases", counted)
    k = F.col("id")
    files = spark.range(300).select(k.alias("fid"), F.when(k % 2 == 0, "red bolt (x).txt").otherwise("bolt").alias("name"))
    titles = spark.range(300).select((1000 - k).alias("ord"), F.when(k % 2 == 0, "Red Bolt").when(k % 3 == 0, "red bolt").otherwise("red  (bolt)").alias("title"))
    got = C.match_book(files, titles)
    assert {(r["fid"] % 2, r["title"]) for r in got.collect()} == {(0, "red  (bolt)"), (1, "red  (bolt)")} and got.count() == 300
    assert met == [1, 1]
    again = spark.createDataFrame([(1, "bolt"), (1, "the old ring"), (2, "old ring")], "fid long, name string")
    rings = spark.createDataFrame([(1, "bolt"), (2, "old ring"), (3, "old-ring")], "ord long, title string")
    assert sorted(map(tuple, C.match_book(again, rings).collect())) == [(1, "old ring"), (2, "old ring")]


def test_entities_with_one_hash_id_are_redirected_by_name(spark, tmp_path):
    rows = [(1, "A_0000000A", "Old Ring"), (2, "P2", "old ring"), (3, "A_0000000A", "Gear"), (4, "A_0000000A", "gear"), (5, "A_0000000B", "Bolt"), (6, "A_0000000B", "old ring")]
    e = spark.createDataFrame(rows, "ord long, id string, name string").withColumn("aliases", F.array("name")).withColumn("properties", F.create_map("name", "name"))
    groups, ids = K.merged_duplicates(e)
    assert {r["key"]: (r["keep_id"], r["n"]) for r in groups.collect()} == {"oldring": ("P2", 3), "gear": ("A_0000000A", 2), "bolt": ("A_0000000B", 1)}
    assert sorted(map(tuple, ids.collect())) == [("A_0000000A", "P2"), ("A_0000000B", "P2"), ("P2", "P2")]
    r = spark.createDataFrame([(1, "A_0000000A", "A_0000000B", "GEAR"), (2, "A_0000000A", "x", "old ring"), (3, "A_0000000A", "x", None)], "n long, source string, target string, source_name string")
    assert sorted(map(tuple, K.redirected(r.drop("source_name"), ids).collect())) == [(1, "P2", "P2"), (2, "P2", "x"), (3, "P2", "x")]
    assert sorted(map(tuple, K.redirected(r, ids, K.kept_ids(e)).collect())) == [(1, "A_0000000A", "P2"), (2, "P2", "x"), (3, "A_0000000A", "x")]
    # SHA-1 of the keys 601 and 737407 begins with the same 32 bits.
    part = spark.createDataFrame([(601, "small anvil", "b"), (603, "small  Anvil", "b"), (737407, "large widget", "b"), (5, None, "b")], "p_partkey long, p_name string, p_brand string")
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(map(tuple, QUERIES["k14_redirected"](spark, str(tmp_path)).collect())) == [(601, "P603", "x"), (603, "P603", "x"), (737407, "A_3BB18D9A", "x")]


def test_terms_of_one_length_go_by_the_list():
    assert P.NearTerms(["bcde", "acde", "xyz", "bcde"]).terms == ["bcde", "acde", "xyz"]
    assert P.NearTerms(["bcde", "acde"]).mended("ycde") == "bcde" and P.NearTerms(["acde", "bcde"]).mended("ycde") == "acde"


def points(spark, hour, weather=(), day="workday", base=450, capacity=500):
    weights = [0.0] * 8 + [0.5, 1.0] + [0.2] * 14
    load = G.expected_load(spark.createDataFrame([("x", base), ("y", base)], "site string, base int"), spark.createDataFrame(list(enumerate(weights)), "hour int, weight double"))
    asked = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "day int, site string")
    days = spark.createDataFrame([(1, {"holiday": 1.8, "workday": 1.0}[day])], "day int, factor double")
    w = spark.createDataFrame([(1, *r) for r in weather], "day int, site string, text string, temp string")
    return G.factored_snapshot(asked, load, spark.createDataFrame([("x", capacity)], "site string, capacity int"), w, days, hour)


def test_load_under_weather_and_calendar(spark):
    night = points(spark, (3,)).collect()
    assert all(r["visitors"] == 0 and r["level"] == "comfortable" for r in night) and len(night) == 3
    plain = {(r["day"], r["site"]): r for r in points(spark, (8, 9)).collect()}
    assert plain[1, "x"]["visitors"] == plain[1, "x"]["base"] == 338 and plain[1, "x"]["level"] == "moderate" and plain[1, "y"]["ratio"] == 0
    rain = {(r["day"], r["site"]): r for r in points(spark, (8, 9), [("x", "heavy rain", "18")]).collect()}
    assert rain[1, "x"]["base"] == plain[1, "x"]["visitors"] > rain[1, "x"]["visitors"] and rain[1, "x"]["weather_factor"] == 0.6 and rain[2, "x"]["weather_factor"] == 1.0
    feast = points(spark, (8, 9), day="holiday")
    assert {(r["day"], r["total"], r["alerts"]) for r in G.snapshot_report(feast).collect()} == {(1, 2 * 608, "x"), (2, 338, "")}


def test_curve_of_a_day(spark):
    load = spark.createDataFrame([("x", h, {17: 9, 9: 9}.get(h, 1)) for h in range(24)], "site string, hour int, expected long")
    (r,) = G.day_curve(load, spark.createDataFrame([("x", 10)], "site string, capacity int"), 17).collect()
    assert len(r["series"]) == 24 and r["peak_hour"] == 9 and r["peak"] == max(r["series"]) and r["current"] == 9 and r["current_level"] == "alert"


def test_quotes_by_stage(spark):
    aliases = (("小学", "小学"), ("初中", "初中"), ("中学", "初中"), ("高中", "高中"), ("党校", "成人"), ("党员", "成人"))
    fees = spark.createDataFrame([("小学", 98, 20), ("初中", 118, 20), ("成人", 150, None)], "stage string, fee int, per_guide int")
    rows = [("小学高年级", 40, 2), ("高中", 40, 2), ("党员干部培训", 21, 1), (None, None, None), ("火星学段", 0, 9), ("中学", 500, 1)]
    got = [tuple(r)[3:] for r in G.stage_quote(spark.createDataFrame(rows, "said string, size int, days int"), aliases, fees, "初中").orderBy(F.monotonically_increasing_id()).collect()]
    assert got == [("小学", 196, 7840, 2), ("高中", 0, 0, 2), ("成人", 150, 3150, 2), ("初中", 236, 9440, 2), ("初中", 826, 33040, 2), ("初中", 118, 23600, 10)]


def test_ways_there_between_and_back(spark):
    stops = spark.createDataFrame([("r", 1, 1, 0.0, 0.0), ("r", 2, 2, 0.0, 1.0), ("q", 1, 1, 5.0, 5.0), ("n", 1, 1, None, None)], "request string, ord int, day int, lat double, lng double")
    requests = spark.createDataFrame([("r", "rail", 1.0, 0.0, 3), ("q", "boat", None, None, None), ("n", None, 1.0, 1.0, None)], "request string, mode string, dlat double, dlng double, last_day int")
    legs = {(r["request"], r["leg"]): (r["day"], r["km"], r["hours"]) for r in G.whole_legs(stops, requests).collect()}
    km = round(6371 * np.radians(1) * 1.2, 1)
    assert legs["r", "outbound"] == (1, km, round(km / 200 + 0.75, 2)) and legs["r", "internal"][0] == 2 and legs["r", "return"][0] == 3
    assert legs["n", "outbound"] == (1, 0.0, 0.0) and not [k for k in legs if k[0] == "q"] and len(legs) == 5


def test_sites_side_by_side_and_nodes(spark):
    pairs = spark.createDataFrame([("x", "z")], "a string, b string")
    events = spark.createDataFrame([("x", 2, "later"), ("x", 1, "first"), ("z", 1, "none")], "site string, ord int, label string")
    relations = spark.createDataFrame([(i, f"r{i}", "x", "y") for i in range(9)], "ord int, rid string, source string, target string")
    got = sorted(tuple(r)[2:] for r in K.compared(pairs, spark.createDataFrame([("x", "about x")], "site string, profile string"), events, relations).collect())
    assert got == sorted([("a", "profile", 0, "about x"), ("a", "event", 1, "first"), ("a", "event", 2, "later"), ("b", "profile", 0, "not found")] + [("a", "relation", i + 1, f"r{i}") for i in range(5)])
    e = spark.createDataFrame([("1", "army", "A", None, None), ("2", "site", None, "d", ["b"])], "id string, type string, name string, description string, aliases array<string>")
    assert [tuple(r) for r in K.nodes(e, "site").collect()] == [("2", "site", "", "d", ["b"])] and K.nodes(e).count() == 2


def test_numbers_in_a_hot_key_are_spread_and_right(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 == 7, None).otherwise(F.col("id") % 50).alias("k"), ((F.col("id") * 7919) % 200_003).alias("t"))
    w = Window.partitionBy("k").orderBy("t")
    want = rows.withColumn("number", F.row_number().over(w) - 1).withColumn("many", F.count("*").over(Window.partitionBy("k")))
    got = numbered(rows, "k", ["t"])
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 200_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        dealt = rows.repartitionByRange("k", "t").where("k = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 0.7 * 140_000
    blocks = with_blocks(got.where("k = 1"), 6, 1000)
    back = Window.partitionBy("k", "block").orderBy("number").rowsBetween(-6, -1)
    sums = blocks.withColumn("s", F.sum("t").over(back)).where("own").select("number", "s")
    plain = want.where("k = 1").withColumn("s", F.sum("t").over(w.rowsBetween(-6, -1))).select(F.col("number").cast("long"), "s")
    assert sums.exceptAll(plain).count() == 0 and sums.count() == 140_000


def test_slices_survive_reruns_and_broken_runs(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "x long, source string"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    read = lambda: sorted(tuple(r) for r in S.read_slices(spark, path, "source", schema).collect())
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "source string")
    S.write_slices(make((1, "a"), (2, "b"), (3, "c"), (9, "unnamed")), names("a", "b", "c"), path, "source", 1)
    assert read() == [(1, "a"), (2, "b"), (3, "c")]
    for _ in range(2):  # the same run twice doubles nothing; slice c is emptied
        S.write_slices(make((10, "b"), (11, "b")), names("b", "c"), path, "source", 2)
        assert read() == [(1, "a"), (10, "b"), (11, "b")]
    make((99, "a")).write.mode("overwrite").partitionBy("source").parquet(f"{path}/data/run=3")  # a run that was lost before its mark
    assert read() == [(1, "a"), (10, "b"), (11, "b")]
    S.write_slices(make((4, "a")), names("a"), path, "source", 3)
    assert read() == [(4, "a"), (10, "b"), (11, "b")]


def test_dense_search_of_odd_vectors_within_places(spark):
    kind = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType()))])
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(1, 40)] + [(50, [1.0]), (51, None), (52, [None, 1.0]), (53, [float("nan")]), (54, []), (None, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, kind)
    good = {i: np.pad(np.array(e, float), (0, 3 - len(e))) for i, e in rows if i is not None and e is not None and i not in (52, 53)}
    unit = {i: e / max(np.linalg.norm(e), 1e-300) for i, e in good.items()}
    places = [("p", i) for i in range(1, 31)] + [("q", i) for i in range(1, 5)]
    asked = [(1, "p"), (2, "q"), (3, None), (50, "p")]
    q = v.join(spark.createDataFrame(asked, "vec_id long, place string"), "vec_id")
    got = {}
    for r in R.dense_top_k(v, q, 4, places=spark.createDataFrame(places, "place string, unit long")).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["vec_id"], r["score"]))
    for i, place in asked:
        of = [u for u in good if u != i and (place != "p" or u <= 30)]
        assert got[i] == [(u, s) for s, u in sorted((-round(float(unit[i] @ unit[u]), 6), u) for u in of)[:4] for s in [-s + 0.0]]
    assert set(r["qid"] for r in R.dense_top_k(v, v.where("vec_id >= 50"), 2).collect()) == {50, 54}


@pytest.mark.parametrize("least", [0.45, 0.8])
def test_evidence_pages_by_ratio(spark, least):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcde fg") for _ in range(n))
    pages = [("d", i, text(40)) for i in range(12)] + [("e", 0, text(40)), ("d", 12, None), ("d", 13, "")]
    spoil = lambda s: "".join(c if rng.random() > 0.15 else "x" for c in s)
    asked = [(i, "d", spoil(pages[i][2])) for i in range(12)] + [(20, "d", pages[3][2][5:20]), (21, "e", "zzzzzz"), (22, "f", "abc"), (23, "d", "  "), (24, "d", None)]
    want = {}
    for eid, doc, s in asked:
        s = (s or "").replace(" ", "")
        of = [(p, t.replace(" ", "")) for d, p, t in pages if d == doc and t]
        if s:
            exact = [p for p, t in of if s in t]
            near = sorted((-SequenceMatcher(None, s, t).ratio(), p) for p, t in of)
            if exact:
                want[eid] = (min(exact), 1.0)
            elif near and -near[0][0] >= least:
                want[eid] = (near[0][1], -near[0][0])
    got = L.evidence_page(spark.createDataFrame(asked, "eid long, doc string, snippet string"), spark.createDataFrame(pages, "doc string, page int, text string"), lambda c: F.replace(c, F.lit(" "), F.lit("")), least)
    assert {r["eid"]: (r["page"], r["ratio"]) for r in got.collect()} == want and any(r != 1.0 for _, r in want.values())


def test_nearest_sites_by_rings_equal_all_pairs(spark):
    rng = random.Random(3)
    sites = [(i, f"s{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(300 + i, f"d{i}", rng.uniform(-5, 5), 179.5 - i % 2 * 359) for i in range(20)] + [(400, "same", 10.0, 10.0), (401, "twin", 10.0, 10.0), (402, "nowhere", None, 1.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(200, 0.0, 179.99), (201, 0.0, -179.99), (202, 90.0, 0.0), (203, -90.0, 5.0), (204, 10.0, 10.0), (205, None, 1.0), (206, 89.9, 179.0), (207, 0.0, 180.0)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    p, s = frame(points, "point int, plat double, plng double"), frame(sites, "ord int, site string, lat double, lng double")
    km = F.round(G.haversine(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")), 6)
    all_ = p.crossJoin(s).where("plat IS NOT NULL AND lat IS NOT NULL").withColumn("km", km)
    want = all_.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("km", "ord"))).where("rank <= 4").select("point", "site", "km", "rank")
    got = G.nearest(p, s, 4)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 4 * 157
    assert G.nearest(p, s.limit(2), 4).count() == 2 * 157 and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
