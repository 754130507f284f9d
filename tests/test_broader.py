"""Fixture and brute-force tests of search, merging, pages, sources and sliding means."""

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators import chunks as C
from archivolt.operators import graph as K
from archivolt.operators import pairs as L
from archivolt.operators import search as R
from archivolt.operators import tables as G
from archivolt.operators import terms as T
from archivolt.sources import tables as S
from archivolt.sources.shared import saved


def test_names_are_found_within_texts_without_blanks(spark):
    docs = spark.createDataFrame([(1, "强渡金沙江之后"), (2, "over the red bridge at night"), (3, None), (4, "")], "doc_id long, text string")
    names = spark.createDataFrame([("金沙江", None), ("bridge", "red bridge"), ("", "x"), ("none", None)], "name string, alias string")
    assert {tuple(r) for r in K.dictionary_mentions(docs, names).collect()} == {(1, "金沙江"), (2, "bridge")}


def test_fixes_go_on_until_nothing_changes(spark):
    fixes = [("d", "e"), ("c", "d"), ("b", "c"), ("a", "b"), ("", "x"), ("q", "q")]
    df = spark.createDataFrame([("a",), ("",), (None,), ("zz",)], "s string")
    assert [r[0] for r in df.select(X.apply_fixes(F.col("s"), fixes)).collect()] == ["e", "", None, "zz"]


def test_pages_by_interpolation(spark):
    toc = spark.createDataFrame([("b", 0, "甲", 1), ("b", 1, "乙", 50), ("b", 2, "丙", 100), ("n", 0, "丁", None)], "book string, ord int, item string, page int")
    chunks = spark.createDataFrame([("b", o, o, 10000) for o in (2500, 7500, 9999, 0)] + [("n", 1, 5, 100)], "book string, chunk_id int, offset int, length int")
    got = {(r.book, r.chunk_id): (r.section, r.page, r.how) for r in C.approx_annotated(chunks, toc, 0.05).collect()}
    assert [got["b", o][0] for o in (0, 2500, 7500, 9999)] == ["甲", "甲", "乙", "丙"]
    assert got["b", 9999] == ("丙", 100, "approx") and got["n", 1] == (None, None, None)


def test_lists_are_filled_with_the_least_units(spark):
    units = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue fox", "green", "red", None])], "unit long, text string")
    asked = spark.createDataFrame([(10, "red"), (11, "nothing here")], "unit long, text string")
    vocab, index = R.weights(units, T.WORD, 100, save=saved)
    found = R.top_k(index, T.vectors(asked, T.WORD, vocab), 3)
    got = {}
    for r in R.zero_filled(found, asked.select(F.col("unit").alias("qid")), units, 3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.unit, r.score > 0))
    assert sorted(got[10]) == [(1, 3, True), (2, 0, True), (3, 1, False)] and sorted(got[11]) == [(1, 0, False), (2, 1, False), (3, 2, False)]


def test_dense_search_in_blocks_matches_brute_force(spark):
    e = np.random.default_rng(3).integers(-3, 4, (120, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)] + [(500, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in R.dense_top_k(df, df.where("vec_id % 10 = 0"), 5, block=4).collect():
        got.setdefault(r.qid, []).append((r.rank, r.vec_id, r.score))
    u = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
    for q in range(0, 120, 10):
        s = np.round(u @ u[q], 6)
        want = sorted((-s[i], i) for i in range(120) if i != q)[:5]
        assert [(i, s_) for _, i, s_ in sorted(got[q])] == [(i, -x + 0.0) for x, i in want]


def test_near_duplicates_match_all_pairs(spark):
    rnd = random.Random(5)
    names = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(9))) for _ in range(120)] + ["abcde", "abcdf", "ABCDE"]
    df = spark.createDataFrame([(i, f"e{i}", n) for i, n in enumerate(names)], "ord int, id string, name string")
    first = {}
    for i, n in enumerate(names):
        key = n.replace(" ", "")
        if len(n) >= 2 and key:
            first.setdefault(key, i)
    want = {(f"e{i}", f"e{j}") for a, i in first.items() for b, j in first.items() if i < j and SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert {(r.a_id, r.b_id) for r in K.near_duplicates(df).collect()} == want


def test_variants_match_all_pairs(spark):
    rnd = random.Random(6)
    runs = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 8))): rnd.randrange(1, 6) for _ in range(90)}
    names = [w for w in list(runs)[:15]] + ["abcabca", "cab"]
    got = L.edit_variants(spark.createDataFrame(list(runs.items()), "run string, n long"), spark.createDataFrame([(n,) for n in names], "name string")).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    free = {r: n for r, n in runs.items() if n >= 3 and r not in names}
    assert {(r.variant, r.name, r.distance) for r in got} == {(a, b, distance(a, b)) for a in free for b in set(names) if a[0] == b[0] and distance(a, b) <= 2}
    got = L.variants(spark.createDataFrame(list(runs.items()), "run string, n long"), spark.createDataFrame([(n,) for n in set(names)], "name string")).collect()
    fits = lambda a, b: a[0] == b[0] and abs(len(a) - len(b)) <= 2 and 0.6 <= SequenceMatcher(None, a, b).ratio() < 1
    assert {(r.variant, r.name) for r in got} == {(a, b) for a in free for b in set(names) if fits(a, b)}


def test_review_cascades_and_counts(spark):
    e = spark.createDataFrame([(1, " a "), (2, "b"), (3, "c")], "id long, name string")
    d = spark.createDataFrame([("a", "remove", None), ("b", "rename", "B"), ("zz", "approve", None)], "name string, action string, canonical_name string")
    r = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1)], "rid long, source long, target long")
    assert [x.rid for x in K.reviewed_relations(r, e, d).collect()] == [2]
    assert dict(K.review_stats(e, d).collect()) == {"remove": 1, "rename": 1, "missing": 1}


def test_ways_by_days_and_unknown_places(spark):
    pairs = spark.createDataFrame([("o", 30.0, 104.0, "far", 26.5, 101.7), ("o", 30.0, 104.0, "near", 30.1, 104.1), ("o", 30.0, 104.0, "none", None, None)], "origin string, olat double, olng double, site string, lat double, lng double")
    got = {r.site: r for r in G.choose_mode(G.travel(pairs, G.modes(spark)), G.day_limit(F.lit(2))).collect()}
    assert got["far"]["mode"] == "rail" and got["near"]["mode"] == "road" and got["none"]["mode"] == "road" and got["none"].km == 0
    text = spark.createDataFrame([(0.5,), (1.9999,), (2.0,), (2.25,)], "h double").select(G.hours_text(F.col("h"))).collect()
    assert [r[0] for r in text] == ["30m", "2h0m", "2h0m", "2h15m"]


def test_sliding_means_equal_the_batch(spark, tmp_path):
    from archivolt.streaming.load import sliding_mean

    rows = [(f"2026-01-01 {h:02d}:{m:02d}:00", "a" if m % 3 else "b") for h in range(6) for m in range(0, 60, 11)] + [("2026-01-02 12:00:00", "a")]
    ev = spark.createDataFrame(rows, "t string, site string").select(F.to_timestamp("t").alias("ts"), "site")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sliding_mean(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("slide_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in sliding_mean(ev).collect() if r.start.day == 1 and r.start.hour < 6 or r.start.day == 31}
    got = {tuple(r) for r in spark.table("slide_out").collect()}
    assert got == batch and len(got) == 16


def test_corpora_graphs_contents_and_chunks_are_read_and_written(spark, tmp_path):
    for name, text in (("b1.txt", "one\ntwo"), ("a2.txt", "three"), ("c1.md", "")):
        (tmp_path / name).write_text(text)
    got = S.read_texts(spark, str(tmp_path), "1").collect()
    assert [r.source for r in got if r.text] == ["b1.txt"] and [r.source for r in S.read_texts(spark, str(tmp_path), "", 1).collect()] == ["a2.txt"]
    (tmp_path / "g.json").write_text('﻿{"entities": [{"id": "x", "name": "n"}, {"id": "y"}], "relations": [{"id": "r", "source": "x"}]}', encoding="utf-8")
    e, r = S.read_graph(spark, str(tmp_path / "g.json"))
    assert [(x.ord, x.id) for x in e.collect()] == [(0, "x"), (1, "y")] and r.first().source == "x"
    assert [x.count() for x in S.read_graph(spark, str(tmp_path / "missing.json"))] == [0, 0]
    (tmp_path / "t.json").write_text('{"b": [{"item": "one", "page": "3-5"}, {"item": " ", "page": "9"}, {"item": "two", "page": "-"}]}')
    assert sorted((x.book, x.ord, x.item, x.page) for x in S.read_toc(spark, str(tmp_path / "t.json")).collect()) == [("b", 0, "one", 3), ("b", 2, "two", None)]
    chunks = C.line_chunks(spark.createDataFrame([(1, "s", "x" * 150), (2, "t", "y" * 120)], "doc_id long, source string, text string"))
    S.write_chunks(chunks, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/chunks")).count() == 2
    assert spark.read.json(str(tmp_path / "index/summary")).first().asDict() == {"chars": 270, "chunks": 2, "mean_chars": 135.0}
