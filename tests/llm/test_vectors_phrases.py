"""Nearest neighbours, whitening and phrases against brute force, with nulls, repeats, ties, hot leaders and clashing columns."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from archivolt.llm import forest, mixing, phrases, topk, whiten

SF = "/root/testdata/sf0.1"
VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType()))])
CLASH = ["asker", "leaves", "tree", "bundle", "e", "m", "p", "at", "x", "w", "n", "words", "slot", "phrase", "a`b", "c.d"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


def cosine_lists(ids, vectors, every, k):
    """query → list of (vec_id, score) of all usable rows, by definition."""
    rows = [(i, np.array(v, float)) for i, v in zip(ids, vectors, strict=True) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.pad(v, (0, dim - len(v)))) for i, v in rows]
    out = {}
    for q in sorted({i for i, _ in rows if i % every == 0}):
        own = min(tuple(v) for i, v in rows if i == q)
        near = sorted((-float(np.dot(own, v) / np.linalg.norm(own) / np.linalg.norm(v)), i) for i, v in rows if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_forest_reaches_the_true_neighbours(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    want = cosine_lists([r[0] for r in rows], [r[1] for r in rows], 50, 5)
    got = defaultdict(list)
    for r in forest.nearest(clashing(df)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, found in got.items():
        of = {r[0]: np.array(r[1], float) for r in rows if r[0] == q or r[0] in {i for i, _ in found}}
        for i, s in found:
            assert abs(s - of[q] @ of[i] / np.linalg.norm(of[q]) / np.linalg.norm(of[i])) < 1e-12


def test_small_and_odd_vectors_have_exact_lists(spark):
    rng = np.random.default_rng(3)
    base = [[float(x) for x in rng.integers(-3, 4, 4)] for _ in range(60)]
    rows = [(i, base[i % 45]) for i in range(120)] + [(7, base[7])] * 3 + [(50, [9.0, 9.0, 9.0, 9.0]), (50, base[3])]
    rows += [(200, None), (250, [1.0, None, 2.0, 3.0]), (300, [float("nan")] * 4), (350, [0.0] * 4), (None, base[1]), (400, [1.0, 2.0]), (401, []), (402, [float("inf"), 0.0, 0.0, 0.0])]
    got = defaultdict(list)
    for r in forest.nearest(clashing(spark.createDataFrame(rows, VECTORS))).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    want = cosine_lists([r[0] for r in rows], [r[1] for r in rows], 50, 5)
    assert {q: [(i, round(s, 9)) for i, s in x] for q, x in want.items()} == dict(got)


def test_rows_of_one_id_do_not_hide_the_others(spark):
    rows = [(0, [1.0, i / 1000, 0.0, 0.0]) for i in range(300)] + [(i, [-1.0, i / 50, 1.0, 0.5]) for i in range(1, 6)]
    got = forest.nearest(spark.createDataFrame(rows, VECTORS)).where("query_id = 0").collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, 4, 5}


def test_forest_of_equal_rows_and_of_nothing(spark):
    same = [(i, [1.0, 2.0]) for i in range(500)]
    got = forest.nearest(spark.createDataFrame(same, VECTORS)).collect()
    assert len(got) == 50 and {r["vec_id"] for r in got if r["query_id"] == 0} == {1, 2, 3, 4, 5} and {r["vec_id"] for r in got if r["query_id"] == 100} == {0, 1, 2, 3, 4}
    assert forest.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert forest.nearest(spark.createDataFrame([(1, [1.0])], VECTORS)).count() == 0
    assert forest.nearest(spark.createDataFrame([(0, [1.0])], VECTORS)).count() == 0


def test_leaves_come_in_the_order_of_the_shared_queue():
    rng = np.random.default_rng(5)
    sample = rng.standard_normal((400, 8))
    trees = forest.Forest.fitted(sample, 3, 4)
    sizes = np.ones((3, 16), int)
    x = rng.standard_normal(8) @ trees.pool
    order = [(t, leaf) for t, leaf, _ in trees.walk(x, sizes)]
    cost = {}
    for t in range(3):
        for leaf in range(16):
            node, far = leaf + 15, 0.0
            while node:
                up = (node - 1) // 2
                m = x[trees.along[t, up]] - trees.median[t, up]
                far += 0.0 if (node == 2 * up + 2) == (m > 0) else m * m
                node = up
            cost[t, leaf] = far
    assert sorted(order) == sorted(cost) and np.all(np.diff([cost[o] for o in order]) >= -1e-12)


def whitened_by_hand(vectors, components):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    off = (n * x - s) / n
    e, u = np.linalg.eigh(off.T @ off / n)
    e, u = e[::-1], u[:, ::-1]
    return [int(d) for d in ((n * x - s).astype(object) ** 2).sum(axis=1)], off @ u[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum()


def test_whitening_is_that_of_the_definition(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12))).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (903, [float("-inf")] + [0.0] * 11)]
    for block, band, held in ((1024, 4096, 64), (32, 5, 2)):  # one block; many bands and splits
        for name, value in (("BLOCK", block), ("BAND", band), ("HELD", held)):
            monkeypatch.setattr(whiten, name, value)
        out = whiten.whiten(clashing(spark.createDataFrame(rows + odd, VECTORS).repartition(5))).orderBy("vec_id", "component").collect()
        deviation, white, share = whitened_by_hand(vectors, 8)
        assert len(out) == 700 * 8 and [int(r["deviation"]) for r in out[::8]] == deviation and {r["n"] for r in out} == {700}
        got = np.array([r["whitened"] for r in out]).reshape(700, 8)
        assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-7
        assert np.abs(np.array([r["explained"] for r in out[:8]]) - share).max() < 1e-12 and out[0]["identity_error"] < 1e-9


def test_whitening_of_repeats_few_rows_padding_and_nothing(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.1]), (4, [0.9, 0.3])]
    out = whiten.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(out) == 8 and sum(r["vec_id"] is None for r in out) == 2 and {r["component"] for r in out} == {1, 2}
    few = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 1.0, 0.0])], VECTORS)).collect()
    assert len(few) == 2 and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in few)  # two rows have one component
    for none in ([], [(1, None)], [(1, [])], [(1, [1.0]), (2, [1.0])]):
        assert whiten.whiten(spark.createDataFrame(none, VECTORS)).count() == 0


def test_large_steps_are_summed_exactly(spark):
    rows = [(i, [float(i % 7) * 1e9, float(i)]) for i in range(50)]
    out = whiten.whiten(spark.createDataFrame(rows, VECTORS)).where("component = 1").orderBy("vec_id").collect()
    assert [int(r["deviation"]) for r in out] == whitened_by_hand([v for _, v in rows], 1)[0]


def counted_by_hand(rows):
    f = defaultdict(Counter)
    lower = {i: i + 32 for i in range(65, 91)}
    for text, lang in rows:
        c = f["und" if lang is None else lang]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            for i in range(len(w)):
                c.update(tuple(w[i:j]) for j in range(i + 1, min(i + 5, len(w)) + 1))
    return f


def collocations_by_hand(rows, least, first):
    out = []
    for lang, c in counted_by_hand(rows).items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        some = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        longer = Counter()
        for k, v in some.items():
            for m in range(2, len(k)):
                for i in range(len(k) - m + 1):
                    longer[k[i : i + m]] = max(longer[k[i : i + m]], v)
        best = []
        for k, a in some.items():
            if longer[k] < a:
                s, at = min(((1000 * a * n) // (c[k[:i]] * c[k[i:]]), i) for i in range(1, len(k)))
                best.append((-s, -a, " ".join(k).encode(), c[k[:at]], c[k[at:]], n))
        out += [(lang, i + 1, p.decode(), -a, x, r, n, -s) for i, (s, a, p, x, r, n) in enumerate(sorted(best)[:first])]
    return sorted(out)


def texts():
    rng = np.random.default_rng(2)
    words = ["the", "The", "cat", "é", "Ünder", "日本", "a b", "x" * 50, "sat", "on", "und", "en"]
    made = [("".join(rng.choice(words) + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " "])) for _ in range(60)), str(rng.choice(["en", "de", "und"]))) for _ in range(40)]
    return made + [("the cat sat on the cat", None)] * 30 + [(None, "en"), ("", "en"), (" \t..", "xx"), ("ABC", "ABC"), ("one", None)] + [("hot hot hot hot hot hot hot", "en")] * 20


@pytest.mark.parametrize("limits", [(1_000_000, 250_000), (500, 60), (50, 3)])
def test_phrases_are_those_of_the_definition(spark, monkeypatch, limits):
    for name, value in zip(("BUCKET", "HOT"), limits, strict=True):
        monkeypatch.setattr(phrases, name, value)
    rows = texts()
    df = clashing(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert sorted(tuple(r) for r in phrases.collocations(df, least=4, first=50).collect()) == collocations_by_hand(rows, 4, 50)
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in phrases.counts(df, least=4).where("words > 0").collect()}
    assert got == {(lang, k): v for lang, c in counted_by_hand(rows).items() for k, v in c.items() if v >= 4}


def test_long_texts_are_cut_without_loss(monkeypatch):
    for text in (" ".join(f"w{i % 13}" for i in range(400)), "a" * 700 + " b " + "c" * 300 + ". d e f g h i", "x, " * 200, "y" * 500, "." * 400 + "z"):
        want = Counter()
        for (p,), v in ((k, v) for k, v in counted_by_hand([(text, "en")])["en"].items() if len(k) == 1):
            want[p] += v
        batch = pa.record_batch([pa.array([text]), pa.array(["en"])], names=["text", "lang"])
        seen = {}
        for portion in (10_000, 100, 7):
            monkeypatch.setattr(phrases, "PORTION", portion)
            found = Counter()
            for s in phrases.suffixes(iter([batch])):
                names = s.words.to_pylist()
                found.update(tuple(names[c] for c in row[1:] if c >= 0) for row in s.codes.tolist())
            seen[portion] = found
            assert Counter({w: sum(v for k, v in found.items() if k[0] == w) for w in want}) == want
        assert seen[10_000] == seen[100] == seen[7]


def test_no_phrases(spark):
    for rows in ([], [(None, None)], [("", "en")]):
        assert phrases.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_large_components_are_scored_as_they_are(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-200_000, 200_000, 4)]) for i in range(300)]
    ints = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows}
    assert max(np.abs(v).max() for v in ints.values()) > 1 << 27
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: [(i, -s) for s, i in sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:10]] for q in (0, 100, 200)}
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], VECTORS))


def test_mixing_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "a b", f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string").select("*", F.lit("x").alias("a.b"), F.lit("y").alias("x`y"), F.lit("z").alias("_copy"))
    out = mixing.emit(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {("x", "y", "z")}
