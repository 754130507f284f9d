"""Terms counted in the row against their definition as column expressions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from archivolt.operators import search as R
from archivolt.operators import terms as T


def texts():
    rng = random.Random(4)
    alphabet = ["a", "b", "Ab", "ÄÖ", "ß", "x1", "_y", "金沙江", "🙂", "i̇", "l'eau", "aaaaaaa", "é"]
    made = ["".join(rng.choice(alphabet) + rng.choice([" ", "", "  ", "\n", "　", "-", "."]) for _ in range(rng.randint(0, 60))) for _ in range(70)]
    return list(enumerate([*made, None, "", "  ", "a", "ab abc abcd"]))


def by_hand(rows, features, sublinear):
    """rows: unit → list of terms."""
    tf = {u: Counter(t) for u, t in rows.items()}
    n, df = Counter(), Counter()
    for c in tf.values():
        n.update(c)
        df.update(c.keys())
    best = sorted(n, key=lambda t: (-n[t], t.encode()))[:features]
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in best}
    out = {}
    for u, c in tf.items():
        x = {t: ((1 + math.log(v)) if sublinear else v) * idf[t] for t, v in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out |= {(u, t): v / norm for t, v in x.items()}
    return {t: df[t] for t in best}, out


@pytest.mark.parametrize("kind,column,features,sublinear", [(T.CHAR, R.char_terms, 60, True), (T.WORD, R.word_terms, 40, False), (T.CHAR, R.char_terms, 10_000, False), (T.WORD, R.word_terms, 10_000, True)])
def test_counts_and_weights_are_those_of_the_definition(spark, kind, column, features, sublinear):
    units = spark.createDataFrame(texts(), "unit long, text string").repartition(3)
    rows = {r["unit"]: r["t"] or [] for r in units.select("unit", column(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    df, weights = by_hand(rows, features, sublinear)
    vocab, index = R.weights(units, kind, features, sublinear)
    assert {r["term"]: r["df"] for r in vocab.collect()} == df
    got = {(r["unit"], r["term"]): r["w"] for r in index.collect()}
    assert got.keys() == weights.keys() and all(abs(got[k] - weights[k]) < 1e-12 for k in got)


def test_portions_and_many_letters_change_nothing(monkeypatch, spark):
    import pyarrow as pa

    rng = random.Random(6)
    words = ["".join(chr(rng.choice([97, 98, 0x4E00 + rng.randrange(20_000), 0x20000 + rng.randrange(40_000)])) for _ in range(rng.randint(1, 9))) for _ in range(30_000)]
    lists = pa.array([words[i * 100 : (i + 1) * 100] for i in range(300)] + [[], ["a"]])
    want = {(r, p[i : i + n]) for r, ws in enumerate(lists.to_pylist()) for w in ws for p in [f" {w} "] for n in (2, 3, 4) for i in range(max(1, len(p) - n + 1)) if len(p) >= n}
    for step in (10_000_000, 250):  # all letters in one number only in the small portions
        monkeypatch.setattr(T, "WORDS", step)
        got = set()
        for first, e in T.CHAR.entries(lists):
            names = e.terms.to_pylist()
            got |= {(first + r, names[t]) for r, t in zip(e.row.tolist(), e.term.tolist(), strict=True)}
        assert got == want


def test_nothing_is_shuffled_but_the_vocabulary(spark):
    units = spark.createDataFrame(texts(), "unit long, text string")
    vocab, index = R.weights(units, T.CHAR, 50)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange RoundRobin") == 1  # few rows are dealt over the cores
    assert R.searched(units, units.limit(0), T.CHAR, 50, 3).count() == 0 and R.weights(units.limit(0), T.WORD, 50)[1].count() == 0


def test_best_units_are_those_of_the_full_join_from_few_rows(monkeypatch, spark):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(40_000)]
    units = spark.createDataFrame([(i, " ".join(words[i * 20 % 39_000 : i * 20 % 39_000 + 5 + i % 40])) for i in range(1500)] + [(2000 + i, "w1 w2 w3") for i in range(200)] + [(5000, None)], "unit long, text string").repartition(2)
    asked = spark.createDataFrame([(i, " ".join(words[i * 700 : i * 700 + 3 + i])) for i in range(40)] + [(90, "w1 w2 w3"), (91, "nowhere"), (92, None)], "unit long, text string")
    vocab, index = R.weights(units, T.WORD, 400)
    q = T.vectors(asked, T.WORD, vocab)
    want = {(r["qid"], r["rank"]): (r["unit"], r["score"]) for r in R.top_k(index, q, 5).collect()}
    for weights in (64_000_000, 20_000):
        monkeypatch.setattr(T, "WEIGHTS", weights)
        got = {(r["qid"], r["rank"]): (r["unit"], r["score"]) for r in R.searched(units, asked, T.WORD, 400, 5).collect()}
        assert got == want and len({q for q, _ in got}) > 30
    assert T.best(units, T.WORD, vocab, q, 5).count() < 0.1 * index.join(q.select("term", F.col("unit").alias("qid")), "term").count()
    assert R.searched(units, asked, T.WORD, 400, 5).count() == len(want)
    monkeypatch.setattr(T, "QUERIES", 3)  # the join of many queries
    assert {(r["qid"], r["rank"]): (r["unit"], r["score"]) for r in R.searched(units, asked, T.WORD, 400, 5).collect()} == want
