"""Toxic passages by maximum-scoring segments of token log-odds.

Labelled texts give each token a log-odds with an informative Dirichlet prior; tokens that stand out (z >= Z) score by it,
all others get the (slightly negative) log-odds of being unremarkable. A linear scan finds all maximal segments
(Ruzzo and Tompa); with the scale of the scores under the clean background (Karlin and Altschul), the segments' scores
become bits beyond what chance gives in a text of that length, are summed, and a logistic curve fitted on the training
rows turns the sum into a probability.

A tail of evidence is flat: beyond SURE the curve is 1 for any slope that labels give, so the sum is not carried further.

Edge cases: null and empty texts have no segment and get the calibrated score of that; repeated rows are answered alike;
several labels of one document count as toxic if one says so; labels of a null id are not learned from (it is held out);
without labels of both kinds every score is the toxic share (tiny if there is no label); equal scores are kept as they are;
very long texts are read whole; an empty table gives an empty result; columns in `keep` come through whatever their names,
and the new ones have the names that are asked for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import fold, free_name, portions, quoted, saved, typed

TRAIN_ROWS = 20_000  # labelled rows used, by hash of the id
Z = 3.0  # tokens that stand out less score as all others
SURE = 60.0
PRIOR = 0.1  # mass of the Dirichlet prior as a share of the training tokens
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


@dataclass
class Model:
    """Scores of tokens, of other tokens, and the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.1
    rate: float = 1.0  # lambda
    offset: float = 0.0
    slope: float = 0.0

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and the maximal segments as (first token, end token, score)."""
        words = tokens(text)
        get = self.scores.get
        hits = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        return len(words), maximal_segments(hits, self.other)

    def excess(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum over segments of rate * score - ln(n), the best one even where it is negative."""
        each = sorted((self.rate * s - math.log(max(n, 1)) for _, _, s in found), reverse=True)
        return min(SURE, each[0] + sum(x for x in each[1:] if x > 0)) if each else -math.log(max(n, 1)) - 1.0

    def probability(self, n: int, found: list[tuple[int, int, float]]) -> float:
        x = self.offset + self.slope * self.excess(n, found)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in one pass; tokens between hits score `other` each."""
    kept: list[list] = []  # first, end, sum before it, sum up to its end
    total, at = 0.0, 0
    for i, s in hits:
        total += other * (i - at)
        at = i + 1
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(a, b, r - l) for a, b, l, r in kept]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches, "text", 8_000_000):
        toxic, clean = Counter(), Counter()
        for text, t in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
            (toxic if t else clean).update(tokens(text))
        names = list(toxic.keys() | clean.keys())
        yield pa.record_batch({"token": pa.array(names, pa.string()), "a": pa.array([toxic[w] for w in names], pa.int64()), "b": pa.array([clean[w] for w in names], pa.int64())})


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Model:
    """A model from at most about `rows` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id"), F.col("toxic")).where((fold() != 0) & F.col("toxic").isNotNull())
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rows / n * 1_000_000))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")  # known: at most `rows` rows
    counts = saved(train.mapInArrow(_counts, "token string, a long, b long").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "toxic-counts")
    na, nb = counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    model = Model()
    if not na or not nb:
        share = known.agg(F.avg("toxic")).first()[0] or 0.0
        model.offset = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return model
    mass = PRIOR * (na + nb)
    prior = (F.col("a") + F.col("b")) * (mass / (na + nb))
    ya, yb = F.col("a") + prior, F.col("b") + prior
    odds = F.log(ya / (na + mass - ya)) - F.log(yb / (nb + mass - yb))
    strong = counts.select("token", "a", "b", odds.alias("s"), (odds / F.sqrt(1 / ya + 1 / yb)).alias("z")).where(F.col("z") >= Z)
    top = strong.select("token", "s", "a", "b").collect()  # tokens of at most about `rows` texts that stand out
    model.scores = {r["token"]: float(r["s"]) for r in top}
    ra, rb = (min(0.5, (sum(r[c] for r in top) + 0.5) / (n_ + 1)) for c, n_ in (("a", na), ("b", nb)))
    model.other = min(-1e-4, math.log((1 - ra) / (1 - rb)) - 0.02)
    background = [((r["b"] + 0.5) / (nb + 1), model.scores[r["token"]]) for r in top]
    model.rate = _scale(background, model.other)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            x = [shared.value.excess(*shared.value.segments(t)) for t in b["text"].to_pylist()]
            yield pa.record_batch({"x": pa.array(x, pa.float64()), "y": b["toxic"].cast(pa.int64())})

    seen = np.array([(r["x"], r["y"]) for r in train.mapInArrow(measure, "x double, y long").collect()])  # at most about `rows` pairs
    model.offset, model.slope = _logistic(seen[:, 0], seen[:, 1])
    return model


def _scale(background: list[tuple[float, float]], other: float) -> float:
    """The positive root of E[exp(rate * score)] = 1 under the background."""
    rest = 1 - sum(p for p, _ in background)
    value = lambda x: rest * math.exp(x * other) + sum(p * math.exp(min(700.0, x * s)) for p, s in background) - 1
    low, high = 1e-6, 1e-6
    while value(high) < 0 and high < 50:
        low, high = high, high * 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(0.05, min(20.0, low))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a little shrinkage."""
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (p - y) + 0.01 * w
        h = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), spans: bool = False, names: tuple[str, str, str] = ("score", "n_passages", "passages")) -> DataFrame:
    """keep, score, number of passages and, if asked for, the passages as token ranges with scores. Map only, whole texts."""
    text = free_name([*keep, *names], "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = f"`{names[0]}` double, `{names[1]}` int" + (f", `{names[2]}` array<struct<first:int,end:int,score:double>>" if spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in portions(batches, text):
            p, k, s = [], [], []
            for t in b[text].to_pylist():
                n, found = m.segments(t)
                good = [x for x in found if m.rate * x[2] > math.log(max(n, 1))]
                p.append(m.probability(n, found))
                k.append(len(good))
                s.append([{"first": x[0], "end": x[1], "score": x[2]} for x in good])
            cols = [*[b[c] for c in keep], pa.array(p, pa.float64()), pa.array(k, pa.int32())]
            if spans:
                cols.append(pa.array(s, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
            yield pa.record_batch(cols, names=[*keep, *names[: 2 + spans]])

    return quoted(docs.withColumn(text, F.col("text")), *keep, text).mapInArrow(run, f"{typed(docs, *keep)}, {extra}")
