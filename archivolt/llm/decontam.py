"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) of all documents and the benchmark items form a TF-IDF matrix over the items' vocabulary.
Its leading right singular vectors come from a randomised range finder: one pass gathers document frequencies, one the
product A'(A Omega), whose Nystroem form gives the vectors; both are sums over partitions. A third pass projects every
window of every document, takes items whose cosine is at least `cosine` as candidates, and checks each on the words
themselves: the longest common subsequence with the item must cover `coverage` of it, and `answers` of its rarest words
(the answer-bearing ones) must be there. Items that are long against a window, or much reworded, may stay below that
cosine: the same pass counts the rarest words in stretches of twice the size that a check looks at, and checks every window
where enough of them stand. As the check asks for those words, none that would pass it is missed, whatever its cosine.

Edge cases: null and empty texts contain nothing; items without words match nothing; of repeated items each is reported;
repeated rows are reported alike (an id once, with its best match; ties go to the larger cosine); rows with a null id are
reported together under null; very long texts and items are read whole; items are worked on in blocks of ITEMS, so what is
broadcast is bounded; without items or documents the result is empty; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import portions
from .words import word_hashes

ITEMS = 2000
WINDOW, STRIDE = 32, 16
RANK = 64
FLOOR, KEPT = 4.5, 5


class Space:
    """Vocabulary, weights and latent vectors of a block of items."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        h, row = word_hashes(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(h)
        at = np.searchsorted(self.vocabulary, h)
        self.items = [(i, at[row == k]) for k, i in enumerate(ids)]
        self.items = [(i, w) for i, w in self.items if len(w)]
        self.idf = np.ones(len(self.vocabulary))
        self.vectors = np.zeros((len(self.vocabulary), 1))

    def terms(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of the vocabulary in a batch: term, place among all words; and each row's first word and end."""
        h, row = word_hashes(column)
        ends = np.cumsum(np.bincount(row, minlength=len(column)))
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        place = np.flatnonzero(self.vocabulary[at] == h)
        return at[place], place, np.concatenate([[0], ends[:-1]]), ends

    def finish(self, product: np.ndarray, omega: np.ndarray, rank: int, answers: float) -> None:
        """Latent vectors from Y = A'A Omega (Nystroem): A'A is about Y (Omega'Y)^-1 Y'."""
        # The items' own part of A'A Omega: a sum over each item's words, added to each of them.
        words = np.concatenate([w for _, w in self.items])
        sizes = np.array([len(w) for _, w in self.items])
        weighted = omega[words] * self.idf[words, None]
        sums = np.add.reduceat(weighted, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        y = product.copy()
        np.add.at(y, words, np.repeat(sums, sizes, axis=0) * self.idf[words, None])
        shift = 1e-8 * np.linalg.norm(y)
        y = y + shift * omega
        core = omega.T @ y
        val, vec = np.linalg.eigh((core + core.T) / 2)
        good = val > 1e-10 * val.max(initial=1e-30)
        b = y @ (vec[:, good] / np.sqrt(val[good]))
        u, s, _ = np.linalg.svd(b, full_matrices=False)
        self.vectors = (u[:, :rank] * self.idf[:, None]).astype(np.float64)
        latent = np.stack([self.vectors[w].sum(axis=0) for _, w in self.items])
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        self.masks, self.rare = [], []
        for _, w in self.items:
            bits: dict[int, int] = {}
            for i, t in enumerate(w.tolist()):
                bits[t] = bits.get(t, 0) | 1 << i
            self.masks.append(bits)
            own_terms = np.unique(w)
            self.rare.append(set(own_terms[np.argsort(-self.idf[own_terms], kind="stable")][: max(1, len(own_terms) // 4)].tolist()))
        # Words that a check asks for: the rarest, or any where no rare one is asked for.
        self.sought = self.rare if answers > 0 else [set(w.tolist()) for _, w in self.items]
        self.stretches = [(size, *self._postings([k for k, (_, w) in enumerate(self.items) if _stretch(len(w)) == size])) for size in sorted({_stretch(len(w)) for _, w in self.items})]

    def _postings(self, items: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's items begin in the list, and the list: the items for which the term is sought."""
        pairs = np.array(sorted((term, k) for k in items for term in self.sought[k]), np.int64).reshape(-1, 2)
        return np.searchsorted(pairs[:, 0], np.arange(len(self.vocabulary) + 1)), pairs[:, 1]


def _stretch(length: int) -> int:
    """A power of two that holds all words looked at around a window for an item of that length."""
    return 1 << (2 * length + WINDOW - 1).bit_length()


def common_subsequence(bits: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel. bits: per term, its places in the item."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = bits.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _windows(begin: np.ndarray, end: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of the windows of each row; the last may be short, and every row with words has one."""
    n = np.where(end > begin, 1 + np.maximum(0, -(-(end - begin - WINDOW) // stride)), 0)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = begin[row] + k * stride
    return row, first, np.minimum(first + WINDOW, end[row])


def _frequencies(space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        df, total = np.zeros(len(s.vocabulary), np.int64), 0
        for b in portions(batches, "text"):
            t, place, begin, end = s.terms(b["text"])
            _, first, _ = _windows(begin, end, WINDOW)
            seen = np.unique((np.searchsorted(first, place, "right") - 1) * len(df) + t)
            df += np.bincount(seen % len(df), minlength=len(df))
            total += len(first)
        yield pa.record_batch({"term": np.arange(-1, len(df)), "n": np.concatenate([[total], df])})

    return run


def _product(space, omega):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, om = space.value, omega.value
        weighted = om * s.idf[:, None]
        y = np.zeros_like(om)
        for b in portions(batches, "text", 1_000_000):
            t, place, begin, end = s.terms(b["text"])
            good = s.idf[t] > 0
            t, place = t[good], place[good]
            if not len(t):
                continue
            _, first, _ = _windows(begin, end, WINDOW)
            w = np.searchsorted(first, place, "right") - 1
            z = np.zeros((len(first), om.shape[1]))
            starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            z[w[starts]] = np.add.reduceat(weighted[t], starts, axis=0)
            order = np.argsort(t, kind="stable")
            ts = t[order]
            starts = np.flatnonzero(np.concatenate([[True], ts[1:] != ts[:-1]]))
            y[ts[starts]] += np.add.reduceat(z[w[order]], starts, axis=0) * s.idf[ts[starts]][:, None]
        kept = np.flatnonzero(np.abs(y).sum(axis=1) > 0)
        yield pa.record_batch({"term": kept, "y": pa.array(list(y[kept]), pa.list_(pa.float64()))})

    return run


def _crowded(s: Space, t: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray, answers: float) -> Iterator[tuple[int, int, int, int]]:
    """Row, item, first and last window (counted in the row) of the stretches with `answers` of the item's rarest words."""
    need = np.array([answers * len(r) for r in s.rare])
    for size, ptr, listed in s.stretches:
        known = np.flatnonzero(ptr[t + 1] > ptr[t])
        if not len(known):
            continue
        term, at = t[known], place[known]
        row = np.searchsorted(end, at, "right")
        off = np.concatenate([[0], np.cumsum(-(-(end - begin) // size))])
        block = off[row] + (at - begin[row]) // size
        inner = block > off[row]  # a stretch is two blocks: each word stands in its own and in the one before
        seen = np.unique(np.concatenate([block, block[inner] - 1]) * len(s.vocabulary) + np.concatenate([term, term[inner]]))
        block, term = seen // len(s.vocabulary), seen % len(s.vocabulary)
        many = ptr[term + 1] - ptr[term]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pair, n = np.unique(np.repeat(block, many) * len(s.items) + listed[np.repeat(ptr[term], many) + nth], return_counts=True)
        for block, k in zip(*np.divmod(pair[n >= need[pair % len(s.items)]], len(s.items)), strict=True):
            r = int(np.searchsorted(off, block, "right")) - 1
            length, b = len(s.items[k][1]), int(block - off[r])
            # Windows whose looked-at words begin in the stretch's first half, so that all of them lie in it.
            yield r, int(k), -(-(b * size + length) // STRIDE) if b else 0, ((b + 1) * size - 1 + length) // STRIDE


def _search(space, cosine: float, coverage: float, answers: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in portions(batches, "text", 1_000_000):
            t, place, begin, end = s.terms(b["text"])
            row, first, last = _windows(begin, end, STRIDE)
            told = np.flatnonzero(s.idf[t] > 0)
            total = np.concatenate([np.zeros((1, s.vectors.shape[1])), np.cumsum(s.vectors[t[told]], axis=0)])
            x = total[np.searchsorted(place[told], last)] - total[np.searchsorted(place[told], first)]
            norm = np.linalg.norm(x, axis=1)
            found: dict[tuple[int, int], tuple[float, int, float]] = {}
            edge = np.concatenate([[True], row[1:] != row[:-1], [True]])
            for lo in range(0, len(first), 8192):
                hi = min(lo + 8192, len(first))
                wide = slice(max(lo - 1, 0), hi + 1)
                cos = (x[wide] / np.maximum(norm[wide], 1e-9)[:, None]) @ s.latent.T
                cos = np.concatenate([np.full((1 - min(lo, 1), cos.shape[1]), -1.0), cos, np.full((int(hi == len(first)), cos.shape[1]), -1.0)])
                mid = cos[1:-1]
                # Neighbouring windows see the same words: the check looks beyond a window, so its local peaks will do.
                peak = (mid >= cosine) & ((mid >= cos[:-2]) | edge[lo:hi, None]) & ((mid > cos[2:]) | edge[lo + 1 : hi + 1, None])
                for i, k in zip(*np.nonzero(peak), strict=True):
                    w = lo + i
                    item, words = s.items[k]
                    length, r = len(words), int(row[w])
                    a = max(int(begin[r]), int(first[w]) - length)
                    z = min(int(end[r]), int(last[w]) + length)
                    near = t[np.searchsorted(place, a) : np.searchsorted(place, z)].tolist()
                    if len(s.rare[k].intersection(near)) < answers * len(s.rare[k]):
                        continue
                    lcs = common_subsequence(s.masks[k], length, near)
                    if lcs >= coverage * length and (lcs, mid[i, k]) > found.get((r, item), (0, 0.0))[:2]:
                        found[r, item] = (lcs, float(mid[i, k]), lcs / length)
            windows = np.searchsorted(row, np.arange(len(begin) + 1))
            for r, k, lo, hi in _crowded(s, t, place, begin, end, answers):
                own = np.arange(windows[r] + lo, min(windows[r] + hi + 1, windows[r + 1]))
                if not len(own):
                    continue
                item, words = s.items[k]
                length = len(words)
                a, z = np.maximum(begin[r], first[own] - length), np.minimum(end[r], last[own] + length)
                a, z = np.searchsorted(place, a), np.searchsorted(place, z)
                most = common_subsequence(s.masks[k], length, t[a[0] : z[-1]].tolist())
                if most < coverage * length:
                    continue
                cos = (x[own] / np.maximum(norm[own], 1e-9)[:, None]) @ s.latent[k]
                for i in np.argsort(-cos, kind="stable"):
                    near = t[a[i] : z[i]].tolist()
                    if len(s.rare[k].intersection(near)) < answers * len(s.rare[k]):
                        continue
                    lcs = common_subsequence(s.masks[k], length, near)
                    if lcs >= coverage * length and (lcs, cos[i]) > found.get((r, item), (0, 0.0))[:2]:
                        found[r, item] = (lcs, float(cos[i]), lcs / length)
                    if lcs == most:  # no other window here has more
                        break
            ids = b["doc_id"].to_pylist()
            keys = [(ids[r], item, *v) for (r, item), v in sorted(found.items())]
            yield pa.record_batch([pa.array([k[c] for k in keys], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "lcs", "cosine", "coverage"])

    return run


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    cosine: float = 0.55,
    coverage: float = 0.6,
    answers: float = 0.6,
    rank: int = RANK,
    seed: int = 7,
) -> DataFrame:
    """doc_id, item_id, lcs, cosine, coverage: one row per document and item found in it."""
    spark: SparkSession = docs.sparkSession
    sc = spark.sparkContext
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    n = bench.count()
    parts = -(-n // ITEMS)
    out = spark.createDataFrame([], "doc_id long, item_id long, lcs long, cosine double, coverage double")
    for part in range(parts):
        own = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id").collect()  # about ITEMS rows
        space = Space([r["item_id"] for r in own], [r["text"] for r in own])
        if not space.items:
            continue
        shared = sc.broadcast(space)
        df = source.mapInArrow(_frequencies(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
        counts = {r["term"]: r["n"] for r in df}
        space.idf = np.log((1 + counts.get(-1, 0) + len(space.items)) / (1 + np.array([counts.get(k, 0) for k in range(len(space.vocabulary))])))
        # Words of over a hundredth of all passages hardly tell one item from another; each item keeps its rarest ones.
        told = space.idf >= FLOOR
        for _, w in space.items:
            own_terms = np.unique(w)
            told[own_terms[np.argsort(-space.idf[own_terms], kind="stable")[:KEPT]]] = True
        space.idf = np.where(told, space.idf, 0.0)
        omega = np.random.default_rng(seed).standard_normal((len(space.vocabulary), rank + 8))
        weighted, noise = sc.broadcast(space), sc.broadcast(omega)
        sums = source.mapInArrow(_product(weighted, noise), "term long, y array<double>").groupBy("term").agg(F.array(*[F.sum(F.col("y")[i]) for i in range(rank + 8)]).alias("y")).collect()  # a row a term
        product = np.zeros_like(omega)
        for r in sums:
            product[r["term"]] = r["y"]
        space.finish(product, omega, rank, answers)
        out = out.unionByName(source.mapInArrow(_search(sc.broadcast(space), cosine, coverage, answers), out.schema))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "cosine", "coverage")).alias("m")).select("doc_id", "item_id", "m.lcs", "m.cosine", "m.coverage")
