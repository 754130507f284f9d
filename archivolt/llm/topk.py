"""Exact top-k inner products with a bit-sliced index.

Rows and queries are dealt into blocks by hash; each pair of a row block and a query block is one group (a stated query
set against all rows, in blocks). A block keeps its attributes as bit slices: slice (d, b) is the bitmap of bit b of
attribute d, quantised to 2^BITS levels. A query adds the slices shifted by the signed digits of its own components with
carry-save bitmap arithmetic; the sum's slices are walked from the most significant downward to the k-th value, and the
rows that the quantisation error leaves open at the boundary are scored exactly.

Edge cases: null vectors and vectors with null or non-finite components, and rows without an id, take no part; components
are not bounded, but vectors whose sums could leave the range of a long (dimension times the largest step squared is 2^62 or
more) raise an error, as no score could be stated; shorter vectors count as padded with 0
(the empty vector scores 0); rows that repeat both id and vector are candidates as often as they stand there; where rows of
a query's id differ, the least vector asks; a query never meets rows of its own id; ties go to the smaller id; an empty
table or no query gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import saved

BITS = 6


def quantised(vector: Column, scale: int) -> Column:
    most = float(1 << 62)  # beyond what top_k takes
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(most)), F.lit(-most))).cast("long"))


def whole(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


class Slices:
    """The bit-sliced index of one block of integer vectors."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.v = vectors
        n, d = vectors.shape
        low = vectors.min(axis=0) if n else np.zeros(d, np.int64)
        reach = int((vectors - low).max(initial=0)) + 1
        self.step = -(-reach // (1 << BITS))
        level = (vectors - low) // self.step
        rest = (vectors - low - self.step * level).astype(np.float64) - (self.step - 1) / 2
        self.error = float(np.sqrt((rest * rest).sum(axis=1)).max(initial=0.0))
        words = -(-n // 64)
        self.t = np.zeros((BITS, 2 * d, words), np.uint64)
        for b in range(BITS):
            packed = np.packbits(((level >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            bits = np.zeros((d, words * 8), np.uint8)
            bits[:, : packed.shape[1]] = packed
            self.t[b, :d] = bits.view(np.uint64)
            self.t[b, d:] = ~self.t[b, :d]  # subtracting a slice is adding its complement, but for a constant
        some = np.zeros(words * 8, np.uint8)
        filled = np.packbits(np.ones(n, np.uint8), bitorder="little")
        some[: len(filled)] = filled
        self.valid = some.view(np.uint64)

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the weighted sum of levels (up to a constant of the query)."""
        d = len(q)
        rest, digits = q.copy(), []
        while rest.any():  # non-adjacent form: few digits, each -1, 0 or 1
            odd = rest & 1
            digit = np.where(odd == 1, 2 - (rest & 3), 0)
            digits.append(np.concatenate([np.flatnonzero(digit == 1), np.flatnonzero(digit == -1) + d]))
            rest = (rest - digit) >> 1
        out, carry, p = [], [], 0
        while p < len(digits) + BITS - 1 or carry:
            stack = [self.t[b, digits[p - b]] for b in range(BITS) if 0 <= p - b < len(digits) and len(digits[p - b])] + carry
            carry, p = [], p + 1
            if not stack:
                out.append(np.zeros_like(self.valid))
                continue
            x = np.concatenate(stack)
            while len(x) > 2:  # full adders, a third of the bitmaps at a time
                t = len(x) // 3
                a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                u = a ^ b
                carry.append((a & b) | (u & c))
                x = np.concatenate([u ^ c, x[3 * t :]])
            if len(x) == 2:
                carry.append((x[:1] & x[1:]))
                x = x[:1] ^ x[1:]
            out.append(x[0])
        return out

    def best(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can be among the k best, with their exact scores. own: rows that do not count."""
        allowed = self.valid.copy()
        for r in own:
            allowed[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        slices = self.sums(q)
        sure, open_rows, kth = np.zeros_like(allowed), allowed, 0
        for p in range(len(slices) - 1, -1, -1):
            hit = sure | (open_rows & slices[p])
            if int(np.bitwise_count(hit).sum()) >= k:
                open_rows, kth = open_rows & slices[p], kth | (1 << p)
            else:
                sure, open_rows = hit, open_rows & ~slices[p]
        norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        if int(np.bitwise_count(allowed).sum()) <= k:
            kth = 0
        least = max(0, int(np.floor(kth - 2 * norm * self.error / self.step - 1e-6 * kth)))
        above, level = np.zeros_like(allowed), allowed
        for p in range(max(len(slices), least.bit_length()) - 1, -1, -1):
            s = slices[p] if p < len(slices) else np.zeros_like(allowed)
            if least >> p & 1:
                level = level & s
            else:
                above, level = above | (level & s), level & ~s
        rows = np.flatnonzero(np.unpackbits((above | level).view(np.uint8), bitorder="little"))
        return rows, self.v[rows] @ q


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table[name].combine_chunks()
    data = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return data.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.int64)


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_r, out_s, out_c = [], [], [], []
        if rows.num_rows and queries.num_rows:
            ids, copies, v = rows["vec_id"].to_numpy(), rows["copies"].to_numpy(), _matrix(rows, "v")
            index, asked = Slices(v), _matrix(queries, "v")
            order = np.argsort(ids, kind="stable")
            for qid, q in zip(queries["vec_id"].to_numpy(), asked, strict=True):
                own = order[np.searchsorted(ids[order], qid, "left") : np.searchsorted(ids[order], qid, "right")]
                found, score = index.best(q, own, k)
                top = np.lexsort((ids[found], -score))[:k]
                out_q.append(np.full(len(top), qid))
                out_r.append(ids[found][top])
                out_s.append(score[top])
                out_c.append(copies[found][top])
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return pa.table({"query_id": cat(out_q), "vec_id": cat(out_r), "score": cat(out_s), "copies": cat(out_c)})

    return run


def top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = 100,
    k: int = 10,
    scale: int = 1024,
    row_block: int = 4096,
    query_block: int = 1024,
    least_blocks: int = 24,
) -> DataFrame:
    """query_id, rank, vec_id, score. row_block and query_block bound what one task holds; blocks are equal by hash."""
    v = F.col(vector_col)
    # Repeated rows are one row of the index with a number of copies; partial counts take hot ones before the shuffle.
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("e")).where(F.col("vec_id").isNotNull() & whole(F.col("e")))
    ints = saved(clean.select("vec_id", quantised(F.col("e"), scale).alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("copies")), "bsi-rows")
    asking = ints.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, dim, reach = ints.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0))).first()
    if dim * reach * reach >= 1 << 62:
        raise ValueError("inner products of these vectors do not fit a long")
    nq = asking.count()
    blocks = max(-(-n // row_block), min(least_blocks, -(-n // 64)), 1)
    query_blocks = max(-(-nq // query_block), 1)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v")))
    spread = F.xxhash64("vec_id", "v")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = ints.select("vec_id", "copies", padded.alias("v"), F.pmod(spread, F.lit(blocks)).cast("int").alias("rb"), every(query_blocks).alias("qb"))
    queries = asking.select("vec_id", padded.alias("v"), F.pmod(spread, F.lit(query_blocks)).cast("int").alias("qb"), every(blocks).alias("rb"))
    found = rows.groupBy("rb", "qb").cogroup(queries.groupBy("rb", "qb")).applyInArrow(_search(k), "query_id long, vec_id long, score long, copies long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies"), F.lit(k)))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
