"""Approximate nearest neighbours with a forest of random-projection trees.

The trees split at medians of a bounded sample (about SAMPLE different vectors, by hash), each node along one direction of a
shared pool, so the forest holds POOL directions and two numbers a node, whatever the table's size. Every row is filed under
one leaf of each tree. A query walks all trees through one priority queue, ordered by the squared distances to the cells' far
sides, until the leaves that it took hold enough rows. How many are enough is measured: about PILOT queries, by hash, are
compared with all rows, and the budget is what finds the share `recall` of their true neighbours. Candidates meet their queries
leaf by leaf, in blocks of bounded size, and are ranked by the exact cosine.

Equal vectors are one row of the forest with its least k + 1 ids, which is all that a list of k can show of it; equal query
vectors search once. So large groups of copies cost a row.

Edge cases: null and zero vectors, vectors with null or non-finite components and rows without an id take no part; shorter
vectors count as padded with 0; rows that repeat both id and vector are candidates as often as they stand there; where rows of
a query's id differ, the least vector asks; a query never meets rows of its own id; ties go to the smaller id; queries whose
leaves held less than k candidates look at all rows; an empty table or no query gives an empty result; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import whole
from .util import input_columns, saved

SAMPLE = 16_384
POOL = 256
PILOT = 128
LEAF = 64
BUNDLES = 16
ROWS = 32_768
ASKING = 8_192


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, scaled by powers of two so that no square overflows; the cosine stays the same."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0.0))[1][:, None])


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.multiply(m, m).sum(axis=1))


@dataclass
class Forest:
    """pool: dimension x POOL. Per tree, in heap order: the direction and the median of each inner node."""

    pool: np.ndarray
    along: np.ndarray
    median: np.ndarray
    depth: int

    @classmethod
    def fitted(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        pool = rng.standard_normal((sample.shape[1], POOL))
        pool /= np.linalg.norm(pool, axis=0)
        along, median = rng.integers(0, POOL, (trees, 2**depth - 1)), np.zeros((trees, 2**depth - 1))
        projected = sample @ pool
        for t in range(trees):
            groups = [np.arange(len(sample))]
            for node in range(2**depth - 1):
                rows = groups[node]
                x = projected[rows, along[t, node]]
                median[t, node] = np.median(x) if len(x) else 0.0
                groups += [rows[x <= median[t, node]], rows[x > median[t, node]]]
        return cls(pool, along, median, depth)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        x = unit @ self.pool
        out = np.zeros((len(unit), len(self.along)), np.int32)
        at = np.arange(len(unit))
        for t in range(len(self.along)):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, self.along[t, node]] > self.median[t, node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def walk(self, x: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(tree, leaf, rows) in the order of the shared queue. x: the query's projections."""
        inner = 2**self.depth - 1
        margin = (x[self.along] - self.median).tolist()
        queue = [(0.0, t, 0) for t in range(len(margin))]
        while queue:
            far, t, node = heapq.heappop(queue)
            while node < inner:  # the near side costs nothing more
                m = margin[t][node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(queue, (far + m * m, t, 4 * node + 3 - near))
                node = near
            yield t, node - inner, int(sizes[t, node - inner])


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(_norms(m), 1e-300)[:, None]


def points(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(e, ids, copies): different vectors with their least k + 1 ids, and (vec_id, e): usable rows."""
    rows = input_columns(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & whole(F.col("e")) & F.exists("e", lambda x: x != 0))
    dim = rows.agg(F.max(F.size("e"))).first()[0] or 0
    zero = F.lit(0).cast(rows.schema["e"].dataType.elementType)
    rows = rows.select("vec_id", F.concat("e", F.array_repeat(zero, F.lit(dim) - F.size("e"))).alias("e"))
    one = rows.groupBy("e", "vec_id").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))
    few = one.withColumn("at", at).where(F.col("at") <= k + 1).groupBy("e").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("of"))
    return few.select("e", F.transform("of", lambda x: x["vec_id"]).alias("ids"), F.transform("of", lambda x: x["n"]).alias("copies")), rows


def indexed(rows: DataFrame, forest: Forest) -> DataFrame:
    """The points with the leaf of each tree."""
    held = rows.sparkSession.sparkContext.broadcast(forest)  # POOL directions and at most 2 SAMPLE / 8 numbers a tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = held.value.leaves(_units(_matrix(b["e"])))
            lists = pa.ListArray.from_arrays(np.arange(0, leaf.size + 1, leaf.shape[1], dtype=np.int32), leaf.ravel())
            yield pa.record_batch([*b.columns, lists], names=[*b.schema.names, "leaves"])

    kind = rows.schema["e"].dataType.simpleString()
    return rows.select("e", "ids", "copies").mapInArrow(run, f"e {kind}, ids array<long>, copies array<long>, leaves array<int>")


def budget(asked: DataFrame, index: DataFrame, forest: Forest, sizes: np.ndarray, many: int, k: int, recall: float) -> int:
    """Rows whose leaves hold the share `recall` of the true neighbours of about PILOT queries."""
    pilot = asked.where(F.pmod(F.xxhash64("asker"), F.lit(max(1, many // PILOT))) == 0).select("asker", "e").toArrow()  # about PILOT rows
    if not pilot.num_rows:
        return int(sizes.sum())
    askers, q = pilot["asker"].to_numpy(), _units(_matrix(pilot["e"].combine_chunks()))
    held = index.sparkSession.sparkContext.broadcast((askers, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked_ = held.value
        for b in batches:
            score = asked_ @ _units(_matrix(b["e"])).T
            top = np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, : k + 1]
            flat = top.ravel()
            yield pa.record_batch([np.repeat(names, top.shape[1]), np.take_along_axis(score, top, 1).ravel(), b["leaves"].take(flat)], names=["asker", "score", "leaves"])

    best = Window.partitionBy("asker").orderBy(F.desc("score"), "leaves")
    near = index.select("e", "leaves").mapInArrow(run, "asker long, score double, leaves array<int>").withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    true = near.groupBy("asker").agg(F.collect_list("leaves").alias("l")).collect()  # PILOT lists of k + 1
    at = {a: i for i, a in enumerate(askers.tolist())}
    needs = []
    for r in true:
        left, seen = [set(enumerate(x)) for x in r["l"]], 0
        for t, leaf, n in forest.walk(q[at[r["asker"]]] @ forest.pool, sizes):
            seen += n
            found = [x for x in left if (t, leaf) in x]
            needs += [seen] * len(found)
            left = [x for x in left if (t, leaf) not in x]
            if not left:
                break
    needs.sort()
    return needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))))]


def visits(asked: DataFrame, forest: Forest, sizes: np.ndarray, enough: int, least: int, shift: int) -> DataFrame:
    """(asker, e, tree, bundle, leaves): where each query looks; a bundle is a subtree."""
    held = asked.sparkSession.sparkContext.broadcast((forest, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, many = held.value
        for b in batches:
            x = _units(_matrix(b["e"])) @ trees.pool
            rows, where, lists = [], [], []
            for i in range(b.num_rows):
                got: dict[tuple[int, int], list[int]] = {}
                seen, by_tree = 0, [0] * len(many)
                for t, leaf, n in trees.walk(x[i], many):
                    got.setdefault((t, leaf >> shift), []).append(leaf)
                    seen, by_tree[t] = seen + n, by_tree[t] + n
                    if seen >= enough and max(by_tree) >= least:
                        break
                rows += [i] * len(got)
                where += got
                lists += got.values()
                if len(rows) > 4096 or i + 1 == b.num_rows:
                    to = np.array(where, np.int32).reshape(-1, 2)
                    yield pa.record_batch([b["asker"].take(pa.array(rows)), b["e"].take(pa.array(rows)), to[:, 0], to[:, 1], pa.array(lists, pa.list_(pa.int32()))], names=["asker", "e", "tree", "bundle", "leaves"])
                    rows, where, lists = [], [], []

    return asked.select("asker", "e").mapInArrow(run, f"asker long, e {asked.schema['e'].dataType.simpleString()}, tree int, bundle int, leaves array<int>")


def _meet(k: int):
    def best(q: np.ndarray, asker: np.ndarray, score: np.ndarray, row: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Positions of each query's k + 1 best rows, ties to the smaller id."""
        order = np.lexsort((least[row], -score, q))
        first = np.searchsorted(q[order], q[order], side="left")
        return order[np.arange(len(order)) - first <= k]

    def run(rows: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asking.num_rows:
            m, qs = _matrix(rows["e"].combine_chunks()), _matrix(asking["e"].combine_chunks())
            nm, nq = _norms(m), _norms(qs)
            um, uq = m / nm[:, None], qs / nq[:, None]
            ids = rows["ids"].combine_chunks()
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            least = flat[offsets[:-1]]
            alone = np.diff(offsets) == 1
            name = asking["asker"].to_numpy()
            leaf = rows["leaf"].to_numpy()
            by_leaf = np.argsort(leaf, kind="stable")
            lists = asking["leaves"].combine_chunks()
            who, want = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            order = np.argsort(want, kind="stable")
            who, want = who[order], want[order]
            q, r, s = [], [], []
            for x in np.unique(want):
                here = by_leaf[np.searchsorted(leaf[by_leaf], x, "left") : np.searchsorted(leaf[by_leaf], x, "right")]
                for some in np.array_split(own := who[np.searchsorted(want, x, "left") : np.searchsorted(want, x, "right")], -(-len(own) * max(1, len(here)) // 4_000_000) or 1):
                    if not len(here) or not len(some):
                        continue
                    score = uq[some] @ um[here].T
                    score[alone[here] & (least[here] == name[some][:, None])] = -np.inf
                    if len(here) > k + 1:
                        cut = -np.partition(-score, k, axis=1)[:, k] - 1e-9
                        a, b = np.nonzero(score >= cut[:, None])
                    else:
                        a, b = np.indices(score.shape).reshape(2, -1)
                    real = score[a, b] > -np.inf
                    a, b = some[a[real]], here[b[real]]
                    exact = np.multiply(qs[a], m[b]).sum(axis=1) / (nq[a] * nm[b])
                    keep = best(a, a, exact, b, least)
                    q, r, s = [*q, a[keep]], [*r, b[keep]], [*s, exact[keep]]
            if q:
                q, r, s = np.concatenate(q), np.concatenate(r), np.concatenate(s)
                keep = best(q, q, s, r, least)
                q, r, s = q[keep], r[keep], s[keep]
                n = np.diff(offsets)[r]
                at = np.repeat(offsets[r] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                out = [np.repeat(name[q], n), flat[at], rows["copies"].combine_chunks().values.to_numpy()[at], np.repeat(s, n)]
        return pa.table(dict(zip(("asker", "vec_id", "copies", "score"), out or [pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], strict=True)))

    return run


def met(index: DataFrame, looks: DataFrame, shift: int, k: int) -> DataFrame:
    """(asker, vec_id, copies, score): the k + 1 best vectors of each query in each bundle that it visits.

    Bundles with many rows or many queries go in blocks by hash, each pair of blocks once.
    """
    one = index.select("e", "ids", "copies", F.posexplode("leaves").alias("tree", "leaf")).withColumn("bundle", F.shiftright("leaf", shift))
    size = lambda df, most: df.groupBy("tree", "bundle").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    parts = F.broadcast(size(one, ROWS).withColumnRenamed("parts", "rp").join(size(looks, ASKING).withColumnRenamed("parts", "qp"), ["tree", "bundle"]))  # a row a bundle
    own = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rows = one.join(parts, ["tree", "bundle"]).withColumn("rb", own("e", "rp")).withColumn("qb", every("qp"))
    asking = looks.join(parts, ["tree", "bundle"]).withColumn("qb", own("asker", "qp")).withColumn("rb", every("rp"))
    keys = ["tree", "bundle", "rb", "qb"]
    got = rows.select(*keys, "leaf", "e", "ids", "copies").groupBy(*keys).cogroup(asking.select(*keys, "leaves", "asker", "e").groupBy(*keys))
    return got.applyInArrow(_meet(k), "asker long, vec_id long, copies long, score double")


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 50, k: int = 5, trees: int = 8, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score (cosine). recall: the share of true neighbours that the budget is measured for."""
    few, rows = points(vectors, id_col, vector_col, k)
    few = saved(few, "forest-points")
    asked = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("e").alias("e"), F.max("e").alias("other"))
    asked = saved(asked.select("vec_id", "e", F.when(F.col("other") != F.col("e"), F.col("vec_id")).alias("own")), "forest-asked")
    once = saved(asked.groupBy("e", "own").agg(F.min("vec_id").alias("asker")), "forest-once")  # ids of several vectors search by themselves
    n, many = few.count(), once.count()
    if not n or not many:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = few.where(F.pmod(F.xxhash64("e"), F.lit(max(1, n // SAMPLE))) == 0).select("e").toArrow()  # about SAMPLE rows, twice at most
    depth = int(np.clip(np.round(np.log2(max(n / LEAF, 2))), 1, np.log2(SAMPLE / 8)))
    base = sample if sample.num_rows else few.select("e").limit(1).toArrow()
    forest = Forest.fitted(_units(_matrix(base["e"].combine_chunks())), trees, depth)
    index = saved(indexed(few, forest), "forest-index")
    sizes = np.zeros((trees, 2**depth), np.int64)
    for r in index.select(F.posexplode("leaves").alias("t", "leaf")).groupBy("t", "leaf").count().collect():  # a row for each leaf
        sizes[r["t"], r["leaf"]] = r["count"]
    shift = max(0, depth - int(np.log2(BUNDLES)))
    enough = budget(once, index, forest, sizes, many, k, recall)
    found = saved(met(index, saved(visits(once, forest, sizes, enough, k + 1, shift), "forest-visits"), shift, k), "forest-found")

    def ranked(found: DataFrame) -> DataFrame:
        lists = found.groupBy("asker", "vec_id").agg(F.max("score").alias("score"), F.max("copies").alias("copies"))
        at = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
        lists = lists.withColumn("at", at).where(F.col("at") <= k + 1).groupBy("asker").agg(F.collect_list(F.struct("score", "vec_id", "copies")).alias("of"))  # k + 1 at most
        whose = asked.join(once, (asked["e"] == once["e"]) & asked["own"].eqNullSafe(once["own"])).select(F.col("vec_id").alias("query_id"), "asker")
        each = whose.join(lists, "asker").select("query_id", F.explode("of").alias("x")).where("x.vec_id <> query_id")
        each = each.select("query_id", "x.vec_id", "x.score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("x.copies", F.lit(k)))).alias("copy"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = saved(ranked(found), "forest-lists")
    done = out.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = asked.where("own IS NOT NULL").join(done, asked["vec_id"] == done["query_id"], "left_anti")
    if enough < sizes.sum() and short.limit(1).count():
        # Rows of one id with different vectors can fill the leaves of its query; such queries look everywhere.
        all_ = visits(once.join(short.select(F.col("vec_id").alias("asker")), "asker", "left_semi"), forest, sizes, int(sizes.sum()), n, shift)
        again = ranked(met(index, saved(all_, "forest-visits"), shift, k)).join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
        out = out.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return out
