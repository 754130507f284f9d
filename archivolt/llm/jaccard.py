"""N-gram Jaccard self-join by chosen paths.

Texts are sets of word shingles. In each of RUNS runs a set chooses about 1 / similarity of its shingles by a hash that
all sets share, so similar sets choose alike; each chosen shingle is a bucket. Buckets of at most `limit` sets are compared
by brute force; larger ones split again on further shared choices whose buckets are large too (a path), and so on: sets that
share a smaller bucket meet there already. The number of runs follows from the target recall. Every link is checked on the whole sets, and the links within a class are counted over all its pairs.

What keeps large groups of near copies linear:
- each large bucket first compares its sets with one of them (its pivot), so that groups of near copies get one label;
- a large bucket, or what is left of one at the last depth, is compared in blocks of BLOCK sets by a grouped job that
  returns a spanning forest; sets of the bucket's most frequent label are its core and are compared with the others only;
- sets that meet in large buckets with most of their choices are compared in each of their TOPS largest, and path buckets
  whose sets all share one of those, or one label, are done with;
- in a class of more than BLOCK sets, those within half the distance (1 - similarity) / 2 of one centre are all linked
  with one another (the Jaccard distance is a metric), and only the others are compared with the whole class, in blocks.

Texts with the same set are one class member with a number of copies, so copies are never paired with each other.

Edge cases: every row is a document, whatever its id; rows with a null id take part and count as links, and a class without
any id has the class_id null; null texts and texts without a word have no shingles, link to nothing and are classes of
their own; texts of fewer words than the width have one shingle; very long texts are sets like others; links do not depend
on order, so there are no ties; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import portions, saved, scratch
from .words import mix, shingles

BLOCK = 512
DEPTH = 6
TOPS = 3
CENTRE = 64


def runs_for(recall: float, similarity: float, choices: float) -> int:
    """Runs so that a pair of that similarity shares no chosen shingle with probability at most 1 - recall.

    The larger of two sets at Jaccard similarity s has at least a share s of its shingles in common with the other.
    """
    return max(1, math.ceil(math.log(1 / (1 - recall)) / (similarity * choices)))


def _choose(width: int, runs: int, choices: float):
    """Of each row: sketch, two sums that name its set, the set's size, its chosen buckets and the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text", 1_000_000):
            x, row, n = shingles(b["text"], width)
            ends = np.concatenate([[0], np.cumsum(n)])
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(x, s), dtype=np.uint64)]) for s in (101, 102)]
            k1, k2 = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            share = np.minimum(choices / np.maximum(n, 1), 1.0)
            bar = np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)[row]
            rows, keys = [], []
            for r in range(runs):
                h = mix(x, 1000 + r)
                at = np.flatnonzero(h <= bar)
                rows.append(row[at])
                keys.append(mix(h[at], 5000 + r))
            rows_all, keys_all = np.concatenate(rows), np.concatenate(keys)
            order = np.argsort(rows_all, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows_all, minlength=len(n)))]).astype(np.int32)
            pool = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys_all[order].view(np.int64)))
            # One bit for each of 64 ranges of hashes: the last bit of the least hash in it (x is sorted within rows).
            span = (x >> np.uint64(58)).astype(np.int64)
            least = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (row[1:] != row[:-1])])) if len(x) else np.zeros(0, np.int64)
            sig = np.zeros(len(n), np.uint64)
            np.bitwise_or.at(sig, row[least], (x[least] & np.uint64(1)) << span[least].astype(np.uint64))
            whole = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.record_batch([b["rid"], b["doc_id"], pa.array(sig.view(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n.astype(np.int32)), pool, whole], names=["rid", "doc_id", "sig", "k1", "k2", "n", "pool", "set"])

    return run


def similar(sets_a: pa.ChunkedArray, sets_b: pa.ChunkedArray, similarity: float) -> np.ndarray:
    """Matrix of which set of a and which of b have at least that Jaccard similarity; exact."""
    parts = [c.combine_chunks() for c in (sets_a, sets_b)]
    flat = [p.flatten().to_numpy() for p in parts]
    sizes = [np.diff(p.offsets.to_numpy()) for p in parts]
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    both = np.intersect1d(flat[0], flat[1])
    common = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    for begin in range(0, len(both), 4096):  # columns in slabs, so memory is bounded
        slab = both[begin : begin + 4096]
        side = []
        for f, r, s in zip(flat, rows, sizes, strict=True):
            at = np.minimum(np.searchsorted(slab, f), len(slab) - 1)
            hit = slab[at] == f
            m = np.zeros((len(s), len(slab)), np.float32)
            m[r[hit], at[hit]] = 1
            side.append(m)
        common += side[0] @ side[1].T
    total = sizes[0][:, None] + sizes[1][None, :] - common
    return (common >= similarity * total - 1e-6) & (common > 0)


def _forest(similarity: float):
    """One group: sets of block x (side 0) against themselves, or against those of block y (side 1).

    Returns edges between labels that turn out to be connected; a label is a node of an edge that is known already.
    """

    def run(table: pa.Table) -> pa.Table:
        side, lab = table["side"].to_numpy(), table["lab"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = a if table["x"][0] == table["y"][0] else b
        if not len(a) or not len(b) or lab.min() == lab.max():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        near = similar(table["set"].take(pa.array(a)), table["set"].take(pa.array(b)), similarity)
        far = np.iinfo(np.int64).max
        new, old = lab.copy(), None
        while old is None or (new != old).any():
            old = new.copy()
            new[a] = np.minimum(new[a], np.where(near, new[b][None, :], far).min(axis=1))
            new[b] = np.minimum(new[b], np.where(near, new[a][:, None], far).min(axis=0))
        moved = np.flatnonzero(new != lab)
        pairs = np.unique(np.stack([new[moved], lab[moved]], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _links(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        side, rep, copies = (table[c].to_numpy() for c in ("side", "rep", "copies"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = table["x"][0] == table["y"][0]
        b = a if same else b
        if not len(a) or not len(b):
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        near = similar(table["set"].take(pa.array(a)), table["set"].take(pa.array(b)), similarity).astype(np.int64)
        if same:
            np.fill_diagonal(near, 0)
            return pa.table({"rep": rep[a], "links": near @ copies[a]})
        return pa.table({"rep": np.concatenate([rep[a], rep[b]]), "links": np.concatenate([near @ copies[b], near.T @ copies[a]])})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of an edge: comp is the least node it is connected with.

    Rounds of taking the least label among the neighbours, then the label's label; each round is a written table.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("least"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
        new = saved(step.join(up, "mid").select("node", "old", F.least("mid", "top").alias("comp")), "cc-labels")
        changed = new.where("old <> comp").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def blocks(rows: DataFrame, *, keep: tuple[str, ...]) -> DataFrame:
    """Deals the rows (key, rep, core, cores, others, ...) of each key into blocks of about BLOCK and repeats them for each
    pair of blocks to compare: others with others and with the core, never the core with itself. A key without others goes.
    """
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = rows.where("others > 0").withColumn("nc", parts("cores")).withColumn("nb", parts("others"))
    mine = dealt.withColumn("blk", F.expr("pmod(xxhash64(rep), IF(core, nc, nb))").cast("int"))
    # Blocks of the core are numbered behind those of the others.
    partners = F.expr("""
        IF(core, transform(sequence(0, nb - 1), o -> named_struct('x', o, 'y', nb + blk, 'side', 1)),
           concat(transform(sequence(0, nb - 1), o -> IF(o < blk, named_struct('x', o, 'y', blk, 'side', 1), named_struct('x', blk, 'y', o, 'side', 0))),
                  IF(nc > 0, transform(sequence(0, greatest(nc, 1) - 1), o -> named_struct('x', blk, 'y', nb + o, 'side', 0)), array())))""")
    return mine.withColumn("p", F.explode(partners)).select("key", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.side").alias("side"), "rep", *keep)


def cored(rows: DataFrame, name: str) -> DataFrame:
    """The rows (key, rep, lab, met, ...) of the keys that hold sets still to compare, with the key's size m, whether a row
    is of its core, the most frequent `met`, and the numbers of core rows and others.

    Rows of one `met` have been compared with one another, or are known to be connected, like rows of one `lab`.
    """
    by = rows.groupBy("key", "met").agg(F.count("*").alias("c"), F.min("lab").alias("l0"), F.max("lab").alias("l1"))
    size = by.groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("cores"), F.max_by("met", F.struct("c", "met")).alias("most"), F.min("l0").alias("l0"), F.max("l1").alias("l1"))
    open_ = size.where("m > cores AND l0 <> l1").select("key", "m", "most", "cores", (F.col("m") - F.col("cores")).alias("others"))
    return rows.join(saved(open_, name), "key").withColumn("core", F.col("met") == F.col("most")).drop("most")


class Join:
    """Sets and thresholds of one run over a table of documents."""

    def __init__(self, sets: DataFrame, similarity: float, limit: int) -> None:
        self.sets, self.similarity, self.limit = sets, similarity, limit
        # The sketch tells unlike sets apart: its bits differ with probability (1 - similarity) / 2 at most.
        differ = 64 * (1 - similarity) / 2
        self.differ = math.ceil(differ + 5.7 * math.sqrt(differ))

    def close(self, x: str, y: str) -> str:
        return f"least({x}.n, {y}.n) >= {self.similarity}D * greatest({x}.n, {y}.n) AND bit_count({x}.sig ^ {y}.sig) <= {self.differ}"

    def exact(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose whole sets are similar."""
        sa, sb = (self.sets.select(F.col("rep").alias(c), F.col("set").alias(f"set{c}")) for c in "ab")
        met = pairs.join(sa, "a").join(sb, "b").withColumn("i", F.expr("size(array_intersect(seta, setb))"))
        return met.where(F.expr(f"i > 0 AND i >= {self.similarity}D * (size(seta) + size(setb) - i) - 1e-6")).select("a", "b")

    def in_blocks(self, rows: DataFrame, name: str) -> DataFrame:
        """Edges between the rows, as of `cored`, of each key, but for pairs of its core."""
        dealt = blocks(rows.join(self.sets, "rep"), keep=("lab", "set"))
        return saved(dealt.groupBy("key", "x", "y").applyInArrow(_forest(self.similarity), "a long, b long").distinct(), name)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def linked(join: Join, reps: DataFrame, live: DataFrame) -> DataFrame | None:
    """(node, comp): the connected components among the sets that have a link; None without any link.

    reps: rep, n, sig, pool. live: the sets in their buckets, as of `cored`.
    """
    leaves, big = [live.where(F.col("m") <= join.limit)], live.where(F.col("m") > join.limit)
    edges: list[DataFrame] = []
    last: list[DataFrame] = []
    tops = None
    if big.limit(1).count():
        # Each large bucket against its pivot.
        pivots = saved(big.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep"), "rep", "n", "sig")).alias("p")), "cp-pivots")
        met = big.alias("x").join(pivots, "key").where(F.expr(f"x.rep <> p.rep AND {join.close('x', 'p')}")).select(F.col("p.rep").alias("a"), F.col("x.rep").alias("b"))
        edges.append(saved(join.exact(saved(met.distinct(), "cp-met")), "cp-edges"))
        big = relabelled(big, edges)

        # Sets that stand in large buckets with most of their choices are compared there.
        stands = big.groupBy("rep", "lab").agg(F.count("*").alias("hot"), F.expr(f"transform(slice(sort_array(collect_list(struct(m, key)), false), 1, {TOPS}), x -> x.key)").alias("tops"))
        tops = saved(stands.join(reps.select("rep", F.size("pool").alias("all")), "rep").where("hot >= 0.5 * all").select("rep", "lab", "tops"), "cp-tops")
        at = tops.select("rep", "lab", F.col("lab").alias("met"), F.explode("tops").alias("key"))
        edges.append(join.in_blocks(cored(at, "cp-dense-size"), "cp-dense"))
        again = relabelled(big.select("rep", "n", "sig", "key"), edges).join(tops.select("rep", F.col("tops")[0].alias("top")), "rep", "left")
        live = saved(cored(again.withColumn("met", F.coalesce("top", "lab")).drop("top"), "cp-size"), "cp-live")
        big = live
    for depth in range(DEPTH + 1):
        # Where few sets are left beside the core, the bucket is done in one go: each row of the core goes out once.
        few = (F.col("others") <= BLOCK) & (F.col("others") <= F.col("cores")) if depth < DEPTH else F.lit(True)
        if depth or tops is not None:
            last.append(big.where(few))
            big = big.where(~few)
        if depth == DEPTH or not big.limit(1).count():
            break
        if not depth:
            # Sets that share any other choice are compared there, whole: in a leaf, in one go, or they are connected already.
            open_ = big.groupBy("rep").agg(F.collect_list("key").alias("pool"))
            pools = saved(open_.join(reps.select("rep", F.size("pool").alias("all")), "rep"), "cp-pools")
        # About 1.5 of all choices a set: enough that paths of similar sets live on, and those of sets that share little die out.
        chosen = F.expr("filter(pool, t -> t <> key AND pmod(xxhash64(key, t), 1000000) < 1500000 / all)")
        paths = big.join(pools, "rep").withColumn("t", F.explode(chosen)).select("rep", "n", "sig", "lab", "met", F.xxhash64("key", "t").alias("key"))
        live = saved(cored(paths, "cp-size"), "cp-live")
        leaves.append(live.where(F.col("m") <= join.limit))
        big = live.where(F.col("m") > join.limit)
    if last:
        edges.append(join.in_blocks(union(last).select("key", "rep", "lab", "core", "cores", "others"), "cp-last"))
    leaf = union(leaves).select("key", "rep", "n", "sig", "lab")
    shared = ""
    if tops is not None:
        leaf = leaf.join(tops.select("rep", "tops"), "rep", "left")
        shared = " AND NOT coalesce(arrays_overlap(x.tops, y.tops), false)"
    met = leaf.alias("x").join(leaf.alias("y"), F.expr(f"x.key = y.key AND x.rep < y.rep AND x.lab <> y.lab AND {join.close('x', 'y')}{shared}"))
    edges.append(saved(join.exact(saved(met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "cp-pairs")), "cp-edges"))
    found = union(edges)
    return components(found) if found.limit(1).count() else None


def relabelled(rows: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """The rows with lab: the least set that their set is known to be connected with."""
    found = union(edges)
    if not found.limit(1).count():
        return rows.withColumn("lab", F.col("rep"))
    return rows.drop("lab").join(components(found).withColumnRenamed("node", "rep"), "rep", "left").withColumn("lab", F.coalesce("comp", "rep")).drop("comp")


def link_counts(join: Join, labelled: DataFrame, copies: DataFrame) -> DataFrame:
    """(rep, links): the documents of other sets at that similarity, for the sets (rep, comp) of all classes."""
    many = saved(labelled.groupBy("comp").agg(F.count("*").alias("many")), "cp-many")
    within = saved(labelled.join(many, "comp").join(copies, "rep").join(join.sets, "rep"), "cp-within")
    # The centre of a large class: the shingles that most of about CENTRE of its sets have. Any set would do.
    drawn = within.where(f"many > {BLOCK} AND pmod(xxhash64(rep, 7), many) < {CENTRE}")
    of = drawn.groupBy("comp").agg(F.count("*").alias("drawn"))
    parts = drawn.select("comp", F.explode("set").alias("t")).groupBy("comp", "t").agg(F.count("*").alias("c"))
    centre = saved(parts.join(of, "comp").where("2 * c > drawn").groupBy("comp").agg(F.collect_list("t").alias("centre")), "cp-centre")
    i, half = F.expr("size(array_intersect(set, centre))"), (1 + join.similarity) / 2
    core = F.coalesce(i >= half * (F.size("set") + F.size("centre") - i), F.lit(False))
    rows = saved(within.join(centre, "comp", "left").withColumn("core", core).select(F.col("comp").alias("key"), "rep", "copies", "core", "set"), "cp-shells")
    sums = saved(rows.groupBy("key").agg(F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("others"), F.sum(F.when(F.col("core"), F.col("copies"))).alias("core_copies")), "cp-sums")
    rows = rows.join(sums, "key")
    counts = blocks(rows, keep=("copies", "set")).groupBy("key", "x", "y").applyInArrow(_links(join.similarity), "rep long, links long")
    inside = rows.where("core").select("rep", (F.col("core_copies") - F.col("copies")).alias("links"))
    return saved(counts.unionByName(inside).groupBy("rep").agg(F.sum("links").alias("links")), "cp-links")


def classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
    width: int = 5,
    recall: float = 0.999999,
    limit: int = 24,
    count_links: bool = True,
) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (other documents at that similarity), n_shingles."""
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    choices = 1 / similarity
    runs = runs_for(recall, similarity, choices)
    with scratch(docs.sparkSession) as drop:
        base = saved(source.mapInArrow(_choose(width, runs, choices), "rid long, doc_id long, sig long, k1 long, k2 long, n int, pool array<long>, set array<int>"), "cp-base")
        same = saved(base.where("n > 0").groupBy("k1", "k2").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "cp-same")
        members = base.select("rid", "doc_id", "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2").join(same, ["k1", "k2"], "left")
        members = saved(members.select("rid", "doc_id", "n", F.coalesce("rep", "rid").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "cp-members")
        one = members.where("rid = rep AND n > 0").select("rep", "copies")
        reps = saved(base.select(F.col("rid").alias("rep"), "n", "sig", "pool").join(one, "rep"), "cp-reps")
        nodes = reps.select("rep", "n", "sig", F.col("rep").alias("lab"), F.col("rep").alias("met"), F.explode("pool").alias("key"))
        live = saved(cored(nodes, "cp-size"), "cp-live")
        # The sets of all that share a bucket; they grow with the input and are never broadcast.
        sets = base.select(F.col("rid").alias("rep"), "set").join(live.select("rep").distinct().hint("merge"), "rep", "left_semi")
        join = Join(saved(sets, "cp-sets"), similarity, limit)
        drop(base)

        labelled = linked(join, reps, live)
        if labelled is None:
            labelled = members.select(F.col("rep").alias("node"), F.col("rep").alias("comp")).limit(0)
        labelled = labelled.withColumnRenamed("node", "rep")
        if count_links:
            counts = link_counts(join, labelled, one)
            labelled = saved(labelled.join(counts, "rep", "left"), "cp-labelled")
        else:
            labelled = labelled.withColumn("links", F.lit(0).cast("long"))
        out = members.join(labelled, "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
        out = saved(out, "cp-out", keep=True)
        least = out.groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size")
        least = saved(least, "cp-least", keep=True)
    return out.join(least, "class", "left").select("doc_id", F.coalesce("least", "doc_id").alias("class_id"), "n_links", "n_shingles")
