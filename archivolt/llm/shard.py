"""K-d tree sharding: split at weighted medians along the widest metadata dimension until leaves reach the target bytes.

Built-in functions only. A level of the tree is a few scans of a compact table (no texts): one finds each node's widest
dimension, the others narrow each node's weighted median by histograms of at most BINS bins a node, so what the driver
sees is bounded by nodes x BINS rows. Rows of equal value are ordered by the text's checksum, so equal texts stay
together; a cut goes through a group of them only where the group holds more than `whole` of a shard's mean bytes, and then
a row hash decides.

A cut misses its place by at most half of what it must not go through: a document, or a group that stays whole. What a cut
misses is shared by the shards below it, so a shard differs from the mean by at most the largest of those and the slack.

Edge cases: a null text has size `overhead` and checksum 0; null metadata counts as the value 0; repeated rows are rows
of their own; very long texts are documents like others; ties in all dimensions are broken by checksum and row hash; with
fewer rows than shards some shards stay empty; an empty table gives an empty result; further columns, whatever their names,
are not read, but for the dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import saved, values

BINS = 512
SLOT_ROWS = 50_000


def code(df: DataFrame, name: str) -> Column:
    """A metadata column as an integer in [0, 2^32): numbers keep their order, other values get a checksum."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(F.least(F.greatest(F.col(name).cast("long"), F.lit(0)), F.lit(2**32 - 1)), F.lit(0))
    return F.coalesce(F.crc32(F.col(name).cast("string")), F.lit(0))


def split_tree(base: DataFrame, dims: int, shards: int, slack: float, whole: float = 0.25) -> DataFrame:
    """base: size, key (array of the dims' codes, then checksum, then row hash). Adds the column `shard`."""
    spark = base.sparkSession
    low, high = (F.array(*[f(F.col("key")[i]) for i in range(dims)]) for f in (F.min, F.max))
    node_rows = saved(base.withColumn("node", F.lit(1).cast("long")), "kd-level")
    first = node_rows.agg(low.alias("lo"), high.alias("hi"), F.sum("size").alias("w")).first()
    if first["w"] is None:
        return node_rows.withColumn("shard", F.lit(0)).drop("node")
    extent = [max(1, b - a) for a, b in zip(first["lo"], first["hi"], strict=True)]
    tolerance, undivided = slack * first["w"] / shards, whole * first["w"] / shards
    leaves, start = {1: shards}, {1: 0}  # node -> shards below it, and the number of its first shard
    while any(n > 1 for n in leaves.values()):
        open_nodes = [n for n, k in leaves.items() if k > 1]
        spread = node_rows.where(F.col("node").isin(open_nodes)).groupBy("node").agg(low.alias("lo"), high.alias("hi"), F.sum("size").alias("w"))
        state = {}
        for r in spread.collect():  # at most one row a node
            widest = max(range(dims), key=lambda i, r=r: ((r["hi"][i] - r["lo"][i]) / extent[i], -i))
            state[r["node"]] = {"stage": widest, "lo": r["lo"][widest], "hi": r["hi"][widest], "need": r["w"] * (leaves[r["node"]] // 2) / leaves[r["node"]], "cut": [], "done": False}
        while any(not s["done"] for s in state.values()):
            todo = {n: s for n, s in state.items() if not s["done"]}
            # The values already fixed by this node's cut are conditions; the current one is binned.
            asked = values(spark, ["node", "stage", "lo", "hi", "f1", "v1", "f2", "v2"], [(n, s["stage"], s["lo"], s["hi"], *[x for c in [*s["cut"], (-1, 0), (-1, 0)][:2] for x in c]) for n, s in todo.items()])
            value = F.expr("key[CAST(stage AS INT)]")
            holds = F.expr("(f1 < 0 OR key[CAST(f1 AS INT)] = v1) AND (f2 < 0 OR key[CAST(f2 AS INT)] = v2)")
            part = node_rows.join(F.broadcast(asked), "node").where(holds).withColumn("v", value).where("v BETWEEN lo AND hi")
            bins = part.groupBy("node", F.expr(f"(v - lo) DIV ((hi - lo) DIV {BINS} + 1)").alias("bin")).agg(F.sum("size").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"))
            got: dict[int, list] = {n: [] for n in todo}
            for r in bins.collect():  # at most nodes x BINS rows
                got[r["node"]].append((r["bin"], r["w"], r["a"], r["b"]))
            for n, s in todo.items():
                _narrow(s, sorted(got[n]), tolerance, undivided, dims)
        cuts = []
        for n in open_nodes:
            k = leaves.pop(n)
            begin = start.pop(n)
            leaves |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
            start |= {2 * n: begin, 2 * n + 1: begin + k // 2}
            c = [*(state[n]["cut"] if n in state else []), (-1, 0), (-1, 0), (-1, 0)][:3]
            cuts.append((n, *[x for y in c for x in y]))
        cut = values(spark, ["node", "d1", "c1", "d2", "c2", "d3", "c3"], cuts)
        at = [F.expr(f"key[CAST(d{i} AS INT)]") for i in (1, 2, 3)]
        left = F.expr("d1 >= 0") & ((at[0] < F.col("c1")) | ((at[0] == F.col("c1")) & (F.col("d2") >= 0) & ((at[1] < F.col("c2")) | ((at[1] == F.col("c2")) & (F.col("d3") >= 0) & (at[2] < F.col("c3"))))))
        moved = node_rows.join(F.broadcast(cut), "node", "left")
        child = F.when(F.col("d1").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1))
        node_rows = saved(moved.select(*[c for c in node_rows.columns if c != "node"], child.alias("node")), "kd-level")
    numbers = values(spark, ["node", "shard"], sorted(start.items()))
    return node_rows.join(F.broadcast(numbers), "node").drop("node")


def _narrow(s: dict, bins: list[tuple], tolerance: float, undivided: float, dims: int) -> None:
    """One step of a node's weighted median: end at a bin's edge if near enough, else go into the bin that holds it."""
    before = 0
    for _, w, a, b in bins:
        if before + w >= s["need"]:
            break
        before += w
    else:
        s["done"] = True
        s["cut"].append((s["stage"], s["hi"] + 1))
        return
    under, over = s["need"] - before, before + w - s["need"]
    last = s["stage"] == dims + 1
    if min(under, over) <= tolerance or (a == b and (last or (s["stage"] == dims and w <= undivided))):
        s["cut"].append((s["stage"], a if under <= over else b + 1))
        s["done"] = True
    elif a == b:  # one value: the next key of the order decides
        s["cut"].append((s["stage"], a))
        s |= {"stage": dims if s["stage"] < dims else dims + 1, "lo": 0, "hi": 2**32 - 1, "need": under}
    else:
        s |= {"lo": a, "hi": b, "need": under}


def shard(
    docs: DataFrame,
    *,
    shards: int | None = None,
    target_bytes: int | None = None,
    dims: Sequence[str] = ("source", "lang", "size"),
    overhead: int = 16,
    slack: float = 0.002,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Give the number of shards, or the bytes that a leaf should reach."""
    text = F.col(text_col)
    sized = docs.withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead)
    crc = F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    lone = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(2**32))
    used = [d for d in dims if d in sized.columns]
    rows_in = saved(
        sized.select(F.col(id_col).alias("doc_id"), "size", crc.alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("same"), F.array(*[code(sized, d) for d in used]).alias("dims"), lone.alias("lone")),
        "kd-rows",
    )
    # Equal texts get one place: the least codes of the group. Partial sums take hot groups before the shuffle, and the
    # written table leaves the join free to split them.
    places = rows_in.groupBy("same").agg(F.count("*").alias("copies"), F.array(*[F.min(F.col("dims")[i]) for i in range(len(used))]).alias("place"))
    places = saved(places.where("copies > 1").drop("copies"), "kd-places")
    key = F.concat(F.coalesce("place", "dims"), F.array(F.col("text_crc32"), F.col("lone")))
    base = saved(rows_in.join(places, "same", "left").select("doc_id", "size", "text_crc32", key.alias("key")), "kd-base")
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if shards is None:
        shards = max(1, -(-total // (target_bytes or 2**30)))
    split = split_tree(base, len(used), shards, slack)
    return with_slots(split, shards, rows)


def with_slots(split: DataFrame, shards: int, rows: int) -> DataFrame:
    """Gapless numbers from 0 in each shard, by buckets: their counts give offsets, so no task sees a whole shard."""
    buckets = max(16, -(-rows // (shards * SLOT_ROWS)))
    rows_of = split.withColumn("bucket", F.expr(f"pmod(key[size(key) - 1], {buckets}L)"))
    counts = rows_of.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "key")) - 1
    numbered = rows_of.withColumn("inside", inside).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("inside")).cast("long").alias("slot"))
