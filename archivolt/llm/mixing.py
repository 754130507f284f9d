"""Mixing sources to target weights: rates per source, whole copies plus one hash-seeded Bernoulli copy.

Built-in functions only. Edge cases: a null text has size 0; a null source is a source of its own, last in order; a
source whose documents are all empty has target 0 and keeps one (empty) copy of each document; repeated rows count each
on their own and, as the draw depends on the id alone, fall alike; an empty table gives an empty result; other input
columns pass through `emit` untouched; very long texts are documents like others; sources of equal weight need no
order but the code points of their names.

The draws are independent, so a source's taken words miss its target by a sum of mean 0 and variance size^2 f (1 - f) over
its documents (f: the fraction of a copy); the share that is missed shrinks as a source gets more documents.

The table of sources (a row a source, two numbers) is ordered in one task; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import saved

WORD = r"[^\x20\x09-\x0D]+"


def named(c: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col(f"`{c.replace('`', '``')}`")


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that the key and the seed decide alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sizes: (source, source_size). Adds weight and target.

    Targets share the total by weight; a source stops at `cap` times its size and the excess is shared again. All of it
    is one water level: target = min(cap * size, level * weight). The level is found by aggregates over the source
    table, whose two sums are all that reaches the driver; each pass caps at least one source more.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long")
    base = saved(sizes.withColumn("weight", weight), "mix-sources")
    total = base.agg(F.sum("source_size")).first()[0] or 0
    level, free, left = 0.0, -1, total
    full = F.lit(False)
    while True:
        capped, open_weight = base.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if open_weight in (0, free):
            break
        free, left = open_weight, total - capped
        level = left / open_weight
        full = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
    target = F.least((F.col("source_size") * cap).cast("double"), F.lit(float(level)) * F.col("weight"))
    return base.withColumn("target", target)


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: int = 17,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken, and the columns named in `keep` as `_keep_0` on."""
    rows = docs.select(
        named(id_col).alias("doc_id"), named(source_col).alias("source"), words(named(text_col)).alias("size"),
        *[named(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    joined = rows.alias("d").join(targets.alias("s"), F.expr("d.source <=> s.source"), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    copies = whole + (draw(F.col("d.doc_id"), seed) < rate - whole).cast("long")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.size").alias("size"), "source_size", "target",
        copies.cast("long").alias("copies"), *[f"_keep_{i}" for i in range(len(keep))],
    ).withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each input row as many times as the mix takes it."""
    mixed = mix(docs, keep=tuple(docs.columns), **options)
    many = mixed.select("*", F.explode(F.expr("IF(copies > 0, sequence(1L, copies), array())")).alias("_copy"))
    return many.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)])
