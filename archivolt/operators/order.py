"""Numbers and neighbours in the order of a key's rows, without one task for the rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.sources.shared import saved


def numbered(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows with `number` (from 0, in the order within their key) and `many` (rows of the key).

    The rows are dealt by ranges of key and order, so a key with many rows lies in many partitions; each partition numbers
    its own rows, and what stands before it comes from the counts of partitions, a row for each key in each. The dealt rows
    are written, so that all that follows sees one dealing. Rows alike in key and order stay together. Null keys are a key.
    """
    dealt = saved(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    of = Window.partitionBy("_key")
    sums = counts.withColumn("_before", F.coalesce(F.sum("_n").over(of.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("many", F.sum("_n").over(of))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    j = dealt.withColumn("_own", own).join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return j.select(*rows.columns, (F.col("_own") + F.col("_before")).alias("number"), "many")


def with_blocks(rows: DataFrame, back: int, block: int = 10_000) -> DataFrame:
    """Numbered rows with `block` and `own`: a block of a key's rows, and again (own = false) the `back` rows before it.

    A window over (key, block) then sees `back` rows behind each row of the block, and no key stands alone in a task.
    """
    at = F.floor(F.col("number") / block)
    ahead = F.col("number") % block >= block - back
    both = F.when(ahead, F.array(F.struct(at.alias("block"), F.lit(True).alias("own")), F.struct((at + 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(at.alias("block"), F.lit(True).alias("own"))))
    return rows.withColumn("_b", F.explode(both)).select(*rows.columns, "_b.block", "_b.own")
