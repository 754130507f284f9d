"""The corpus pipeline: from documents to shards in five stages, each a job over all that the stage before kept.

Each stage is written as Parquet to the shared folder and read again, so a lost executor never costs more than a stage.
Every stage keeps rows with nulls in other columns and passes unknown columns through, but for the last, whose result is
the assignment to shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import decontam, jaccard, langid, mixing, shard
from archivolt.llm.util import free_name, saved, table

SHARDS = 40


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, written so that every use sees the same one, and that column's name."""
    name = free_name(docs.columns, "row_key")
    return saved(docs.withColumn(name, F.monotonically_increasing_id()), "stage-keyed"), name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or no nearer to one language than chance, go.

    Without a labelled row there is nothing to tell languages by, and only those without a letter go.
    """
    filters = langid.learn(docs)
    if not filters.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    said = (free_name(docs.columns, "lang_pred"), free_name(docs.columns, "lang_score"))
    found = langid.identify(docs, filters, keep=tuple(docs.columns), names=said)
    chance = 1.0 / len(filters.langs)
    return found.where((F.col(said[0]) != "und") & (F.col(said[1]) >= chance * 0.999)).drop(*said)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the least id, null last. Ids may be null or repeat."""
    rows, key = keyed(docs)
    group = free_name(rows.columns, "class_id")
    found = jaccard.classes(rows, id_col=key, count_links=False).select(F.col("doc_id").alias(key), F.col("class_id").alias(group))
    ids = rows.select(key, F.col("doc_id").isNull().alias("lacks"), "doc_id")
    least = found.join(ids, key).groupBy(group).agg(F.min(F.struct("lacks", "doc_id", F.col(key).alias("row"))).alias("least"))
    return rows.join(least.select(F.col("least.row").alias(key)), key, "left_semi").drop(key)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    rows, key = keyed(docs)
    found = decontam.leaks(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(found, key, "left_anti").drop(key)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.emit(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every copy."""
    return shard.shard(docs, shards=SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("sharded", sharded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
