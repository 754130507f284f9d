"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch: list[dict[int, tuple[DataFrame, str]]] = []


def saved(df: DataFrame, name: str, keep: bool = False, schema: StructType | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that lost executors cost no lineage.

    Within `scratch` the table goes at its end, unless it is to be kept. schema: types to read it with, if they differ.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema or df.schema).parquet(path)
    if _scratch and not keep:
        _scratch[-1][id(out)] = (out, path)  # the table stays, so its id is not given away
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Deletes the tables saved within, at the end or when the function it gives is called with one.

    What is read later must be saved with `keep`: nothing that is returned may still depend on the others.
    """
    held: dict[int, tuple[DataFrame, str]] = {}
    _scratch.append(held)

    def delete(tables: list[tuple[DataFrame, str]]) -> None:
        for _, p in tables:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    try:
        yield lambda table: delete([held.pop(id(table))])
    finally:
        _scratch.remove(held)
        delete(list(held.values()))


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of numbers as a SQL VALUES list (no Python objects reach the executors)."""
    body = ", ".join("(" + ", ".join(f"{x}D" if isinstance(x, float) else f"{x}L" for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def fold(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """crc32(id as text) mod parts: 0 is held out. A null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def free_name(taken: list[str], name: str) -> str:
    """The name, with underscores behind it until no column in `taken` has it in any case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def typed(df: DataFrame, *names: str) -> str:
    """The schema of the named columns as text."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in quoted(df, *names).schema)


def quoted(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever characters their names hold."""
    return df.select(*[F.col(f"`{n.replace('`', '``')}`") for n in names])


def input_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that further columns of any name cannot clash; missing ones are null."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n.replace('`', '``')}`") if n in have else F.lit(None).cast("string").alias(n) for n in names])


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)
