"""Reading and writing: text corpora, graph JSON, tables of contents, slices, resumed runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators.chunks import totals

ENTITY = "id string, type string, name string, aliases array<string>, description string, properties map<string,string>, source string, evidence string, confidence double"
RELATION = "id string, source string, target string, relation string, label string, properties map<string,string>, source_file string, evidence string, confidence double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, folder: str, part: str = "", limit: int | None = None) -> DataFrame:
    """One row per text file: source (file name) and text; `part` must be in the name; the first `limit` by name."""
    df = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    df = df.where(F.contains("source", F.lit(part))) if part else df
    return df.orderBy("source").limit(limit) if limit else df


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a graph file with their positions as `ord`; a missing file is an empty graph."""
    schema = f"entities array<struct<{_struct(ENTITY)}>>, relations array<struct<{_struct(RELATION)}>>"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    raw = text.select(F.from_json(F.ltrim("value", F.lit("\ufeff")), schema).alias("g")).select("g.*")  # a byte order mark may stand in front
    return tuple(raw.select(F.posexplode(c).alias("ord", "x")).select("ord", "x.*") for c in ("entities", "relations"))


def _struct(schema: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (p.strip().split(" ", 1) for p in schema.split(", ")))


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """book, ord, item, page from a JSON map of books to lists of items; blank items go."""
    raw = spark.read.text(path, wholetext=True)
    books = raw.select(F.explode(F.from_json("value", "map<string,array<struct<item:string,page:string>>>")).alias("book", "items"))
    rows = books.select("book", F.posexplode("items").alias("ord", "x")).select("book", "ord", "x.item", F.nullif(F.regexp_extract("x.page", r"^\s*(\d+)", 1), F.lit("")).cast("int").alias("page"))
    return rows.where("trim(coalesce(item, '')) <> ''")


def replace_slice(old: DataFrame, new: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The old table without the rows of the named slices, plus the new rows."""
    return old.where(~F.coalesce(F.col(key).isin(*names), F.lit(False))).unionByName(new)


def not_done(rows: DataFrame, done: DataFrame, key: str, least_chars: int, most: int) -> DataFrame:
    """The first `most` rows, by key, that are long enough and not done yet."""
    return rows.join(done.select(key), key, "left_anti").where(F.length("text") >= least_chars).orderBy(key).limit(most)


def write_slices(rows: DataFrame, slices: DataFrame, path: str, column: str, run: int) -> None:
    """Replaces the named slices (column) of the table at `path` by the rows; all others stay.

    A run writes its rows to a folder of its own and marks its slices when they are all there: until then readers see the
    slices of earlier runs, so a lost job drops nothing. The same run again overwrites its own folders and doubles nothing.
    A slice that is named and has no rows is empty from then on. Runs count upward.
    """
    named = slices.select(column).distinct()
    rows.join(named, column, "left_semi").write.mode("overwrite").partitionBy(column).parquet(f"{path}/data/run={run}")
    named.withColumnRenamed(column, "slice").write.mode("overwrite").parquet(f"{path}/marks/run={run}")


def read_slices(spark: SparkSession, path: str, column: str, schema: str) -> DataFrame:
    """The rows of the last marked run of each slice. schema: the columns of the rows, with the slice's column."""
    marks = spark.read.schema("slice string, run long").option("basePath", f"{path}/marks").parquet(f"{path}/marks")
    last = marks.groupBy("slice").agg(F.max("run").alias("run"))
    rows = spark.read.schema(f"{schema}, run long").option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(last, (rows[column].cast("string") == last["slice"]) & (rows["run"] == last["run"])).select(*[c for c in rows.columns if c != "run"])


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunks by source under `chunks`, and one row that sums them up, as JSON, under `summary`."""
    chunks.write.mode("overwrite").partitionBy("source").parquet(f"{path}/chunks")
    totals(chunks).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_graph(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Both tables of a graph as Parquet; the positions stay in `ord`."""
    for name, df in (("entities", entities), ("relations", relations)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("entities", "relations"))


def save_turns(turns: DataFrame, path: str, buckets: int = 64) -> None:
    """Appends conversation turns, filed by a hash of the conversation, so that reading one touches one folder."""
    turns.withColumn("part", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("part").parquet(path)


def load_turns(spark: SparkSession, path: str, conv_id: int | None = None, buckets: int = 64) -> DataFrame:
    """All turns, or those of one conversation with the other folders pruned."""
    df = spark.read.parquet(path)
    if conv_id is not None:
        df = df.where((F.col("part") == F.pmod(F.xxhash64(F.lit(conv_id).cast("long")), F.lit(buckets)).cast("int")) & (F.col("conv_id") == conv_id))
    return df.drop("part")
