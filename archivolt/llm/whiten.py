"""Whitening of embeddings with distributed block matrices.

The vectors become whole numbers of steps. Rows are numbered without gaps and centred, blocks of BLOCK rows are formed by one
aggregation (each group has BLOCK rows at most) and read as the matrices of an MLlib BlockMatrix. Its transpose times itself,
split along the rows so that no task holds many blocks, is the scatter; its eigenvectors, from a local decomposition of
dimension by dimension numbers, make the whitening matrix, and the block matrix times that one projects the rows. Rows go in
bands of BAND blocks, so that a task of a product holds a bounded number of blocks at every size; the bands run as one job.

Edge cases: rows whose vector is null or holds null or non-finite entries go; all others stay, also with a null or repeated id
or repeated whole; shorter vectors count as padded with 0; steps beyond 2^62 count as 2^62; components whose eigenvalue is
nothing but rounding (rows that are all equal, fewer rows than dimensions) cannot be whitened and are left out; so an
empty table, or one whose rows are all equal, gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .topk import whole
from .util import input_columns, saved, values

BLOCK = 1024
BAND = 4096
HELD = 64


@dataclass
class Fit:
    """What the rows gave: their number, the sums of each dimension, unit eigenvectors in columns, eigenvalues, the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    exact: str


def numbered(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(vec_id, x, at): the usable rows in whole steps, numbered from 0 without gaps; their count and dimension."""
    spark = vectors.sparkSession
    rows = input_columns(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("e")).where(whole(F.col("e")))
    most = float(1 << 62)
    steps = F.transform("e", lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(most)), F.lit(-most))).cast("long") + shift)
    kept = saved(rows.select("vec_id", steps.alias("x"), F.monotonically_increasing_id().alias("m")), "whiten-rows")
    part = F.shiftrightunsigned("m", 33)
    counts = sorted((r["p"], r["n"], r["d"]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect())  # a row for each task that wrote
    n, dim = sum(c[1] for c in counts), max((c[2] for c in counts), default=0)
    starts = np.concatenate([[0], np.cumsum([c[1] for c in counts])]).astype(int)
    first = values(spark, ["p", "start"], [(c[0], int(s)) for c, s in zip(counts, starts[:-1], strict=True)] or [(0, 0)])
    zero = F.lit(shift).cast("long")
    padded = F.concat("x", F.array_repeat(zero, F.lit(dim) - F.size("x")))
    at = F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("p", part).join(F.broadcast(first), "p").select("vec_id", padded.alias("x"), at.alias("at")), n, dim


def totals(rows: DataFrame, n: int, dim: int) -> tuple[list[int], str]:
    """Exact sums of each dimension, and the type in which squares of n x - S and their sum are exact."""
    each = rows.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.min("x").alias("low"), F.max("x").alias("high")).collect()  # a row for each dimension
    sums = [0] * dim
    reach = 0
    for r in each:
        sums[r["d"]] = int(r["s"])
        reach = max(reach, n * (r["high"] - r["low"]), n * abs(r["high"]), n * abs(r["low"]))
    spread = max((n * (r["high"] - r["low"]) for r in each), default=0)
    return sums, "long" if reach < 1 << 62 and dim * spread * spread < 1 << 62 else "decimal(38,0)"


def _off(x: F.Column, fit_n: int, sums: list[int], kind: str) -> F.Column:
    """n x - S of each dimension, exact."""
    whole_sums = F.array(*[F.lit(s).cast(kind) if kind == "long" else F.lit(str(s)).cast(kind) for s in sums])
    return F.zip_with(x, whole_sums, lambda a, s: (a.cast(kind) * F.lit(fit_n).cast(kind) - s).cast(kind))


def block_matrices(rows: DataFrame, n: int, dim: int, off: F.Column) -> list[tuple[int, BlockMatrix]]:
    """(first block, matrix) of each band of the centred rows."""
    centred = F.transform(off, lambda c: c.cast("double") / F.lit(float(n)))
    b, o = (F.col("at") / BLOCK).cast("long"), (F.col("at") % BLOCK).cast("int")
    groups = rows.select(b.alias("b"), F.struct(o.alias("o"), centred.alias("v")).alias("r")).groupBy("b").agg(F.array_sort(F.collect_list("r")).alias("r"))
    none = F.lit(None).cast("array<int>")
    body = F.flatten(F.transform("r", lambda r: r["v"]))
    dense = F.struct(F.lit(1).cast("tinyint").alias("type"), F.size("r").alias("numRows"), F.lit(dim).alias("numCols"), none.alias("colPtrs"), none.alias("rowIndices"), body.alias("values"), F.lit(True).alias("isTransposed"))
    typed = saved(groups.select("b", dense.alias("m")), "whiten-blocks", schema=StructType([StructField("b", LongType()), StructField("m", MatrixUDT())]))
    out = []
    for low in range(0, -(-n // BLOCK), BAND):
        part = typed.where(F.col("b").between(low, low + BAND - 1)).select(F.struct((F.col("b") - low).alias("row"), F.lit(0).cast("long").alias("col")).alias("at"), "m")
        long = min(n - low * BLOCK, BAND * BLOCK)
        out.append((low, BlockMatrix(callMLlibFunc("createBlockMatrix", part, BLOCK, dim, long, dim), BLOCK, dim)))
    return out


def scatter(bands: list[tuple[int, BlockMatrix]], dim: int) -> np.ndarray:
    """The sum over all rows of the products of their centred entries."""
    total = np.zeros((dim, dim))
    for _, m in bands:
        splits = max(1, -(-m.numRowBlocks // HELD))
        java = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
        total += BlockMatrix(java, dim, dim).toLocalMatrix().toArray()
    return total


def fitted(spread: np.ndarray, n: int, sums: list[int], exact: str, components: int) -> Fit:
    """Eigenvectors of the covariance by falling eigenvalue; those at the level of rounding are left out."""
    e, u = np.linalg.eigh(spread / n)
    e, u = e[::-1], u[:, ::-1]
    keep = int((e[:components] > max(e[0], 0.0) * len(e) * np.finfo(float).eps).sum())
    return Fit(n, sums, u[:, :keep], e[:keep], float(np.trace(spread)) / n, exact)


def projected(bands: list[tuple[int, BlockMatrix]], fit: Fit) -> DataFrame:
    """(at, w): the centred rows times the whitening matrix."""
    dim, count = fit.vectors.shape
    matrix = fit.vectors / np.sqrt(fit.eigenvalues)
    out = None
    for low, m in bands:
        context = m.blocks.context
        parts = max(1, -(-m.numRowBlocks // HELD)) ** 2  # a product has as many tasks as the root of its partitions
        by = BlockMatrix(context.parallelize([((0, 0), DenseMatrix(dim, count, matrix.ravel(order="F").tolist()))], parts), dim, count)
        rows = callMLlibFunc("getIndexedRows", m.multiply(by).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        rows = rows.select((F.col("index") + low * BLOCK).alias("at"), vector_to_array("vector").alias("w"))
        out = rows if out is None else out.unionByName(rows)
    return out


def identity_error(whitened: DataFrame, count: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity, from the rows themselves."""
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    found = whitened.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whiten(vectors: DataFrame, *, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error of each row and component."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows, n, dim = numbered(vectors, scale, shift, id_col, vector_col)
    nothing = rows.where(F.lit(False)).select("vec_id").crossJoin(empty)
    if not n or not dim:
        return nothing
    sums, exact = totals(rows, n, dim)
    off = _off(F.col("x"), n, sums, exact)
    bands = block_matrices(rows, n, dim, off)
    fit = fitted(scatter(bands, dim), n, sums, exact, components)
    count = len(fit.eigenvalues)
    if not count:
        return nothing
    white = saved(projected(bands, fit), "whiten-rows-out")
    error = identity_error(white, count)
    square = F.aggregate(F.transform(off, lambda c: (c * c).cast(exact)), F.lit(0).cast(exact), lambda a, c: (a + c).cast(exact))
    share = F.array(*[F.lit(float(e / fit.trace)) for e in fit.eigenvalues])
    each = rows.select("vec_id", "at", square.cast("decimal(38,0)").alias("deviation")).join(white, "at")
    out = each.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
