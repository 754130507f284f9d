"""TF-IDF indexes, ranked search, fusion and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators import terms as T
from archivolt.operators.matching import found_phrases


def word_terms(c: Column, pairs: bool = True) -> Column:
    """Words and, if asked for, pairs of neighbouring words."""
    w = X.words(c)
    # zip_with reads the word list a fixed number of times; a lambda that indexed it would cut the text anew for each word.
    two = F.filter(F.zip_with(w, F.slice(w, 2, 2_000_000_000), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))), lambda x: x.isNotNull())
    return F.concat(w, two) if pairs else w


def char_terms(c: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within words padded by a blank; a padded word not longer than n gives itself once and stops."""
    parts = F.filter(F.split(F.lower(c), f"{X.SPACE}+"), lambda w: w != "")
    padded = F.transform(parts, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        return F.when(F.length(w) > n, some).when(F.greatest(F.length(w), F.lit(low)) == n, F.array(w)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*[grams(w, n) for n in range(low, high + 1)]))))


def weights(units: DataFrame, terms: T.Terms, features: int, sublinear: bool = False, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(vocab: term, df, idf) and (unit, term, w): L2-normalised TF-IDF of the most frequent terms.

    Ties of the vocabulary go to the smaller term; it has at most `features` rows. `save` keeps it, as a table written and
    read back, for all that uses it.
    """
    vocab = save(T.vocabulary(units, terms, features))
    return vocab, T.vectors(units, terms, vocab, sublinear)


def searched(units: DataFrame, queries: DataFrame, terms: T.Terms, features: int, k: int, sublinear: bool = False, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """qid, unit, score, rank: the k best units (unit, text) of each query (unit = qid, text).

    Few queries are scored in the rows of the units, which give out k candidates a query and block. Many meet the units on
    shared terms: units give out the terms that a query has, no others; their norms are over the whole vocabulary.
    """
    vocab = save(T.vocabulary(units, terms, features))
    asked = save(T.vectors(queries, terms, vocab, sublinear))
    if queries.count() > T.QUERIES:
        return top_k(T.vectors(units, terms, vocab, sublinear, asked), asked, k)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "unit"))
    return T.best(units, terms, vocab, asked, k, sublinear).withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, unit, score, rank: cosine over shared terms; ties to the smaller unit. queries: (unit = qid, term, w)."""
    q = queries.select(F.col("unit").alias("qid"), "term", F.col("w").alias("qw"))
    score = index.join(q, "term").groupBy("qid", "unit").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "unit"))
    return score.withColumn("rank", rank).where(F.col("rank") <= k)


def zero_filled(found: DataFrame, asked: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """Ranked lists (qid, unit, score, rank) of less than k rows, or of none, filled with the least units at score 0.

    asked: qid of every query. A list lacks k units at most, so the k least units of all serve every query.
    """
    least = [r[0] for r in units.select("unit").distinct().orderBy("unit").limit(k).collect()]  # k ids
    some = F.array(*[F.lit(u) for u in least]) if least else F.array().cast(f"array<{dict(units.dtypes)['unit']}>")
    have = found.groupBy("qid").agg(F.collect_list("unit").alias("have"))  # k units at most
    short = asked.select("qid").distinct().join(have, "qid", "left").withColumn("have", F.coalesce("have", F.array().cast(f"array<{dict(found.dtypes)['unit']}>")))
    lacking = short.where(F.size("have") < k).withColumn("more", F.slice(F.array_except(some, F.col("have")), F.lit(1), k - F.size("have")))
    extra = lacking.select("qid", F.size("have").alias("n"), F.posexplode("more").alias("at", "unit"))
    return found.unionByName(extra.select("qid", "unit", F.lit(0.0).alias("score"), (F.col("n") + F.col("at") + 1).alias("rank")))


def fuse(legs: DataFrame, k: int = 60, top: int = 5) -> DataFrame:
    """Weighted reciprocal rank fusion of (leg, qid, unit, rank from 1, weight); ties by leg, then rank."""
    score = legs.groupBy("qid", "unit").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first", "unit"))
    return score.withColumn("rank", rank).where(F.col("rank") <= top).select("qid", "unit", "score", "rank")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors padded with 0 as rows of unit length; a zero vector stays zero."""
    long = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = np.zeros((len(column), dim))
    m[np.arange(dim)[None, :] < long[:, None]] = flat
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _usable(df: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 8192, places: DataFrame | None = None, least: int = 20) -> DataFrame:
    """qid, vec_id, score, rank: cosine of all vectors but a query's own, k best of each query; ties to the smaller id.

    Queries go in blocks of about `block`, so what is broadcast is bounded; a block is one pass over the vectors, each batch
    a matrix product that keeps k rows a query. Vectors that are null or hold null or non-finite components take no part;
    shorter ones count as padded with 0. places (place, unit): a query with a place (column `place`) that has `least` units
    or more searches those units only.
    """
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    asked = _usable(queries.select("vec_id", "embedding", F.col("place") if places is not None else F.lit(None).cast("string").alias("place")))
    rows = _usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    if places is not None:
        wide = places.groupBy("place").agg(F.count("*").alias("many")).where(F.col("many") >= least).select("place", F.lit(True).alias("wide"))
        asked = asked.join(wide, "place", "left").withColumn("place", F.when(F.col("wide"), F.col("place")))
        of = places.join(asked.select("place").distinct(), "place", "left_semi").groupBy(F.col("unit").alias("vec_id")).agg(F.collect_set("place").alias("places"))
        rows = rows.join(of, "vec_id", "left")
    else:
        rows = rows.withColumn("places", F.lit(None).cast("array<string>"))
    size = F.coalesce(F.max(F.size("embedding")), F.lit(0))
    dim = max(asked.agg(size).first()[0], rows.agg(size).first()[0])
    parts = max(1, -(-asked.count() // block))
    found = spark.createDataFrame([], "qid long, vec_id long, score double")
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).select("vec_id", "embedding", "place").toArrow()  # about `block` rows
        if not own.num_rows:
            continue
        held = sc.broadcast((own["vec_id"].to_numpy(), _matrix(own["embedding"].combine_chunks(), dim), own["place"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q, wanted = held.value
            narrow = {p: np.array([i for i, x in enumerate(wanted) if x == p]) for p in set(wanted) - {None}}
            for b in batches:
                unit = b["vec_id"].to_numpy()
                score = np.round(q @ _matrix(b["embedding"], dim).T, 6) + 0.0
                score[ids[:, None] == unit[None, :]] = -np.inf
                if narrow:
                    has = [set(x or ()) for x in b["places"].to_pylist()]
                    for p, i in narrow.items():
                        score[np.ix_(i, np.flatnonzero([p not in x for x in has]))] = -np.inf
                order = np.lexsort((np.broadcast_to(unit, score.shape), -score), axis=1)[:, :k]
                top = np.take_along_axis(score, order, axis=1)
                good = top > -np.inf
                yield pa.record_batch([np.broadcast_to(ids[:, None], order.shape)[good], unit[order][good], top[good]], names=["qid", "vec_id", "score"])

        found = found.unionByName(rows.select("vec_id", "embedding", "places").mapInArrow(run, found.schema))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def method_rows(metrics: DataFrame) -> DataFrame:
    """metric, value: hit@1 and MRR of each method (method, hit_1, mrr) as rows of a catalogue."""
    pair = F.explode(F.array(F.struct(F.concat(F.lit("hit_1 "), "method").alias("metric"), F.col("hit_1").cast("double").alias("value")), F.struct(F.concat(F.lit("mrr "), "method").alias("metric"), F.col("mrr").cast("double").alias("value"))))
    return metrics.select(pair.alias("x")).select("x.metric", "x.value")


def gold_metrics(rankings: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """hit@k and MRR over all questions: gold (qid, unit or null). Questions without gold stay in the denominator."""
    hit = gold.join(rankings.select("qid", "unit", "rank"), ["qid", "unit"], "left").groupBy("qid").agg(F.min("rank").alias("r"))
    return hit.agg(F.count("*").alias("questions"), *[F.round(F.avg(F.coalesce((F.col("r") <= k).cast("int"), F.lit(0))), 4).alias(f"hit_{k}") for k in ks], F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 4).alias("mrr"))


def confusion(rows: DataFrame, by: str) -> DataFrame:
    """tp, fp, fn, tn and their ratios of (predicted, actual) per group; 0 where a ratio has no denominator."""
    p, a = F.col("predicted") == 1, F.col("actual") == 1
    c = rows.groupBy(by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    c = c.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    acc = share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return c.select(by, "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(n) for n, x in (("precision", F.col("precision")), ("recall", F.col("recall")), ("f1", f1), ("accuracy", acc))])


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of (confidence, label): n, means and their gap; nulls and empty bins left out."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin")
    m = rows.where(F.col("confidence").isNotNull()).groupBy(b).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("label").alias("a"))
    return m.select("bin", "n", F.round("c", 6).alias("mean_confidence"), F.round("a", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")), 6).alias("gap"))


def reranked(fused: DataFrame, scores: DataFrame, topn: int, k: int) -> DataFrame:
    """qid, unit, rank, score: the head of max(topn, k) by external score (stable, sigmoid), then the tail as it was.

    Lists of k rows or fewer stay as they are. A head row without an external score counts as the lowest.
    """
    head = max(topn, k)
    long = fused.groupBy("qid").agg((F.count("*") > k).alias("long"))
    j = fused.join(long, "qid").join(scores.select("qid", "unit", "outer"), ["qid", "unit"], "left")
    moved = F.col("long") & (F.col("rank") <= head)
    w = Window.partitionBy("qid").orderBy(F.when(moved, 0).otherwise(1), F.when(moved, F.col("outer")).desc_nulls_last(), "rank")
    score = F.when(moved & F.col("outer").isNotNull(), 1 / (1 + F.exp(-F.col("outer")))).otherwise(F.col("score"))
    return j.select("qid", "unit", F.row_number().over(w).alias("rank"), F.round(score, 6).alias("score"))


def place_candidates(scored: DataFrame, wanted: DataFrame, postings: DataFrame, least: int = 20) -> DataFrame:
    """Scored candidates (qid, unit, …) of queries with a place (qid, place): those of the place if it has `least` units,
    else all. Two branches, so that both joins are equi-joins."""
    size = postings.groupBy("place").agg(F.count("*").alias("many"))
    w = wanted.join(size, "place", "left").withColumn("filtered", F.coalesce(F.col("many") >= least, F.lit(False)))
    narrow = scored.join(w.where("filtered").select("qid", "place"), "qid").join(postings, ["place", "unit"], "left_semi").drop("place")
    return narrow.unionByName(scored.join(w.where("NOT filtered").select("qid"), "qid", "left_semi"))


def weak_metrics(rankings: DataFrame, questions: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """hit@k, recall@k and MRR with weak labels. relevant: (qid, unit), once each, as of `labelled`.

    questions: qid. recall@k divides by min(min(max(gold, 1), 20), k).
    """
    gold = relevant.groupBy("qid").agg(F.count("*").alias("gold"))
    hit = rankings.join(relevant.select("qid", "unit"), ["qid", "unit"], "left_semi").groupBy("qid")
    hit = hit.agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"rel_{k}") for k in ks])
    q = questions.select("qid").join(gold, "qid", "left").join(hit, "qid", "left")
    top = lambda k: F.least(F.least(F.greatest(F.coalesce("gold", F.lit(0)), F.lit(1)), F.lit(20)), F.lit(k))
    out = [F.round(F.avg((F.coalesce(f"rel_{k}", F.lit(0)) > 0).cast("int")), 4).alias(f"hit_{k}") for k in ks]
    out += [F.round(F.avg(F.coalesce(f"rel_{k}", F.lit(0)) / top(k)), 4).alias(f"recall_{k}") for k in ks]
    return q.agg(F.count("*").alias("questions"), *out, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def unmatched(rankings: DataFrame, questions: DataFrame, relevant: DataFrame) -> DataFrame:
    """qid, gold of the questions without a relevant unit in their lists. relevant: (qid, unit), once each."""
    n = relevant.groupBy("qid").agg(F.count("*").alias("gold"))
    found = rankings.join(relevant.select("qid", "unit"), ["qid", "unit"], "left_semi").select("qid").distinct()
    return questions.select("qid").join(n, "qid", "left").join(found, "qid", "left_anti").select("qid", F.coalesce("gold", F.lit(0)).alias("gold"))


def upsert(old: DataFrame, new: DataFrame, key: str = "method") -> DataFrame:
    """New rows in place of the old rows of the same key; other rows stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def labelled(questions: DataFrame, units: DataFrame) -> DataFrame:
    """qid, unit, by_anchor, once for each unit that holds a question's anchor or a keyword of it: equi-joins on phrases."""
    parts = questions.select("qid", F.explode(F.concat(F.array(F.struct(F.col("anchor").alias("part"), F.lit(True).alias("a"))), F.transform("keywords", lambda w: F.struct(w.alias("part"), F.lit(False).alias("a"))))).alias("p"))
    met = found_phrases(units.select(F.col("unit").alias("doc_id"), "text"), parts.select(F.struct("qid", "p.a").alias("eid"), "p.part"))
    return met.groupBy(F.col("eid.qid").alias("qid"), F.col("doc_id").alias("unit")).agg(F.max("eid.a").alias("by_anchor"))


def holders(questions: DataFrame, units: DataFrame) -> DataFrame:
    """(qid, unit) of the units that hold the question's anchor, null for a question that none holds."""
    met = found_phrases(units.select(F.col("unit").alias("doc_id"), "text"), questions.select(F.col("qid").alias("eid"), F.col("anchor").alias("part")))
    return questions.select("qid").join(met.select(F.col("eid").alias("qid"), F.col("doc_id").alias("unit")), "qid", "left")


def ablation(metrics: DataFrame, base: str) -> DataFrame:
    """(method, …, mrr) with the delta of the MRR to that of the method `base`; methods are few."""
    of = F.max(F.when(F.col("method") == base, F.col("mrr"))).over(Window.partitionBy(F.lit(0)))
    return metrics.select("*", F.round(F.col("mrr") - of, 4).alias("delta"))


def gold(questions: DataFrame, units: DataFrame, most: int = 20) -> DataFrame:
    """qid, by_anchor (how many units hold the anchor), by_keyword (the first `most` units of anchor or keywords)."""
    r = labelled(questions, units).withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy("unit")))
    return r.groupBy("qid").agg(F.count_if("by_anchor").alias("by_anchor"), F.sort_array(F.collect_list(F.when(F.col("i") <= most, F.col("unit")))).alias("by_keyword"))


def hybrid(legs: DataFrame, names: tuple[str, ...], top: int = 5) -> DataFrame:
    """Fusion of the legs that found anything for a query; a leg alone scores by its length less the rank. Adds the mode."""
    of = Window.partitionBy("qid")  # a list is short: the legs of one query meet once, and are read once
    f = legs.withColumn("has", F.sort_array(F.collect_set("leg").over(of))).withColumn("n", F.count("*").over(of)).groupBy("qid", "unit", "has", "n").agg(F.round(F.sum(F.col("weight") / (60 + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("leg", "rank")).alias("first"))
    score = F.when(F.size("has") == 1, (F.col("n") - F.col("first.rank")).cast("double")).otherwise(F.col("rrf"))
    mode = F.array_join(F.transform("has", lambda i: F.get(F.array(*[F.lit(x) for x in names]), i)), "+")
    r = f.select("qid", "unit", score.alias("score"), mode.alias("mode"), "first")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first", "unit"))
    return r.withColumn("rank", rank).where(F.col("rank") <= top).drop("first")
