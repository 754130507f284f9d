"""Joins of names by the ratio of their matching blocks, 2 M / (len a + len b), without comparing all with all."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from archivolt.sources.shared import saved


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of the longest matching blocks; not symmetric. Nulls give null. What is known of a second text is kept."""
    held: dict[str, SequenceMatcher] = {}

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        m = held.get(y)
        if m is None:
            if len(held) > 10_000:
                held.clear()
            m = held[y] = SequenceMatcher(None, "", y)
        m.set_seq1(x)
        return m.ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def shared_characters(a: str, b: str) -> Column:
    """How many characters two text columns share, each as often as in both: no matching is larger."""
    times = lambda c, of: F.length(of) - F.length(F.replace(F.col(of), c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(c, a), times(c, b))))


def without(c: Column, most: int) -> Column:
    """The text and all that is left of it without one to `most` of its characters, once each."""
    every = F.array(c)
    last = every
    for _ in range(most):
        one = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
        last = F.array_distinct(F.flatten(F.transform(last, one)))
        every = F.concat(every, last)
    return F.array_distinct(every)


def within_edits(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(a, b, distance) of all names a of `left` and b of `right` within an edit distance, from an equi-join.

    Two names within `most` edits become equal when the right `most` characters at most are left out of either, so they meet
    on what is left of them: keys are near whole names, and none is as common as a letter or a length.
    """
    keys = lambda df, c: df.select(c).distinct().select(c, F.explode(without(F.col(c), most)).alias("key"))
    met = keys(left, "a").join(keys(right, "b"), "key").select("a", "b").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= most)


def _letters(names: DataFrame, column: str) -> DataFrame:
    """(column, letter, nth): the nth occurrence of each character of each distinct name."""
    one = names.select(column).where(F.length(column) > 0).distinct()
    each = one.select(column, F.explode(F.split(column, "")).alias("letter"))
    n = each.groupBy(column, "letter").count()
    return n.select(column, "letter", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth"))


def similar(left: DataFrame, right: DataFrame, least: float, also: Column | None = None, same_first: bool = False) -> DataFrame:
    """(a, b, ratio) of all distinct names a of `left` and b of `right` with a ratio of `least` or more.

    Lossless prefix filter: M characters match, so the multisets of characters share M at least. Since M <= len b, a pair
    needs least / (2 - least) of either side's characters; so both have one in common among their rarest
    len - needed + 1. Names meet on those, and with `same_first` on their first character too. Before the exact ratio go
    `also` and bounds on lengths, on shared characters, which are M at least, and on the edit distance, which is never more
    than len a + len b - 2 M. The pairs that are left are dealt evenly, whatever key they met on.
    """
    x = _letters(left.select("a"), "a"), _letters(right.select("b"), "b")
    rare = x[0].select("letter", "nth").unionAll(x[1].select("letter", "nth")).groupBy("letter", "nth").agg(F.count("*").alias("df"))
    share = least / (2 - least)

    def prefix(t: DataFrame, name: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(name).orderBy("df", "letter", "nth"))
        n = F.length(name)
        first = F.substring(name, 1, 1) if same_first else F.lit("")
        return t.join(rare, ["letter", "nth"]).withColumn("at", at).where(F.col("at") <= n - F.ceil(n * share - 1e-9) + 1).select(name, "letter", "nth", first.alias("first"))

    met = prefix(x[0], "a").join(prefix(x[1], "b"), ["letter", "nth", "first"])
    both = F.length("a") + F.length("b")
    met = met.where(2 * F.least(F.length("a"), F.length("b")) >= (least - 1e-9) * both).where(F.lit(True) if also is None else also).select("a", "b")
    # Dealt by b in a stated number of parts: the pairs are few bytes each and much work.
    met = met.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b").distinct()
    met = met.where(F.levenshtein("a", "b") <= (1 - least + 1e-9) * both).where(2 * shared_characters("a", "b") >= (least - 1e-9) * both)
    return met.withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= least)


def linked_source(stems: DataFrame, candidates: DataFrame, least: float = 0.55) -> DataFrame:
    """stem, candidate, ratio: the candidate of the best ratio, lower-cased; the first by `ord` of equal ones.

    stems: stem. candidates: ord, name. Stems without a candidate of `least` or more have no row.
    """
    s, c = stems.select("stem", F.lower("stem").alias("a")).distinct(), candidates.select("ord", "name", F.lower("name").alias("b"))
    hit = similar(s, c, least).join(s, "a").join(c, "b")
    best = F.max_by(F.struct("name", "ratio"), F.struct(F.col("ratio"), -F.col("ord")))
    return hit.groupBy("stem").agg(best.alias("x")).select("stem", F.col("x.name").alias("candidate"), "x.ratio")


def evidence_page(evidence: DataFrame, pages: DataFrame, normal, least: float = 0.45) -> DataFrame:
    """eid, page, ratio: the first page with the snippet (1.0), else that of the best ratio; pages join on their document.

    evidence: eid, doc, snippet. pages: doc, page, text. Blank pages and snippets are passed over. Shared characters bound
    the ratio: the page of the largest bound is compared first, and then only pages whose bound reaches its ratio.
    """
    e = evidence.select("eid", "doc", normal(F.col("snippet")).alias("s")).where("s <> ''")
    p = pages.select("doc", "page", normal(F.col("text")).alias("t")).where("t <> ''")
    exact = e.join(p, "doc").where(F.contains("t", F.col("s"))).groupBy("eid").agg(F.min("page").alias("page")).withColumn("ratio", F.lit(1.0))
    bound = (2 * shared_characters("s", "t") / (F.length("s") + F.length("t"))).alias("bound")
    may = saved(e.join(exact, "eid", "left_anti").join(p, "doc").select("eid", "doc", "page", bound).where(F.col("bound") >= least - 1e-9))
    texts = lambda df: df.join(e, ["eid", "doc"]).join(p, ["doc", "page"]).select("eid", "page", ratio("s", "t").alias("r"))
    first = texts(may.groupBy("eid", "doc").agg(F.max_by("page", F.struct("bound", -F.col("page"))).alias("page"))).groupBy("eid").agg(F.max("r").alias("least"))
    near = texts(may.join(first, "eid").where(F.col("bound") >= F.col("least") - 1e-9)).where(F.col("r") >= least)
    best = near.groupBy("eid").agg(F.max_by("page", F.struct(F.col("r"), -F.col("page"))).alias("page"), F.max("r").alias("ratio"))
    return exact.unionByName(best)


def variants(counts: DataFrame, canonical: DataFrame, least_count: int = 3, most_apart: float = 0.4) -> DataFrame:
    """variant, name, n, ratio: frequent runs that look like a canonical name and are none.

    counts: run, n. canonical: name. Same first character, lengths at most two apart, 1 - ratio at most `most_apart`.
    """
    runs = counts.where(F.col("n") >= least_count).join(canonical.select(F.col("name").alias("run")), "run", "left_anti")
    fits = F.abs(F.length("a") - F.length("b")) <= 2
    met = similar(runs.select(F.col("run").alias("a")), canonical.select(F.col("name").alias("b")), 1 - most_apart, fits, same_first=True)
    return met.where("ratio < 1").join(runs, met["a"] == runs["run"]).select(F.col("a").alias("variant"), F.col("b").alias("name"), "n", "ratio")


def edit_variants(counts: DataFrame, canonical: DataFrame, least_count: int = 3, most: int = 2) -> DataFrame:
    """variant, name, n, distance: frequent runs within an edit distance of `most` of a name, with its first character."""
    runs = counts.where(F.col("n") >= least_count).join(canonical.select(F.col("name").alias("run")), "run", "left_anti")
    met = within_edits(runs.select(F.col("run").alias("a")), canonical.select(F.col("name").alias("b")), most).where(F.substring("a", 1, 1) == F.substring("b", 1, 1))
    return met.join(runs, met["a"] == runs["run"]).select(F.col("a").alias("variant"), F.col("b").alias("name"), "n", "distance")
