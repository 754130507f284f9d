"""Personal data: base patterns, plus bootstrapped contextual extraction of further identifiers.

Built-in functions only. Base matches and identifier-like tokens are cut out of each text once (places come from the
lengths of the pieces between matches); what is shuffled afterwards are those matches, never texts.

Bootstrapping: distinct instances (the values of base entities at their own spans, and of tokens that touch none) and
lexical patterns (the left context: a word, or a label with its separator and quote; and the shape with the right context)
form a graph. Seeds are the base entities and values that stand behind one of `labels`; each round scores a pattern by the
mean score of its instances (shrunk by `doubt`) and an instance by its best pattern. A pattern counts from `support`
accepted instances on: seeds, and whatever scored `confidence` in the round before. Instances of such patterns with a score
of `confidence` are identifiers. Tokens are runs of letters and digits with a digit and four characters or more, such runs
joined by one of . _ / + - (none need four then), and those continued over a blank between digits; of accepted tokens that
hold one another the widest is the span.

Edge cases: null and empty texts have no span and the hash of ''; repeated rows are answered alike; places are code
points; runs of any length are matched without recursion, so very long texts are read whole; of matches that begin alike the
order of the kinds decides, and values of equal score are accepted alike; an empty table gives an empty result; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import saved

# The kinds in their order and their patterns; the possessive loops and look-behinds only save backtracking.
KINDS = ("email", "ip", "card", "phone", "id")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Tokens: runs, joined runs and runs over blanks. Each of the wider ones holds the narrower whole.
TOKENS = {
    "id": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{4,}+(?![A-Za-z0-9])",
    "joined": r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._/+-])(?=[A-Za-z._/+-]*+[0-9])[A-Za-z0-9]++(?:[._/+-][A-Za-z0-9]++)++",
    "spaced": r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._/+-])(?<![0-9]\x20(?=[0-9]))(?=[A-Za-z._/+-]*+[0-9])[A-Za-z0-9]++(?:(?:[._/+-]|(?<=[0-9])\x20(?=[0-9]))[A-Za-z0-9]++)++",
}
LABELS = ("token", "secret", "password", "passwd", "apikey", "api_key", "key", "ssn", "iban", "passport")


def _cut(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a kind as structs: its place in the order, the length of the text before it, value, contexts."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # Zipped, so that the text is cut a fixed number of times, not once for each match.
    pairs = F.zip_with(values, gaps, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    each = F.zip_with(pairs, F.slice(gaps, 2, 2_000_000_000), lambda p, n: F.struct(p["value"].alias("value"), p["gap"].alias("gap"), n.alias("next")))
    left = lambda g: F.regexp_extract(F.substring(g, -40, 40), r"(?:([\p{L}_]+)(\s*[=:]\s*[\"']?)|([\p{L}_]+)\W{0,3})$", 0)
    found = F.filter(each, lambda x: x["value"].isNotNull())
    return F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"), x["value"].alias("value"), left(x["gap"]).alias("left"), F.substring(x["next"], 1, 1).alias("right")))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    small = F.forall(F.split("value", r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    blank = F.col("value").contains(" ")
    own = F.col("value").rlike("[0-9]")
    return F.when(F.col("kind") == "joined", own).when(F.col("kind") == "spaced", own & blank).when(F.col("kind") == "ip", small).when(F.col("kind") == "card", n.between(12, 19) & _luhn(digits)).when(F.col("kind") == "phone", n.between(9, 15)).otherwise(F.lit(True))


def _guarded(text: Column, kind: str) -> Column:
    """Skips the expressions where the text lacks what every match has."""
    sign = {"email": "@", "phone": "+"}.get(kind)
    return F.when(text.contains(sign), text).otherwise(F.lit("")) if sign else text


def matches(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all rows, and the matches of all kinds with their places."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.when(text.rlike("[0-9]"), text).otherwise(F.lit(""))
    cuts = [_cut(_guarded(text if k in ("email", "phone") else number, k), PATTERNS[k], k) for k in KINDS[:-1]]
    cuts += [_cut(number, pattern, k) for k, pattern in TOKENS.items()]
    base = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.concat(*cuts).alias("m")), "pii-matches")
    flat = base.select("row", F.explode("m").alias("m")).select("row", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("place")
    upto = F.sum(F.col("gap") + F.length("value")).over(order)
    placed = flat.withColumn("end", upto.cast("long")).withColumn("start", (F.col("end") - F.length("value")).cast("long"))
    return base.select("row", "doc_id"), placed.where(_valid()).select("row", "kind", "start", "end", "value", "left", "right")


def shape(value: Column) -> Column:
    """Digits only, hexadecimal or other (separators aside), with the lengths of the runs and what stands between them."""
    plain = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    sort = F.when(plain.rlike("^[0-9]+$"), F.lit("d")).when(F.lower(plain).rlike("^[0-9a-f]+$"), F.lit("h")).otherwise(F.lit("a"))
    runs = F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0)), lambda x: F.when(x.rlike("^[A-Za-z0-9]"), F.length(x).cast("string")).otherwise(x))
    return F.concat(sort, F.array_join(runs, ""))


def discovered(tokens: DataFrame, base: DataFrame, *, labels: tuple[str, ...], rounds: int, support: int, confidence: float, doubt: float) -> DataFrame:
    """Values that the bootstrapping accepts. tokens and base (the seeds): value, left, right."""
    label = F.lower(F.regexp_extract("left", r"^([\p{L}_]+)\s*[=:]", 1))
    context = F.when(F.col("left") != "", F.concat(F.lit("L:"), F.lower(F.regexp_replace("left", r"\s+", " "))))
    form = F.concat(F.lit("S:"), shape(F.col("value")), F.lit(":"), F.when(F.col("left").rlike("[=:\"']$"), F.lit("=")).otherwise(F.lit("")), F.regexp_replace("right", r"\s", " "))
    every = tokens.select("value", "left", "right", label.isin(*labels).alias("seed")).unionByName(base.select("value", "left", "right", F.lit(True).alias("seed")))
    edges = every.select("value", "seed", F.explode(F.array_compact(F.array(context, form))).alias("pattern"))
    # One row per instance and pattern: however often a value repeats, it counts once.
    graph = saved(edges.groupBy("value", "pattern").agg(F.max("seed").alias("seed")), "pii-values")
    start = graph.groupBy("value").agg(F.max("seed").alias("seed"))
    edges = saved(graph.select("value", "pattern").join(start, "value"), "pii-graph")
    score = edges.select("value", F.col("seed").cast("double").alias("score")).distinct()
    patterns = None
    for _ in range(rounds):
        held = F.count_if(F.col("seed") | (F.col("score") >= confidence))
        patterns = edges.join(score, "value").groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(doubt))).alias("p"), held.alias("held"))
        patterns = saved(patterns, "pii-patterns")
        best = F.max(F.when(F.col("held") >= support, F.col("p")).otherwise(F.lit(0.0)))
        score = saved(edges.join(patterns, "pattern").groupBy("value").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(best).alias("score")), "pii-scores")
    good = patterns.where((F.col("held") >= support) & (F.col("p") >= confidence)).select("pattern")
    return edges.join(good, "pattern").select("value").distinct()


def spans(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    labels: tuple[str, ...] = LABELS,
    rounds: int = 3,
    support: int = 3,
    confidence: float = 0.6,
    doubt: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all rows, and the spans (row, kind, start, end): base ones, and those discovered beside them."""
    rows, placed = matches(docs, id_col, text_col)
    placed = saved(placed, "pii-placed")
    # Tokens that touch a base span stay part of that span: look at the spans before and after in order of place.
    order = Window.partitionBy("row").orderBy("start", "end")
    token = F.col("kind").isin(*TOKENS)
    base_end, base_start = (F.when(~token, F.col(c)) for c in ("end", "start"))
    before = F.max(base_end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    backward = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"))  # a frame up to the end would be read anew for each row
    after = F.min(base_start).over(backward.rowsBetween(Window.unboundedPreceding, -1))
    free = saved(placed.withColumn("before", before).withColumn("after", after).where(token & F.expr("coalesce(before, 0) <= start AND coalesce(after, end) >= end")).drop("before", "after"), "pii-free")
    own = F.when(F.col("kind") == "card", F.regexp_replace("value", "[ -]", "")).otherwise(F.col("value"))
    base = placed.where(~token)
    found = discovered(free, base.withColumn("value", own), labels=labels, rounds=rounds, support=support, confidence=confidence, doubt=doubt)
    taken = free.join(found, "value", "left_semi")
    wider = F.max("end").over(Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    extra = taken.withColumn("wider", wider).where("wider IS NULL OR wider < end").select("row", F.lit("id").alias("kind"), "start", "end")
    return rows, base.select("row", "kind", "start", "end").unionByName(extra)


def digest(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, hash of the base spans, all spans, number discovered."""
    number = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END")
    listed = F.array_sort(F.collect_list(F.struct("start", number.alias("n"), "end", "kind")))
    per = found.groupBy("row").agg(listed.alias("s"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = text(F.filter("s", lambda x: x["kind"] != "id"))
    out = rows.join(per, "row", "left")
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:-1]],
        F.sha2(F.coalesce(base, F.lit("")), 256).alias("base_sha256"), F.coalesce(text(F.col("s")), F.lit("")).alias("spans"),
        F.coalesce("n_id", F.lit(0)).cast("long").alias("n_id"),
    )
