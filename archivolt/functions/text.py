"""Column functions for text: white space, normal forms, names, pages, token sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as Python's str.isspace has it, in a form that Java and RE2 both read; Han characters.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANKS = "".join(chr(i) for i in (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
HAN = r"[\x{4e00}-\x{9fff}]"
ADMIN_SUFFIX = "省市县区镇乡村州"
PUNCTUATION = "，。、“”‘’（）《》〈〉【】—…·,.()[]<>\"'-_/"
PUNCTUATION_TOC = PUNCTUATION + "．；：！？;:!?"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
WORD = r"[\p{L}\p{N}_]{2,}"


def sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def clean_ocr_text(c: Column, letter: str = HAN) -> Column:
    """Joins letters that a scan parted, squeezes blank lines, drops page numbers, strips."""
    c = sub(c, rf"(?<={letter}){SPACE}+(?={letter})", "")
    c = sub(sub(c, r"\n{3,}", "\n\n"), r"\n\d{1,4}\n", "\n")
    return strip(c)


def apply_fixes(c: Column, fixes: Sequence[tuple[str, str]], rounds: int = 10) -> Column:
    """Replaces wrong strings, longest first, again and again until nothing changes, at most `rounds` times."""
    order = sorted(((a, b) for a, b in fixes if a and a != b), key=lambda p: -len(p[0]))

    def once(s: Column) -> Column:
        for wrong, right in order:
            s = F.replace(s, F.lit(wrong), F.lit(right))
        return s

    def step(held: Column, _: Column) -> Column:
        return F.when(held["now"] == held["before"], held).otherwise(F.struct(once(held["now"]).alias("now"), held["now"].alias("before")))

    start = F.struct(c.alias("now"), F.lit(None).cast("string").alias("before"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda held: held["now"])


def conversion_stats(rows: DataFrame, old: str, new: Column) -> DataFrame:
    """files, changed, chars_before, chars_after of a conversion of a column."""
    r = rows.select(F.col(old).alias("_old"), new.alias("_new"))
    return r.agg(F.count("*").alias("files"), F.count_if(F.col("_new") != F.col("_old")).alias("changed"), F.sum(F.length("_old")).alias("chars_before"), F.sum(F.length("_new")).alias("chars_after"))


def guarded(old: Column, new: Column, low: float = 0.9, high: float = 1.12) -> Column:
    """Whether a proposed text is taken: not blank, not the same, and its length within a ratio of the old one's."""
    return F.coalesce((F.trim(new) != "") & (new != old) & (F.length(new) / F.greatest(F.length(old), F.lit(1))).between(low, high), F.lit(False))


def guard_counts(rows: DataFrame, old: str, new: str, edits: str) -> DataFrame:
    """changed, failed (blank or missing proposals), edits (of those taken) and total."""
    ok = guarded(F.col(old), F.col(new))
    return rows.agg(F.count_if(ok).alias("changed"), F.count_if(F.col(new).isNull() | (F.trim(new) == "")).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col(edits))), F.lit(0)).alias("edits"), F.count("*").alias("total"))


def ocr_quality(rows: DataFrame, column: str, run: str = rf"{HAN}{{10,}}", letter: str = HAN) -> DataFrame:
    """letters (Han by default), alnum, noise per cent and the start of the first long run, noisiest first."""
    c = F.col(column)
    count = lambda p: F.length(F.regexp_replace(c, p, "")).cast("long")
    alnum = count("[^A-Za-z0-9]")
    out = rows.withColumn("letters", (F.length(c) - count(letter)).cast("long")).withColumn("alnum", alnum)
    return out.withColumn("noise", F.bround(alnum * F.lit(100.0) / F.greatest(F.length(c), F.lit(1)), 6)).withColumn("run", F.substring(F.regexp_extract(c, run, 0), 1, 70)).orderBy(F.desc("noise"))


def any_of(c: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)), F.lit(False))


def first_of(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """The value of the first pair, in order, whose word the text contains; null if none."""
    out = F.when(F.contains(c, F.lit(pairs[0][0])), F.lit(pairs[0][1]))
    for word, value in pairs[1:]:
        out = out.when(F.contains(c, F.lit(word)), F.lit(value))
    return out


def mentioned(c: Column, names: Sequence[str]) -> Column:
    """The names that the text contains, by their first place, then in order of the list."""
    every = F.array(*[F.lit(x) for x in names])
    found = F.transform(found_terms(c, names), lambda n: F.struct(F.position(n, c).alias("at"), F.array_position(every, n).alias("i"), n.alias("name")))
    return F.transform(F.array_sort(found), lambda x: x["name"])


def slots(rows: DataFrame, column: str, flags: dict[str, Sequence[str]], cities: Sequence[str], modes: dict[str, Sequence[str]], stages: Sequence[tuple[str, str]], sites: Sequence[str], days: str = r"(\d+)\s*天") -> DataFrame:
    """Adds a boolean per flag, days, city (first of the list), mode (first with a word), stage (first alias) and sites."""
    c = F.coalesce(F.col(column), F.lit(""))
    out = rows
    for name, words_ in flags.items():
        out = out.withColumn(name, any_of(c, words_))
    out = out.withColumn("days", F.nullif(F.regexp_extract(c, days, 1), F.lit("")).try_cast("int"))
    out = out.withColumn("city", first_of(c, [(x, x) for x in cities]))
    out = out.withColumn("mode", first_of(c, [(w, m) for m, ws in modes.items() for w in ws]))
    return out.withColumn("stage", first_of(c, stages)).withColumn("sites", mentioned(c, sites))


def found_terms(c: Column, terms: Sequence[str]) -> Column:
    """The terms that the text contains, in the order of the list."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))


def normalize(c: Column, punctuation: str = PUNCTUATION) -> Column:
    """Half width, no white space, none of the punctuation."""
    return sub(F.translate(F.translate(F.coalesce(c, F.lit("")), FULL_WIDTH, HALF_WIDTH), punctuation, ""), f"{SPACE}+", "")


def normalize_name(c: Column, suffixes: str = ADMIN_SUFFIX) -> Column:
    """Stripped, lower case, without one trailing suffix character."""
    return sub(F.lower(strip(F.coalesce(c, F.lit("")))), f"[{suffixes}]\\z", "")


def parse_page(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*(\d+)", 1), F.lit("")).cast("int")


def book_title(c: Column, noise: str = r"[（(\[【_]") -> Column:
    return strip(F.split(sub(c, r"\.[A-Za-z0-9]+\z", ""), noise)[0])


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def token_set(c: Column) -> Column:
    """Distinct tokens: Han runs as pairs of characters (single ones kept), other words in lower case."""
    han = F.regexp_extract_all(c, F.lit(f"{HAN}+"), F.lit(0))
    pairs = F.flatten(F.transform(han, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.array_distinct(F.concat(pairs, F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))))


def entity_id(kind: Column, name: Column) -> Column:
    """The kind's first letter and eight hexadecimal digits of a digest of kind and name."""
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.lit("_"), F.upper(F.substring(F.sha1(F.concat_ws(":", kind, name)), 1, 8)))


def field_text(title: Column, section: Column, places: Column) -> Column:
    """Title, section and places (an array) joined by blanks; nulls and empty parts are left out."""
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(section, F.lit("")), F.nullif(F.array_join(places, " "), F.lit("")))


def prefixed(rows: DataFrame, prefixes: DataFrame, key: str) -> DataFrame:
    """The rows with the text behind its prefix (key, prefix) and a line break; a blank or missing prefix changes nothing."""
    j = rows.join(prefixes.select(key, "prefix"), key, "left")
    text = F.when(F.trim(F.coalesce("prefix", F.lit(""))) != "", F.concat_ws("\n", "prefix", "text")).otherwise(F.col("text"))
    return j.select(*[text.alias("text") if c == "text" else c for c in rows.columns])


def fix_recall(rows: DataFrame, old: str, new: str, fixes: Sequence[tuple[str, str]]) -> DataFrame:
    """known and done of each row that has a known error: errors in the old text, and those that the new one has put right."""
    pairs = F.array(*[F.struct(F.lit(a).alias("wrong"), F.lit(b).alias("good")) for a, b in fixes if a])
    r = rows.withColumn("_known", F.filter(pairs, lambda x: F.contains(old, x["wrong"]))).where("size(_known) > 0")
    done = F.filter("_known", lambda x: ~F.contains(new, x["wrong"]) & F.contains(new, x["good"]))
    return r.withColumn("known", F.size("_known").cast("long")).withColumn("done", F.size(done).cast("long")).drop("_known")


def evidence(calls: DataFrame, tool: str, most: int = 5, chars: int = 1000) -> DataFrame:
    """i, text behind the other columns: the first `most` hits of each call of the tool, each cut to `chars`.

    calls: tool, result (a JSON list of texts); what cannot be read has no hits.
    """
    hits = F.posexplode(F.slice(F.from_json("result", "array<string>"), 1, most)).alias("i", "text")
    keep = [c for c in calls.columns if c not in ("tool", "result")]
    return calls.where(F.col("tool") == tool).select(*keep, hits).withColumn("text", F.substring("text", 1, chars))


def run_counts(rows: DataFrame, column: str, run: str = f"{HAN}+", low: int = 2, high: int = 8, least: int = 1) -> DataFrame:
    """run, n: all runs of letters (Han by default) of `low` to `high` characters that stand `least` times or more."""
    r = rows.select(F.explode(F.regexp_extract_all(column, F.lit(run), F.lit(0))).alias("run"))
    return r.where(F.length("run").between(low, high)).groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def fact_check(rows: DataFrame, column: str) -> DataFrame:
    """worst, confidence and verified from a JSON answer {"claims": [{"status", "severity"}]}.

    Unsupported and contradicted claims are issues; contradicted ones are high, unknown severities medium. The issues of the
    older form {"issues": [{"severity"}]} come behind them as they are; unknown severities count nothing there. Unreadable
    JSON has no issues.
    """
    said = F.from_json(F.col(column), "struct<claims: array<struct<status: string, severity: string>>, issues: array<struct<severity: string>>>")
    low = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    bad = F.filter(F.coalesce(said["claims"], F.array()), lambda x: low(x["status"]).isin("unsupported", "contradicted"))
    level = F.transform(bad, lambda x: F.when(low(x["status"]) == "contradicted", 3).when(low(x["severity"]) == "high", 3).when(low(x["severity"]) == "low", 1).otherwise(2))
    old = F.transform(F.coalesce(said["issues"], F.array()), lambda x: F.when(x["severity"] == "high", 3).when(x["severity"] == "medium", 2).when(x["severity"] == "low", 1).otherwise(0))
    r = rows.withColumn("_l", F.nullif(F.array_max(F.concat(level, old)), F.lit(0)))
    worst = F.when(F.col("_l") == 3, "high").when(F.col("_l") == 2, "medium").when(F.col("_l") == 1, "low")
    sure = F.when(F.col("_l") == 3, 0.35).when(F.col("_l") == 2, 0.6).when(F.col("_l") == 1, 0.8).otherwise(0.9)
    return r.withColumn("worst", worst).withColumn("confidence", sure).withColumn("verified", F.coalesce(F.col("_l") < 3, F.lit(True))).drop("_l")
