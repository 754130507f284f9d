"""All registered queries of the library's own operators, by operator id, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators import chunks as C
from archivolt.operators import graph as K
from archivolt.operators import search as R
from archivolt.operators import tables as G
from archivolt.operators import terms as T
from archivolt.sources import tables as S
from archivolt.sources.shared import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SP = X.SPACE
FIXES = (("thth", "th"), ("erer", "er"), ("anan", "an"), ("xx", "xx"))
TERMS = ("and", "the", "une", "der", "que")
LETTER = "[aeiou]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.replace("{SP}", SP)
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents")


def chunked(spark: SparkSession, d: str) -> DataFrame:
    return C.window_chunks(docs(spark, d))


STRIP = r"regexp_replace({}, '^{SP}+|{SP}+\z', '', 'g')"
CHUNK_SQL = rf"""t AS (SELECT doc_id, source, {STRIP.replace('{}', "regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")} AS t FROM documents),
chunks AS (SELECT doc_id, source, seq::INTEGER AS seq, substr(t, (seq * 3200 + 1)::BIGINT, 3500) AS text FROM t, LATERAL (SELECT unnest(generate_series(0, CASE WHEN length(t) <= 3500 THEN 0 ELSE ceil((length(t) - 3500) / 3200.0)::BIGINT END)) AS seq) WHERE length(t) > 0)"""


@query("t1_clean_ocr", rf"""SELECT doc_id, {STRIP.replace('{}', "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([aeiou]){SP}+([aeiou])', '\\1\\2', 'g'), '([aeiou]){SP}+([aeiou])', '\\1\\2', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\n[0-9]{1,4}\\n', chr(10), 'g')")} AS clean FROM documents""")
def t1(spark, d):
    return docs(spark, d).select("doc_id", X.clean_ocr_text(F.col("text"), LETTER).alias("clean"))


CHAIN = (*FIXES, ("abab", "aba"), ("xyx", "aa"))


@query("t3_apply_fixes", "SELECT doc_id, " + "replace(" * 50 + "text" + ", 'thth', 'th'), 'erer', 'er'), 'anan', 'an'), 'abab', 'aba'), 'xyx', 'aa')" * 10 + " AS fixed FROM documents")
def t3(spark, d):
    return docs(spark, d).select("doc_id", X.apply_fixes(F.col("text"), CHAIN).alias("fixed"))


@query("t4_fix_hits", "SELECT doc_id, (contains(text, 'thth')::INT + contains(text, 'erer')::INT + contains(text, 'anan')::INT)::INTEGER AS hits FROM documents WHERE contains(text, 'thth') OR contains(text, 'erer') OR contains(text, 'anan')")
def t4(spark, d):
    hits = F.size(X.found_terms(F.col("text"), [a for a, b in FIXES if a != b]))
    return docs(spark, d).select("doc_id", hits.alias("hits")).where("hits > 0")


@query("t5_translate_stats", "WITH c AS (SELECT text, replace(replace(translate(text, 'éèêà', 'eeea'), 'eeau', 'eau'), 'eer', 'er') AS new FROM documents) SELECT count(*) AS files, count_if(new <> text)::BIGINT AS changed, sum(length(text))::BIGINT AS chars_before, sum(length(new))::BIGINT AS chars_after FROM c")
def t5(spark, d):
    # Characters first, then phrases.
    new = X.apply_fixes(F.translate("text", "éèêà", "eeea"), (("eeau", "eau"), ("eer", "er")), rounds=1)
    return X.conversion_stats(docs(spark, d), "text", new)


@query("t6_normalize", "SELECT p_partkey, regexp_replace(translate(p_name || ' （Ａ－９）', '" + X.FULL_WIDTH.replace("'", "''") + "', '" + X.HALF_WIDTH.replace("'", "''") + "'), '{SP}+|[，。、“”‘’《》〈〉【】—…·,.()<>\"''_/\\[\\]-]', '', 'g') AS norm FROM part")
def t6(spark, d):
    return S.table(spark, d, "part").select("p_partkey", X.normalize(F.concat("p_name", F.lit(" （Ａ－９）"))).alias("norm"))


@query("t7_normalize_name", f"SELECT p_partkey, regexp_replace(lower({STRIP.replace('{}', 'p_name')}), '[gt]\\z', '') AS norm FROM part")
def t7(spark, d):
    return S.table(spark, d, "part").select("p_partkey", X.normalize_name(F.col("p_name"), "gt").alias("norm"))


@query("t8_parse_page", r"SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(substr(o_orderpriority, 1, 1) || '-' || o_orderkey, '^\s*([0-9]+)', 1), '') AS INTEGER) AS page FROM orders")
def t8(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", X.parse_page(F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"), F.col("o_orderkey").cast("string"))).alias("page"))


@query("t9_book_title", "SELECT doc_id, trim(split_part(regexp_replace(source || '_x' || doc_id || '.txt', '\\.[A-Za-z0-9]+\\z', ''), '_', 1)) AS title FROM documents")
def t9(spark, d):
    return docs(spark, d).select("doc_id", X.book_title(F.concat("source", F.lit("_x"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("title"))


@query("t10_field_text", "SELECT doc_id, concat_ws(' ', nullif(source, 'src0'), lang) AS field FROM documents")
def t10(spark, d):
    return docs(spark, d).select("doc_id", X.field_text(F.nullif("source", F.lit("src0")), F.lit(""), F.array("lang")).alias("field"))


@query("t11_prefix", "SELECT d.doc_id, CASE WHEN trim(coalesce(b.text, '')) <> '' THEN b.text || chr(10) || d.text ELSE d.text END AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def t11(spark, d):
    pre = S.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("prefix"))
    return X.prefixed(docs(spark, d).select("doc_id", "text"), pre, "doc_id")


GUARD_SQL = "p AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'the', 'th') WHEN doc_id % 3 = 1 THEN text END AS new FROM documents)"


@query("t12_correction_guard", f"WITH {GUARD_SQL}, o AS (SELECT *, new IS NOT NULL AND trim(new) <> '' AND new <> text AND length(new) / length(text) BETWEEN 0.9 AND 1.12 AS ok FROM p) SELECT count_if(ok)::BIGINT AS changed, count_if(new IS NULL OR trim(new) = '')::BIGINT AS failed, coalesce(sum(doc_id % 4) FILTER (ok), 0)::BIGINT AS edits, count(*) AS total FROM o")
def t12(spark, d):
    new = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("the"), F.lit("th"))).when(F.col("doc_id") % 3 == 1, F.col("text"))
    return X.guard_counts(docs(spark, d).withColumn("new", new).withColumn("edits", F.col("doc_id") % 4), "text", "new", "edits")


@query("t15_token_set", "SELECT conv_id, turn, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INTEGER AS tokens FROM conversations")
def t15(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.size(X.token_set(F.col("text"))).alias("tokens"))


@query("t16_ocr_quality", "SELECT doc_id, (length(text) - length(regexp_replace(text, '[a-z]', '', 'g')))::BIGINT AS letters, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS alnum, round_even(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) * 100.0::DOUBLE / greatest(length(text), 1), 6) AS noise, substr(regexp_extract(text, '[a-z]{10,}'), 1, 70) AS run FROM documents")
def t16(spark, d):
    return X.ocr_quality(docs(spark, d), "text", "[a-z]{10,}", "[a-z]").select("doc_id", "letters", "alnum", "noise", "run")


@query("t17_trace_text", "SELECT doc_id, regexp_replace(translate(text, 'éè', 'ee'), '[^a-zA-Z0-9\\x{4e00}-\\x{9fff}]', '', 'g') AS trace FROM documents")
def t17(spark, d):
    return docs(spark, d).select("doc_id", X.sub(F.translate("text", "éè", "ee"), r"[^a-zA-Z0-9\x{4e00}-\x{9fff}]", "").alias("trace"))


FLAGS = {"asks_route": ("the", "route"), "compares": ("than", "other"), "is_chat": ("hello",)}
PLACES = ("que", "der", "une", "and", "the")


@query("t20_intents", r"""SELECT conv_id, turn, contains(text, 'the') OR contains(text, 'route') AS asks_route, contains(text, 'than') OR contains(text, 'other') AS compares, contains(text, 'hello') AS is_chat,
TRY_CAST(nullif(regexp_extract(text, '([0-9]+)\s*days?', 1), '') AS INTEGER) AS days, CASE WHEN contains(text, 'une') THEN 'une' WHEN contains(text, 'der') THEN 'der' WHEN contains(text, 'ing') THEN 'ing' END AS city,
CASE WHEN contains(text, 'air') OR contains(text, 'aux') THEN 'air' WHEN contains(text, 'rail') OR contains(text, 'ent') THEN 'rail' END AS mode, CASE WHEN contains(text, 'tion') THEN 'first' WHEN contains(text, 'ung') THEN 'second' WHEN contains(text, 'cion') THEN 'first' END AS stage,
array_to_string(list_transform(list_sort(list_filter(list_transform(['que', 'der', 'une', 'and', 'the'], lambda x, i: struct_pack(at := instr(text, x), i := i, x := x)), lambda s: s.at > 0)), lambda s: s.x), ',') AS sites FROM conversations""")
def t20(spark, d):
    c = X.slots(S.table(spark, d, "conversations"), "text", FLAGS, ("une", "der", "ing"), {"air": ("air", "aux"), "rail": ("rail", "ent")}, (("tion", "first"), ("ung", "second"), ("cion", "first")), PLACES, r"(\d+)\s*days?")
    return c.select("conv_id", "turn", *FLAGS, "days", "city", "mode", "stage", F.array_join("sites", ",").alias("sites"))


@query("c1_line_chunks")
def c1(spark, d):
    return C.line_chunks(docs(spark, d))


@query("c2_window_chunks", f"WITH {CHUNK_SQL} SELECT doc_id, source, seq, text FROM chunks")
def c2(spark, d):
    return chunked(spark, d)


@query("c3_body_samples", """WITH b AS (SELECT doc_id, substr(text, trunc(length(text) * 12 / 100)::BIGINT + 1) AS body FROM documents),
i AS (SELECT doc_id, body, unnest([0, 1, 2]) AS i FROM b), s AS (SELECT doc_id, i, body, greatest(0, least(i * (length(body) // 3), length(body) - 400))::INTEGER AS start FROM i)
SELECT doc_id, i, start, substr(body, start + 1, 400) AS text FROM s""")
def c3(spark, d):
    return C.body_samples(docs(spark, d))


BARE_SQL = r"""regexp_replace({}, '[\s,.()\[\]<>"''_/;:!?-]', '', 'g')"""


@query("c4_match_book", f"""WITH t AS (SELECT p_partkey AS ord, p_name AS title, {BARE_SQL.format("p_name")} AS tn FROM part), f AS (SELECT p_partkey AS fid, {BARE_SQL.format("CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 3) ELSE p_brand || ' (' || p_name || '), x.txt' END")} AS fn FROM part),
m AS (SELECT fid, title, row_number() OVER (PARTITION BY fid ORDER BY length(tn) DESC, ord) AS r FROM f JOIN t ON contains(fn, tn) OR contains(tn, fn) WHERE fn <> '' AND tn <> '') SELECT fid AS p_partkey, title FROM m WHERE r = 1""")
def c4(spark, d):
    part, w = S.table(spark, d, "part"), F.split("p_name", " ")
    part_of = F.concat_ws("-", F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.coalesce(F.get(w, F.lit(2)), F.lit("")))
    name = F.when(F.col("p_partkey") % 5 == 0, part_of).otherwise(F.concat("p_brand", F.lit(" ("), "p_name", F.lit("), x.txt")))
    titles = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"))
    return C.match_book(part.select(F.col("p_partkey").alias("fid"), name.alias("name")), titles).withColumnRenamed("fid", "p_partkey")


@query("c8_place_tags", "SELECT doc_id, array_to_string(list_filter(['and', 'the', 'une', 'der', 'que'], lambda w: contains(text, w)), ',') AS locations FROM documents")
def c8(spark, d):
    return C.tag_places(docs(spark, d), TERMS).select("doc_id", F.array_join("locations", ",").alias("locations"))


@query("c9_postings", f"WITH {CHUNK_SQL} SELECT place, doc_id, seq FROM chunks, (SELECT unnest(['and', 'the', 'une', 'der', 'que']) AS place) WHERE contains(text, place)")
def c9(spark, d):
    return C.postings(C.tag_places(chunked(spark, d), TERMS))


@query("c10_corpus_stats", f"WITH {CHUNK_SQL} SELECT source, count(*) AS chunks, floor(sum(length(text)) / count(*))::BIGINT AS avg_chars FROM chunks GROUP BY source")
def c10(spark, d):
    return C.corpus_stats(chunked(spark, d))


@query("c5_section_of", """WITH toc AS (SELECT source AS book, doc_id AS ord, 'item' || doc_id AS item, CASE WHEN doc_id % 7 <> 0 THEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) * 3)::INTEGER END AS page FROM documents),
r AS (SELECT *, coalesce(lead(page IGNORE NULLS) OVER (PARTITION BY book ORDER BY ord), max(page) OVER (PARTITION BY book) + 1) AS stop FROM toc),
c AS (SELECT source AS book, doc_id AS chunk_id, (doc_id % 50)::INTEGER AS page FROM documents)
SELECT c.book, c.chunk_id, c.page, min_by(r.item, r.ord) AS section FROM c LEFT JOIN r ON c.book = r.book AND r.page IS NOT NULL AND c.page >= r.page AND c.page < r.stop GROUP BY ALL""")
def c5(spark, d):
    from pyspark.sql import Window

    x = docs(spark, d)
    page = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) * 3).cast("int")
    toc = x.select(F.col("source").alias("book"), F.col("doc_id").alias("ord"), F.concat(F.lit("item"), F.col("doc_id").cast("string")).alias("item"), F.when(F.col("doc_id") % 7 != 0, page).alias("page"))
    return C.section_of(x.select(F.col("source").alias("book"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).cast("int").alias("page")), toc)


APPROX_SQL = """n AS (SELECT doc_id AS book, length(text) AS n FROM documents WHERE text IS NOT NULL), toc AS (SELECT book, o AS ord, 'item' || o AS item, CASE WHEN (book + o) % 4 <> 0 AND book % 9 <> 0 THEN o * o * 3 END::INTEGER AS page FROM n, (SELECT unnest([1, 2, 3, 4, 5]) AS o)),
r AS (SELECT *, coalesce(lead(page IGNORE NULLS) OVER (PARTITION BY book ORDER BY ord), max(page) OVER (PARTITION BY book) + 1) AS stop FROM toc), e AS (SELECT book, min(page) AS lo, max(page) AS hi FROM toc GROUP BY book),
c AS (SELECT book, unnest(generate_series(0, n // 500))::INTEGER AS chunk_id, n FROM n),
p AS (SELECT book, chunk_id, round_even(lo + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (chunk_id * 500 - n * 0.03::DOUBLE) / greatest(n * (1 - 0.03::DOUBLE), 1.0::DOUBLE))) * (hi - lo), 0)::INTEGER AS page FROM c JOIN e USING (book)),
a AS (SELECT p.book, p.chunk_id, min_by(item, ord) AS section, CASE WHEN min(ord) IS NOT NULL THEN any_value(p.page) END AS page, CASE WHEN min(ord) IS NOT NULL THEN 'approx' END AS how FROM p LEFT JOIN r ON r.book = p.book AND r.page IS NOT NULL AND p.page >= r.page AND p.page < r.stop GROUP BY p.book, p.chunk_id)"""


def approximate(spark, d):
    n = docs(spark, d).select(F.col("doc_id").alias("book"), F.length("text").alias("length")).where("length IS NOT NULL")
    page = F.when(((F.col("book") + F.col("ord")) % 4 != 0) & (F.col("book") % 9 != 0), F.col("ord") * F.col("ord") * 3)
    toc = n.select("book", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ord")).select("book", "ord", F.concat(F.lit("item"), F.col("ord").cast("string")).alias("item"), page.cast("int").alias("page"))
    chunks = n.withColumn("chunk_id", F.explode(F.sequence(F.lit(0), F.expr("CAST(length DIV 500 AS INT)")))).withColumn("offset", F.col("chunk_id") * 500)
    return C.approx_annotated(chunks, toc)


@query("c5_approx_annotated", f"WITH {APPROX_SQL} SELECT book, chunk_id, section, page, how FROM a")
def c5_approx(spark, d):
    return approximate(spark, d)


@query("c10_annotated_share", f"WITH {APPROX_SQL} SELECT book, count(*) AS chunks, count(page) AS with_page, count(section) AS with_section, round(count(section) / count(*), 4) AS share FROM a GROUP BY book")
def c10_share(spark, d):
    return C.annotated_share(approximate(spark, d))


@query("c10_place_counts", f"WITH {CHUNK_SQL} SELECT place, count(*) AS n FROM chunks, (SELECT unnest(['and', 'the', 'une', 'der', 'que']) AS place) WHERE contains(text, place) GROUP BY place")
def c10_places(spark, d):
    return C.place_counts(C.postings(C.tag_places(chunked(spark, d), TERMS)))


@query("c10_totals", f"WITH {CHUNK_SQL} SELECT count(*) AS chunks, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 4) AS mean_chars FROM chunks")
def c10_totals(spark, d):
    return C.totals(chunked(spark, d))


WORD_LIST = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
WORD_TERMS = "list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)"
CHAR_LIST = "list_transform(list_filter(string_split_regex(lower(text), '{SP}+'), lambda p: p <> ''), lambda p: ' ' || p || ' ')"
CHAR_TERMS = "flatten(list_transform(w, lambda p: list_concat(" + ", ".join(f"list_transform(range(1, length(p) - {n - 2}), lambda i: substr(p, i, {n}))" for n in (2, 3, 4)) + ")))"


def tf_sql(listed: str = WORD_LIST, terms: str = WORD_TERMS, tf: str = "tf", most: int = 8000) -> str:
    """Counts, vocabulary, norms and index over `units`."""
    return f"""w AS (SELECT unit, {listed} AS w FROM units), x AS (SELECT unit, unnest({terms}) AS term FROM w),
tf AS (SELECT unit, term, count(*) AS tf FROM x GROUP BY ALL),
v AS (SELECT term, sum(tf) AS n, count(*) AS df FROM tf GROUP BY term ORDER BY n DESC, term LIMIT {most}),
i AS (SELECT term, df, ln((1 + (SELECT count(*) FROM units)) / (1 + df)) + 1 AS idf FROM v),
raw AS (SELECT unit, term, {tf} * idf AS x FROM tf JOIN i USING (term)), nrm AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM raw GROUP BY unit),
ix AS (SELECT unit, term, x / norm AS w FROM raw JOIN nrm USING (unit))"""


def search_sql(listed: str = WORD_LIST, terms: str = WORD_TERMS, tf: str = "tf", most: int = 8000) -> str:
    """The ranked lists rk of the benchmark's items over `units`."""
    return tf_sql(listed, terms, tf, most) + f""",
qx AS (SELECT item_id AS qid, {listed} AS w FROM benchmark), qt AS (SELECT qid, unnest({terms}) AS term FROM qx),
qf AS (SELECT qid, term, count(*) AS tf FROM qt GROUP BY ALL), qr AS (SELECT qid, term, {tf} * idf AS x FROM qf JOIN i USING (term)),
qn AS (SELECT qid, sqrt(sum(x * x)) AS norm FROM qr GROUP BY qid), q AS (SELECT qid, term, x / norm AS qw FROM qr JOIN qn USING (qid)),
sc AS (SELECT qid, unit, round(sum(w * qw), 6) AS score FROM ix JOIN q USING (term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit)::INTEGER AS rank FROM sc)"""


UNITS = "units AS (SELECT doc_id AS unit, text FROM documents)"
TF_SQL, SEARCH_SQL = tf_sql(), search_sql()
CHAR = (CHAR_LIST, CHAR_TERMS, "(1 + ln(tf))")


def text_units(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("unit"), "text")


def questions(spark, d):
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("unit"), "text")


def search(spark, d, k=5, units=None, terms=T.WORD, most=8000, sublinear=False):
    """The benchmark's items against the units: ranked lists over the shared terms."""
    return R.searched(text_units(spark, d) if units is None else units, questions(spark, d), terms, most, k, sublinear, saved)


def char_search(spark, d, k=5, units=None, most=3000):
    return search(spark, d, k, units, T.CHAR, most, True)


@query("r1_char_tfidf", f"WITH {UNITS}, {tf_sql(*CHAR, 3000)} SELECT unit, term, round(w, 6) AS w FROM ix")
def r1(spark, d):
    return R.weights(text_units(spark, d), T.CHAR, 3000, True, saved)[1].select("unit", "term", F.round("w", 6).alias("w"))


@query("r2_word_tfidf", f"WITH {UNITS}, {TF_SQL} SELECT unit, term, round(w, 6) AS w FROM ix")
def r2(spark, d):
    return R.weights(text_units(spark, d), T.WORD, 8000, save=saved)[1].select("unit", "term", F.round("w", 6).alias("w"))


@query("r5_cosine_top_k", f"WITH {UNITS}, {SEARCH_SQL} SELECT qid, unit, score, rank FROM rk WHERE rank <= 5")
def r5(spark, d):
    return search(spark, d)


NAMES = "units AS (SELECT p_partkey AS unit, p_name AS text FROM part)"


@query("r5_zero_filled", f"""WITH {NAMES}, {SEARCH_SQL}, every AS (SELECT item_id AS qid, unit FROM benchmark, units),
s AS (SELECT qid, unit, coalesce(score, 0) AS score FROM every LEFT JOIN sc USING (qid, unit)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit)::INTEGER AS rank FROM s) SELECT qid, unit, score, rank FROM r WHERE rank <= 5""")
def r5_filled(spark, d):
    # Few items share a word with a part's name: most lists are filled.
    names = S.table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_name").alias("text"))
    return R.zero_filled(search(spark, d, 5, names), questions(spark, d).select(F.col("unit").alias("qid")), names, 5)


@query("r7_dense_top_k", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v JOIN v q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def r7(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.dense_top_k(e, e.where(F.col("vec_id") % 100 == 0), 5)


LEGS_SQL = "legs AS (SELECT l AS leg, c_nationkey AS qid, c_custkey % 50 AS unit, row_number() OVER (PARTITION BY l, c_nationkey ORDER BY c_acctbal * (1 + l), c_custkey)::INTEGER AS rank, CASE l WHEN 0 THEN 1.0 ELSE 0.5 END AS weight FROM (SELECT c_nationkey, c_custkey % 50 AS c_custkey, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1, 2), (SELECT unnest([0, 1])::INTEGER AS l))"


def ranked_legs(spark, d):
    """Two rankings a nation over all customers: a unit is a group of them, its rank that of its best balance."""
    from pyspark.sql import Window

    c = S.table(spark, d, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 50).alias("unit")).agg(F.max("c_acctbal").alias("best")).withColumn("leg", F.explode(F.array(F.lit(0), F.lit(1))))
    rank = F.row_number().over(Window.partitionBy("leg", "c_nationkey").orderBy(F.col("best") * (1 + F.col("leg")), "unit"))
    return c.select("leg", F.col("c_nationkey").alias("qid"), "unit", rank.alias("rank"), F.when(F.col("leg") == 0, 1.0).otherwise(0.5).alias("weight"))


@query("r8_rank_fusion", f"WITH {LEGS_SQL}, f AS (SELECT qid, unit, round(sum(weight::DOUBLE / (60 + rank)), 9) AS score, min(struct_pack(leg := leg, rank := rank)) AS first FROM legs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, unit)::INTEGER AS rank FROM f) SELECT qid, unit, score, rank FROM r WHERE rank <= 5")
def r8(spark, d):
    return R.fuse(ranked_legs(spark, d))


TURN_ORDER = "turn, role, text"


@query("r11_query_context", f"WITH t AS (SELECT *, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY {TURN_ORDER} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS b FROM conversations) SELECT conv_id, turn, concat_ws(chr(10), nullif(array_to_string(b, chr(10)), ''), text) AS query FROM t WHERE role = 'user'")
def r11(spark, d):
    return G.context(S.table(spark, d, "conversations"))


@query("e3_gold_metrics", f"""WITH {UNITS}, {SEARCH_SQL}, g AS (SELECT b.item_id AS qid, d.doc_id AS unit FROM benchmark b LEFT JOIN documents d ON contains(d.text, substr(b.text, 21, 40))),
h AS (SELECT g.qid, min(rk.rank) AS r FROM g LEFT JOIN rk ON rk.qid = g.qid AND rk.unit = g.unit AND rk.rank <= 5 GROUP BY g.qid)
SELECT count(*) AS questions, round(avg((coalesce(r, 99) <= 1)::INT), 4) AS hit_1, round(avg((coalesce(r, 99) <= 3)::INT), 4) AS hit_3, round(avg((coalesce(r, 99) <= 5)::INT), 4) AS hit_5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr FROM h""")
def e3(spark, d):
    b = questions(spark, d).select(F.col("unit").alias("qid"), F.substring("text", 21, 40).alias("anchor"))
    return R.gold_metrics(search(spark, d), R.holders(b, text_units(spark, d)))


@query("e7_confusion", """WITH p AS (SELECT source, quality AS predicted, 1 - toxic AS actual FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, count_if(predicted = 1 AND actual = 1)::BIGINT AS tp, count_if(predicted = 1 AND actual <> 1)::BIGINT AS fp, count_if(predicted <> 1 AND actual = 1)::BIGINT AS fn, count_if(predicted <> 1 AND actual <> 1)::BIGINT AS tn FROM p GROUP BY source),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c)
SELECT source, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM m""")
def e7(spark, d):
    j = docs(spark, d).join(S.table(spark, d, "labels"), "doc_id").select("source", F.col("quality").alias("predicted"), (1 - F.col("toxic")).alias("actual"))
    return R.confusion(j, "source")


@query("e8_calibration", """WITH p AS (SELECT CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 7 % 101) / 100.0::DOUBLE END AS c, quality AS label FROM labels) SELECT least(floor(c * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(c), 6) AS mean_confidence, round(avg(label), 6) AS accuracy, round(abs(avg(c) - avg(label)), 6) AS gap FROM p WHERE c IS NOT NULL GROUP BY 1""")
def e8(spark, d):
    return R.calibration(S.table(spark, d, "labels").select(F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") * 7 % 101) / F.lit(100.0)).alias("confidence"), F.col("quality").alias("label")))


@query("e9_latency", "WITH x AS (SELECT event_type AS path, value, event_id % 7 = 0 AS flag FROM events), a AS (SELECT * FROM x UNION ALL SELECT 'all', value, flag FROM x) SELECT path, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi, count_if(flag)::BIGINT AS flagged FROM a GROUP BY 1")
def e9(spark, d):
    return G.latency(timed(spark, d))


def timed(spark, d):
    return S.table(spark, d, "events").select(F.col("event_type").alias("path"), F.col("value").alias("seconds"), (F.col("event_id") % 7 == 0).alias("flag"))


@query("e9_difference", "SELECT round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'error'), 6) AS difference FROM events")
def e9_difference(spark, d):
    return G.path_difference(timed(spark, d), "click", "error")


@query("v1_run_counts", "WITH r AS (SELECT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS run FROM documents) SELECT run, count(*) AS n FROM r WHERE length(run) BETWEEN 2 AND 8 GROUP BY run HAVING count(*) >= 3")
def v1(spark, d):
    return X.run_counts(docs(spark, d), "text", r"[\p{L}]+", least=3)


@query("k1_dictionary_mentions", "WITH e AS (SELECT DISTINCT p_name AS name, lower(p_brand) AS alias FROM part UNION SELECT unnest(['the', 'and the', 'une']), 'der'), p AS (SELECT name, name AS part FROM e UNION SELECT name, alias FROM e) SELECT DISTINCT doc_id, name FROM documents JOIN p ON contains(text, part)")
def k1(spark, d):
    own = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("the", "and the", "une")])).alias("name"), F.lit("der").alias("alias"))
    return K.dictionary_mentions(docs(spark, d), S.table(spark, d, "part").select(F.col("p_name").alias("name"), F.lower("p_brand").alias("alias")).distinct().union(own))


@query("k3_date_mentions", r"SELECT doc_id, lpad(regexp_extract(m, '([0-9]+)\.([0-9]+)\.([0-9]+)', 1), 4, '0') || '-' || lpad(regexp_extract(m, '([0-9]+)\.([0-9]+)\.([0-9]+)', 2), 2, '0') || '-' || lpad(regexp_extract(m, '([0-9]+)\.([0-9]+)\.([0-9]+)', 3), 2, '0') AS iso FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+')) AS m FROM documents)")
def k3(spark, d):
    return K.date_mentions(docs(spark, d), r"([0-9]+)\.([0-9]+)\.([0-9]+)")


@query("k5_coerced_type", "SELECT p_partkey, CASE WHEN p_type IN ('STANDARD BRASS') THEN p_type WHEN contains(p_type, 'STEEL') THEN 'metal' WHEN contains(p_type, 'SMALL') THEN 'small' ELSE 'other' END AS kind FROM part")
def k5(spark, d):
    return S.table(spark, d, "part").select("p_partkey", K.coerced_type(F.col("p_type"), ("STANDARD BRASS",), (("STEEL", "metal"), ("SMALL", "small"))).alias("kind"))


@query("k6_entity_id", "SELECT p_partkey, upper(substr(p_type, 1, 1)) || '_' || upper(substr(sha1(p_type || ':' || p_name), 1, 8)) AS id FROM part")
def k6(spark, d):
    return S.table(spark, d, "part").select("p_partkey", X.entity_id(F.col("p_type"), F.col("p_name")).alias("id"))


@query("k7_validated", "WITH m AS (SELECT p_partkey, p_name AS name, regexp_replace(lower(trim(p_name)), '[省市县区镇乡村州]\\z', '') AS key FROM part), f AS (SELECT key, count(*) AS freq FROM m GROUP BY key) SELECT p_partkey, key, freq, concat_ws(',', CASE WHEN length(name) < 2 THEN 'short' END, CASE WHEN length(name) > 24 THEN 'long' END, CASE WHEN freq = 1 THEN 'rare' END) AS issues, CASE WHEN length(name) < 2 OR length(name) > 24 OR freq = 1 THEN 0.55::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM m JOIN f USING (key)")
def k7(spark, d):
    m = S.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.lit(None).cast("double").alias("confidence"))
    return K.validated(m).select("p_partkey", "key", "freq", "issues", "confidence")


ITEMS_SQL = "it AS (SELECT p_partkey AS ord, p_partkey <= 20 AS is_base, lower(split_part(p_name, ' ', 1)) AS name_key, [lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2))] AS keys FROM part)"


@query("k10_resolve", f"""WITH RECURSIVE {ITEMS_SQL}, o AS (SELECT key, min(ord) AS first FROM (SELECT ord, unnest(keys) AS key FROM it) WHERE key <> '' GROUP BY key),
p AS (SELECT it.ord, CASE WHEN is_base OR name_key = '' OR first IS NULL OR first >= it.ord THEN it.ord ELSE first END AS parent FROM it LEFT JOIN o ON o.key = it.name_key),
c AS (SELECT ord, parent AS root FROM p UNION SELECT c.ord, p.parent FROM c JOIN p ON p.ord = c.root WHERE p.parent <> c.root) SELECT ord, min(root) AS root FROM c GROUP BY ord""")
def k10(spark, d):
    part = S.table(spark, d, "part")
    w = F.split(F.lower("p_name"), " ")
    items = part.select(F.col("p_partkey").alias("ord"), (F.col("p_partkey") <= 20).alias("is_base"), F.get(w, F.lit(0)).alias("name_key"), F.array(F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit(""))).alias("keys"))
    return K.resolve(items, saver(spark))


@query("k10_merged", f"""WITH RECURSIVE {ITEMS_SQL}, o AS (SELECT key, min(ord) AS first FROM (SELECT ord, unnest(keys) AS key FROM it) WHERE key <> '' GROUP BY key),
p AS (SELECT it.ord, CASE WHEN is_base OR name_key = '' OR first IS NULL OR first >= it.ord THEN it.ord ELSE first END AS parent FROM it LEFT JOIN o ON o.key = it.name_key),
c AS (SELECT ord, parent AS root FROM p UNION SELECT c.ord, p.parent FROM c JOIN p ON p.ord = c.root WHERE p.parent <> c.root), g AS (SELECT ord, min(root) AS root FROM c GROUP BY ord),
al AS (SELECT g.root, it.keys[2] AS alias, min(it.ord) AS fst FROM g JOIN it USING (ord) WHERE it.keys[2] <> '' GROUP BY ALL), la AS (SELECT root, string_agg(alias, ',' ORDER BY fst) AS aliases FROM al GROUP BY root),
de AS (SELECT g.root, min_by(p_type, p_partkey) AS told FROM g JOIN part ON p_partkey = g.ord WHERE p_partkey % 3 = 0 GROUP BY g.root)
SELECT CASE WHEN p_partkey <= 20 THEN 'B' || p_partkey ELSE upper(substr(p_type, 1, 1)) || '_' || upper(substr(sha1(p_type || ':' || split_part(p_name, ' ', 1)), 1, 8)) END AS id, split_part(p_name, ' ', 1) AS name, coalesce(aliases, '') AS aliases, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE told END AS description, CASE WHEN p_partkey <= 20 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence
FROM part JOIN g ON g.ord = p_partkey AND g.root = p_partkey LEFT JOIN la ON la.root = p_partkey LEFT JOIN de ON de.root = p_partkey""")
def k10_merged(spark, d):
    w, key = F.split("p_name", " "), F.col("p_partkey")
    items = S.table(spark, d, "part").select(key.alias("ord"), (key <= 20).alias("is_base"), F.concat(F.lit("B"), key.cast("string")).alias("id"), F.get(w, F.lit(0)).alias("name"), F.col("p_type").alias("type"), F.array(F.lower(F.coalesce(F.get(w, F.lit(1)), F.lit("")))).alias("aliases"), F.when(key % 3 == 0, F.col("p_type")).alias("description"), F.when(key <= 20, 0.9).alias("confidence"))
    return K.merged_entities(items, k10(spark, d)).select("id", "name", F.array_join("aliases", ",").alias("aliases"), "description", "confidence")


def saver(spark):
    """Cuts the lineage of each round of an iteration: a table in the shared folder."""
    return saved


@query("k12_exact_duplicates", "WITH e AS (SELECT 'P' || p_partkey AS id, p_partkey AS ord, regexp_replace(lower(p_name), '{SP}+', '', 'g') AS key FROM part) SELECT key, count(*) AS n, min_by(id, ord) AS keep_id FROM e GROUP BY key HAVING count(*) > 1")
def k12(spark, d):
    return K.exact_duplicates(S.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name")))


@query("k13_near_pairs", "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT x.name AS a, y.name AS b, levenshtein(x.name, y.name)::INTEGER AS distance FROM n x JOIN n y ON x.name < y.name AND levenshtein(x.name, y.name) <= 2")
def k13(spark, d):
    return K.near_pairs(S.table(spark, d, "part").select(F.col("p_name").alias("name")))


DECIDED_SQL = "dc AS (SELECT c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'remove' WHEN 1 THEN 'rename' ELSE 'approve' END AS action FROM customer WHERE c_custkey % 5 < 2 UNION ALL SELECT 'nobody ' || n_nationkey, 'remove' FROM nation)"


def decided(spark, d):
    c, k = S.table(spark, d, "customer"), F.col("c_custkey")
    act = F.when(k % 4 == 0, "remove").when(k % 4 == 1, "rename").otherwise("approve")
    said = c.where("c_custkey % 5 < 2").select(F.col("c_name").alias("name"), act.alias("action"), F.lower("c_name").alias("canonical_name"))
    none = S.table(spark, d, "nation").select(F.concat(F.lit("nobody "), F.col("n_nationkey").cast("string")).alias("name"), F.lit("remove").alias("action"), F.lit(None).cast("string").alias("canonical_name"))
    return c.select(k.alias("id"), F.col("c_name").alias("name")), said.union(none)


@query("k16_reviewed", f"WITH {DECIDED_SQL} SELECT c_custkey AS id, CASE WHEN action = 'rename' THEN lower(c_name) ELSE c_name END AS name, coalesce(action, 'pending') AS status FROM customer LEFT JOIN dc ON dc.name = c_name WHERE action IS NULL OR action <> 'remove'")
def k16(spark, d):
    return K.reviewed(*decided(spark, d))


@query("k16_relations", f"WITH {DECIDED_SQL}, gone AS (SELECT c_custkey AS id FROM customer JOIN dc ON dc.name = c_name WHERE action = 'remove') SELECT o_orderkey AS rid, o_custkey AS source, o_custkey + 1 AS target FROM orders WHERE o_custkey NOT IN (SELECT id FROM gone) AND o_custkey + 1 NOT IN (SELECT id FROM gone)")
def k16_relations(spark, d):
    r = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("source"), (F.col("o_custkey") + 1).alias("target"))
    return K.reviewed_relations(r, *decided(spark, d)).select("rid", "source", "target")


@query("k16_stats", f"WITH {DECIDED_SQL} SELECT CASE WHEN c_custkey IS NULL THEN 'missing' ELSE action END AS action, count(*) AS n FROM dc LEFT JOIN customer ON c_name = dc.name GROUP BY 1")
def k16_stats(spark, d):
    return K.review_stats(*decided(spark, d))


@query("k13_near_duplicates")
def k13_ratio(spark, d):
    part = S.table(spark, d, "part")
    return K.near_duplicates(part.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")))


@query("k18_problems", "SELECT 'dangling_source' AS problem, o_orderkey AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) UNION ALL SELECT 'dangling_target', o_orderkey FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'blank_relation', o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def k18(spark, d):
    e = S.table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id"))
    some = e.select(F.min("id").alias("some"))
    r = S.table(spark, d, "orders").join(F.broadcast(some)).select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("source"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(-1)).otherwise(F.col("some")).alias("target"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("buys").alias("relation"))
    return K.problems(e, r)


@query("k19_summary", "SELECT p_type AS type, count(*) AS entities, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS brands FROM part GROUP BY p_type")
def k19(spark, d):
    return K.values_by_type(S.table(spark, d, "part").select(F.col("p_type").alias("type"), "p_brand"), "p_brand").withColumnRenamed("values", "brands")


@query("k19_graph_summary", "SELECT 'total' AS metric, 'entities' AS name, count(*) AS n FROM part UNION ALL SELECT 'total', 'relations', count(*) FROM orders UNION ALL SELECT 'entities', p_type, count(*) FROM part GROUP BY p_type UNION ALL SELECT 'relations', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def k19_graph(spark, d):
    return K.graph_summary(S.table(spark, d, "part").select(F.col("p_type").alias("type")), S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("relation")))


SEEDS_SQL = """q AS (SELECT n_nationkey AS qid, CASE WHEN n_nationkey % 4 = 0 THEN 'Customer#' || lpad((n_nationkey * 3)::VARCHAR, 9, '0') END AS entity, CASE WHEN n_nationkey % 4 = 1 THEN '0' || (n_nationkey + 10) END AS event, CASE WHEN n_nationkey % 4 = 2 THEN '#00000' || lpad(n_nationkey::VARCHAR, 3, '0') END AS topic, CASE WHEN n_nationkey % 4 = 3 THEN n_nationkey END AS year FROM nation),
s AS (SELECT DISTINCT qid, c_custkey AS id FROM q JOIN customer ON c_name = entity OR 'alias ' || c_custkey = entity OR (c_mktsegment = 'BUILDING' AND (contains(c_name, event) OR contains('alias ' || c_custkey, event))) OR contains(c_name, topic) OR contains('alias ' || c_custkey, topic) OR contains('of ' || c_nationkey, topic) OR c_nationkey = year)"""


def asked_seeds(spark, d):
    c, k = S.table(spark, d, "customer"), F.col("n_nationkey")
    text = lambda x: x.cast("string")
    e = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "event").otherwise("other").alias("type"), F.array(F.concat(F.lit("alias "), text(F.col("c_custkey")))).alias("aliases"), F.concat(F.lit("of "), text(F.col("c_nationkey"))).alias("description"), F.col("c_nationkey").alias("year"))
    q = S.table(spark, d, "nation").select(k.alias("qid"), F.when(k % 4 == 0, F.concat(F.lit("Customer#"), F.lpad(text(k * 3), 9, "0"))).alias("entity"), F.when(k % 4 == 1, F.concat(F.lit("0"), text(k + 10))).alias("event"), F.when(k % 4 == 2, F.concat(F.lit("#00000"), F.lpad(text(k), 3, "0"))).alias("topic"), F.when(k % 4 == 3, k).alias("year"))
    return K.query_seeds(e, q)


@query("k20_seeds", f"WITH {SEEDS_SQL} SELECT qid, id FROM s")
def k20_seeds(spark, d):
    return asked_seeds(spark, d)


@query("k20_neighbours", f"""WITH {SEEDS_SQL}, r AS (SELECT o_orderkey AS ord, o_orderkey AS rid, o_custkey AS source, -o_orderkey - 1 AS target, o_orderpriority AS relation FROM orders),
h AS (SELECT DISTINCT qid, ord, rid, target AS other FROM r JOIN s ON r.source = s.id WHERE qid % 5 <> 0 OR relation = '5-LOW'), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord, other)::INTEGER AS place FROM h) SELECT * FROM k WHERE place <= 5""")
def k20(spark, d):
    o = S.table(spark, d, "orders")
    r = o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("source"), (-F.col("o_orderkey") - 1).alias("target"), F.col("o_orderpriority").alias("relation"))
    kinds = S.table(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("qid"), F.lit("5-LOW").alias("relation"))
    return K.neighbours(asked_seeds(spark, d), r, 5, kinds)


POINT = "(s_suppkey * 37 % 120 - 60)::DOUBLE AS plat, (s_suppkey * 53 % 300 - 150)::DOUBLE AS plng"
SITE = "n_nationkey AS ord, n_name AS site, (n_nationkey * 7 % 120 - 60)::DOUBLE AS lat, (n_nationkey * 31 % 300 - 150)::DOUBLE AS lng"
HAV = "2 * 6371 * asin(sqrt(pow(sin(radians(lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians(lat)) * pow(sin(radians(lng - {o}) / 2), 2)))"


def points(spark, d):
    k = F.col("s_suppkey")
    return S.table(spark, d, "supplier").select(k.alias("point"), (k * 37 % 120 - 60).cast("double").alias("plat"), (k * 53 % 300 - 150).cast("double").alias("plng"))


def sites(spark, d):
    k = F.col("n_nationkey")
    return S.table(spark, d, "nation").select(k.alias("ord"), F.col("n_name").alias("site"), (k * 7 % 120 - 60).cast("double").alias("lat"), (k * 31 % 300 - 150).cast("double").alias("lng"))


MODES_SQL = "m AS (SELECT * FROM (VALUES ('road', 50.0::DOUBLE, 0.0::DOUBLE, 1.35::DOUBLE, 0.0::DOUBLE, 0), ('rail', 200, 0.75, 1.2, 80, 1), ('air', 700, 2.5, 1.05, 400, 2)) AS t(mode, speed, overhead, detour, min_km, pref))"
TRAVEL_SQL = f"s AS (SELECT {SITE.replace('(n_nationkey * 7', 'CASE WHEN n_nationkey % 6 <> 5 THEN (n_nationkey * 7').replace('::DOUBLE AS lat', '::DOUBLE END AS lat')} FROM nation), p AS (SELECT s_suppkey AS origin, {POINT} FROM supplier), {MODES_SQL}, k AS (SELECT origin, site, mode, speed, overhead, pref, min_km, round({HAV.format(a='plat', o='plng')} * detour, 1) AS km FROM p, s, m), h AS (SELECT *, km / speed + overhead AS h, (floor(km / speed + overhead) * 60 + round_even((km / speed + overhead - floor(km / speed + overhead)) * 60, 0))::INTEGER AS mi FROM k), tr AS (SELECT origin, site, mode, pref, min_km, coalesce(km, 0) AS km, coalesce(round(h, 4), 0) AS hours, CASE WHEN mi IS NULL THEN 'unknown' WHEN mi >= 60 THEN (mi // 60) || 'h' || (mi % 60) || 'm' ELSE mi || 'm' END AS time FROM h)"


def travelled(spark, d):
    """All suppliers to all sites; every sixth site is at an unknown place."""
    p = points(spark, d).withColumnsRenamed({"point": "origin", "plat": "olat", "plng": "olng"})
    known = sites(spark, d).withColumn("lat", F.when(F.col("ord") % 6 != 5, F.col("lat")))
    return G.travel(p.crossJoin(known), G.modes(spark))


@query("g1_haversine", f"WITH s AS (SELECT {SITE} FROM nation), p AS (SELECT s_suppkey AS point, s_nationkey, {POINT} FROM supplier) SELECT point, round({HAV.format(a='plat', o='plng')}, 6) AS km FROM p JOIN s ON s.ord = s_nationkey")
def g1(spark, d):
    own = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("point"), F.col("s_nationkey").alias("ord"))
    j = points(spark, d).join(own, "point").join(sites(spark, d), "ord")
    return j.select("point", F.round(G.haversine(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")), 6).alias("km"))


@query("g2_travel_matrix", f"WITH {TRAVEL_SQL} SELECT * FROM tr")
def g2(spark, d):
    return travelled(spark, d)


@query("g3_choose_mode", f"WITH {TRAVEL_SQL}, l AS (SELECT *, CASE origin % 4 WHEN 1 THEN 2.5::DOUBLE WHEN 2 THEN 5.0::DOUBLE WHEN 3 THEN 8.0::DOUBLE ELSE 10.0::DOUBLE END AS most FROM tr), f AS (SELECT *, row_number() OVER (PARTITION BY origin, site ORDER BY CASE WHEN km >= min_km AND hours <= most THEN pref WHEN km >= min_km AND pref = 2 THEN 100 WHEN pref = 0 THEN 101 ELSE 102 END) AS r FROM l) SELECT origin, site, mode, km, hours FROM f WHERE r = 1")
def g3(spark, d):
    days = F.col("origin") % 4
    return G.choose_mode(travelled(spark, d), G.day_limit(F.when(days > 0, days)))


@query("g4_nearest_sites", f"WITH s AS (SELECT {SITE} FROM nation), p AS (SELECT s_suppkey AS point, {POINT} FROM supplier), k AS (SELECT point, site, ord, round({HAV.format(a='plat', o='plng')}, 6) AS km FROM p, s), r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, ord)::INTEGER AS rank FROM k) SELECT point, site, km, rank FROM r WHERE rank <= 3")
def g4(spark, d):
    return G.nearest(points(spark, d), sites(spark, d), 3)


@query("g6_distinct_sites", f"WITH p AS (SELECT s_suppkey AS point, {POINT} FROM supplier) SELECT min(point) AS point, round_even(plat / 10, 0) + 0.0::DOUBLE AS la, round_even(plng / 10, 0) + 0.0::DOUBLE AS lo FROM p GROUP BY 2, 3")
def g6(spark, d):
    return G.distinct_sites(points(spark, d))


@query("g10_price_quote", "WITH q AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 98 WHEN 'O' THEN 128 ELSE 110 END AS fee, least(greatest(o_custkey % 260, 1), 200)::INTEGER AS size, least(greatest(o_orderkey % 10, 1), 7)::INTEGER AS days FROM orders) SELECT o_orderkey, (fee * days)::INTEGER AS per_head, (fee * days * size)::INTEGER AS total, ceil(size / 20.0)::BIGINT AS guides FROM q")
def g10(spark, d):
    fee = F.when(F.col("o_orderstatus") == "F", 98).when(F.col("o_orderstatus") == "O", 128).otherwise(110)
    return G.price_quote(S.table(spark, d, "orders"), fee, F.col("o_custkey") % 260, F.col("o_orderkey") % 10).select("o_orderkey", "per_head", "total", "guides")


@query("g12_day_type", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), k AS (SELECT day, CASE WHEN day(day) % 10 = 1 THEN 'holiday' WHEN day(day) % 10 = 4 THEN 'makeup_workday' WHEN dayofweek(day) IN (0, 6) THEN 'weekend' ELSE 'workday' END AS kind FROM d) SELECT day::VARCHAR AS day, kind, CASE kind WHEN 'holiday' THEN 1.8::DOUBLE WHEN 'weekend' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS factor, CASE WHEN kind = 'holiday' AND day(day) <> 11 THEN 'holiday: feast' WHEN kind = 'makeup_workday' THEN 'makeup_workday: feast' ELSE kind END AS label FROM k")
def g12(spark, d):
    days = S.table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    cal = days.select("day", F.when(F.dayofmonth("day") % 10 == 1, "holiday").when(F.dayofmonth("day") % 10 == 4, "makeup").alias("kind"), F.when(F.dayofmonth("day") != 11, "feast").alias("name")).where("kind IS NOT NULL")
    return G.day_type(days, cal).withColumn("day", F.col("day").cast("string"))


@query("g13_weather_factor", "WITH w AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'heavy rain' WHEN 1 THEN 'rain' WHEN 2 THEN 'cloudy' ELSE 'clear' END AS text, CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE (event_id % 60 - 20)::VARCHAR END AS temp FROM events) SELECT event_id, (CASE WHEN contains(text, 'heavy') THEN 0.6 WHEN contains(text, 'rain') THEN 0.75 WHEN contains(text, 'cloud') THEN 0.9 WHEN TRY_CAST(temp AS DOUBLE) >= 33 THEN 0.8 WHEN TRY_CAST(temp AS DOUBLE) <= 0 THEN 0.85 ELSE 1.0 END)::DOUBLE AS factor FROM w")
def g13(spark, d):
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "heavy rain").when(i % 5 == 1, "rain").when(i % 5 == 2, "cloudy").otherwise("clear")
    return S.table(spark, d, "events").select("event_id", G.weather_factor(text, F.when(i % 9 == 0, "n/a").otherwise((i % 60 - 20).cast("string"))).alias("factor"))


@query("g14_as_of_weather", "WITH o AS (SELECT user_id % 10 AS site, ts AS obs, value FROM events WHERE event_id % 3 = 0), b AS (SELECT event_id, user_id % 10 AS site, ts FROM events WHERE event_id % 3 <> 0), j AS (SELECT b.event_id, o.value, row_number() OVER (PARTITION BY event_id ORDER BY obs DESC, value DESC) AS r FROM b LEFT JOIN o ON o.site = b.site AND o.obs <= b.ts AND epoch_us(b.ts) - epoch_us(o.obs) < 900000000) SELECT event_id, value FROM j WHERE r = 1")
def g14(spark, d):
    e = S.table(spark, d, "events").withColumn("site", F.col("user_id") % 10)
    return G.as_of(e.where("event_id % 3 <> 0").select("event_id", "site", "ts"), e.where("event_id % 3 = 0").select("site", "ts", "value"), "site", "ts", "value", 900).select("event_id", "value")


LEVEL_SQL = "CASE WHEN r >= 0.9 THEN 'alert' WHEN r >= 0.7 THEN 'crowded' WHEN r >= 0.4 THEN 'moderate' ELSE 'comfortable' END"
LOAD_SQL = "n AS (SELECT event_type AS site, date_trunc('hour', ts) AS hour, count(*) AS visitors FROM events GROUP BY ALL), c AS (SELECT event_type AS site, greatest(count(*) // 400, 1) AS capacity FROM events GROUP BY 1), l AS (SELECT site, hour, visitors, visitors / capacity AS r FROM n JOIN c USING (site))"


def loaded(spark, d):
    e = S.table(spark, d, "events").withColumnRenamed("event_type", "site")
    return G.hourly_load(e, e.groupBy("site").agg(F.greatest(F.floor(F.count("*") / 400), F.lit(1)).alias("capacity")))


@query("g18_measured_load", f"WITH {LOAD_SQL} SELECT site, hour::VARCHAR AS hour, visitors, round(r, 3) AS ratio, {LEVEL_SQL} AS level FROM l")
def g18(spark, d):
    return loaded(spark, d).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("g17_load_curve", f"WITH {LOAD_SQL}, b AS (SELECT site, hour(hour) AS h, round_even(avg(visitors), 0)::BIGINT AS v FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY v DESC, h) AS k, sum(v) OVER (PARTITION BY site) AS total FROM b) SELECT site, v AS peak, h::INTEGER AS peak_hour, total::BIGINT AS total FROM r WHERE k = 1")
def g17(spark, d):
    return G.load_curve(loaded(spark, d))


@query("m1_last_turns", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text)::INTEGER AS back FROM conversations) SELECT conv_id, turn, role, back FROM r WHERE back <= 4")
def m1(spark, d):
    return G.last_turns(S.table(spark, d, "conversations"), 4).select("conv_id", "turn", "role", "back")


@query("m2_cleared", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 0")
def m2(spark, d):
    c = S.table(spark, d, "conversations")
    return G.cleared(c, c.where("conv_id % 5 = 0")).select("conv_id", "turn")


@query("m3_profiles", "WITH b AS (SELECT user_id, event_type AS site, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, site) AS k FROM b), l AS (SELECT user_id, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS last_site FROM events GROUP BY 1) SELECT user_id, sum(n)::BIGINT AS visits, any_value(last_site) AS last_site, string_agg(site, ',' ORDER BY k) FILTER (k <= 3) AS preferred FROM p JOIN l USING (user_id) GROUP BY user_id")
def m3(spark, d):
    return G.profile(S.table(spark, d, "events").withColumnRenamed("event_type", "site"))


@query("m3_visit_counts", "WITH b AS (SELECT user_id, event_type AS site, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(site || ':' || n, ',' ORDER BY site) AS counts FROM b GROUP BY user_id")
def m3_counts(spark, d):
    c = G.visit_counts(S.table(spark, d, "events").withColumnRenamed("event_type", "site"))
    return c.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias("counts"))


@query("m3_persona", """WITH e AS (SELECT user_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'student' WHEN 1 THEN 'nobody' WHEN 2 THEN 'researcher' END AS persona, CASE WHEN event_id % 3 <> 0 THEN 'q' || event_id ELSE '' END AS question FROM events WHERE user_id % 7 <> 3 OR event_id % 5 = 1),
p AS (SELECT user_id, arg_max(persona, struct_pack(ts := ts, e := event_id)) FILTER (persona IN ('student', 'researcher')) AS persona FROM e GROUP BY user_id),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM e WHERE question <> ''),
r AS (SELECT user_id, string_agg(question, ',' ORDER BY b DESC) FILTER (b <= 12) AS recent, string_agg(question, ',' ORDER BY b DESC) FILTER (b <= 5) AS shown FROM q GROUP BY user_id)
SELECT user_id, coalesce(persona, 'tourist') AS persona, coalesce(recent, '') AS recent, coalesce(shown, '') AS shown FROM p LEFT JOIN r USING (user_id)""")
def m3_persona(spark, d):
    i = F.col("event_id")
    e = S.table(spark, d, "events").where("user_id % 7 <> 3 OR event_id % 5 = 1")
    asked = e.select("user_id", "ts", "event_id", F.when(i % 5 == 0, "student").when(i % 5 == 1, "nobody").when(i % 5 == 2, "researcher").alias("persona"), F.when(i % 3 != 0, F.concat(F.lit("q"), i.cast("string"))).otherwise("").alias("question"))
    return G.persona_and_questions(asked).select("user_id", "persona", F.array_join("recent", ",").alias("recent"), F.array_join("shown", ",").alias("shown"))


@query("m4_memory_batches", f"WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY {TURN_ORDER}) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN i // 2 < (CASE WHEN n <= 3 THEN 0 ELSE (n - 2) // 2 END) THEN (i // 2)::INTEGER END AS batch FROM r")
def m4(spark, d):
    return G.memory_batches(S.table(spark, d, "conversations"), keep=3, batch=2)


@query("s8_replace_slice", "SELECT doc_id, source, 'old' AS state FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE source = 'src1'")
def s8(spark, d):
    x = docs(spark, d).select("doc_id", "source")
    return S.replace_slice(x.withColumn("state", F.lit("old")), x.where("source = 'src1'").withColumn("state", F.lit("new")), "source", ["src1", "src2"])


@query("s9_not_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND length(text) >= 500 ORDER BY doc_id LIMIT 50")
def s9(spark, d):
    return S.not_done(docs(spark, d), S.table(spark, d, "labels"), "doc_id", 500, 50).select("doc_id")


@query("s6_embeddings", "SELECT vec_id, label, len(embedding)::INTEGER AS dims FROM embeddings")
def s6(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("dims"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return e3(spark, d)
