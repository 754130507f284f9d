"""Registered queries on repairs, anchors, links by similarity, the timeline, fallback extraction and memory streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import repair as P
from archivolt.functions import text as X
from archivolt.operators import chunks as C
from archivolt.operators import graph as K
from archivolt.operators import pairs as L
from archivolt.operators import search as R
from archivolt.operators import terms as T
from archivolt.plans.further import QUERIES, SQL
from archivolt.plans.further import VERDICT_SQL as JUDGED_SQL
from archivolt.plans.registry import SEARCH_SQL, UNITS, docs, query
from archivolt.sources import tables as S
from archivolt.sources.shared import saved

__all__ = ["QUERIES", "SQL"]

WORDS = ("widget", "bracket", "bolt", "ring")


@query("t14_normalize_query", "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(replace(p_name, 'widget', 'widgxt'), 'bolt', 'boxt') END AS spoilt FROM part) SELECT p_partkey, regexp_replace(regexp_replace(spoilt, 'widg[^e]t', 'widget', 'g'), 'bo[^l]t', 'bolt', 'g') AS mended FROM s")
def t14(spark, d):
    # Every third letter run of a name is spoilt by one character, so mending gives the names back.
    part = S.table(spark, d, "part")
    spoilt = F.when(F.col("p_partkey") % 3 == 0, X.sub(F.col("p_name"), "(widget|bolt|gear|ring)", "$1")).otherwise(X.sub(X.sub(F.col("p_name"), "widget", "widgxt"), "bolt", "boxt"))
    return part.select("p_partkey", P.normalize_query(spoilt, [("thth", "th")], WORDS).alias("mended"))


@query("t18_read_json", "SELECT o_orderkey, o_orderpriority AS name, (o_orderkey % 4)::INTEGER AS form FROM orders")
def t18(spark, d):
    o = S.table(spark, d, "orders").withColumn("form", (F.col("o_orderkey") % 4).cast("int"))
    body = F.to_json(F.struct(F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("entities")))
    said = F.when(F.col("form") == 0, body).when(F.col("form") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("form") == 2, F.concat(F.lit('Here: {"a": 1} and '), body, F.lit(" so."))).otherwise(F.concat(F.lit("{broken "), body))
    return o.select("o_orderkey", P.read_json(said, "struct<entities: array<struct<name: string>>>")["entities"][0]["name"].alias("name"), "form")


@query("t21_typos", "SELECT p_partkey, CASE WHEN contains(p_name, 'bolt') THEN replace(p_name, 'bolt', 'blot') WHEN contains(p_name, 'ring') THEN replace(p_name, 'ring', 'rimg') ELSE p_name END AS typed FROM part")
def t21(spark, d):
    return S.table(spark, d, "part").select("p_partkey", P.with_typos(F.col("p_name"), F.split("p_name", " "), {"bolt": "blot", "ring": "rimg"}).alias("typed"))


@query("c6_anchors")
def c6(spark, d):
    text = docs(spark, d).where("length(text) > 0").select(F.col("doc_id").alias("book"), "text")
    lines = text.select("book", F.posexplode(F.split("text", "\n")).alias("ord", "item"))
    titles = lines.where("ord % 3 = 0 AND length(item) >= 8").select("book", "ord", F.substring("item", 1, 20).alias("item"), (F.col("ord") + 1).alias("page"))
    return C.anchors(text, titles)


@query("c11_linked_sources")
def c11(spark, d):
    part = S.table(spark, d, "part")
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("ord")).select("ord", F.col("p_name").alias("name"))
    return L.linked_source(part.select(F.concat_ws(" ", F.col("p_name"), F.lower("p_type")).alias("stem")), names)


@query("c12_evidence_page", "SELECT a.conv_id * 1000 + a.turn AS eid, min(b.turn) AS page FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE length(text) >= 30 GROUP BY 1, 2) a JOIN conversations b USING (conv_id) WHERE contains(regexp_replace(b.text, '{SP}+', '', 'g'), regexp_replace(a.text, '{SP}+', '', 'g')) AND regexp_replace(a.text, '{SP}+', '', 'g') <> '' GROUP BY 1")
def c12(spark, d):
    c = S.table(spark, d, "conversations")
    asked = c.where("length(text) >= 30").groupBy("conv_id", "turn").agg(F.min("text").alias("snippet")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("eid"), F.col("conv_id").alias("doc"), "snippet")
    pages = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return L.evidence_page(asked, pages, lambda x: X.sub(x, f"{X.SPACE}+", "")).select("eid", "page")


PREFIXED_SQL = r""",
gd AS (SELECT b.item_id AS qid, d.doc_id AS unit, substr(b.text, 21, 40) AS anchor FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 21, 40))),
pf AS (SELECT unit, string_agg(anchor, ' ' ORDER BY qid DESC) AS prefix FROM gd GROUP BY unit),
w2 AS (SELECT unit, regexp_extract_all(lower(concat_ws(' ', prefix, text)), '[\p{L}\p{N}_]{2,}') AS w FROM units LEFT JOIN pf USING (unit)),
x2 AS (SELECT unit, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w2),
tf2 AS (SELECT unit, term, count(*) AS tf FROM x2 GROUP BY ALL), raw2 AS (SELECT unit, term, tf * idf AS x FROM tf2 JOIN i USING (term)),
nrm2 AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM raw2 GROUP BY unit), ix2 AS (SELECT unit, term, x / norm AS w FROM raw2 JOIN nrm2 USING (unit)),
qx AS"""


@query("e6_oracle_prefix", f"WITH {UNITS}, " + SEARCH_SQL.replace(",\nqx AS", PREFIXED_SQL, 1).replace("FROM ix JOIN q", "FROM ix2 JOIN q") + """,
g AS (SELECT b.item_id AS qid, gd.unit FROM benchmark b LEFT JOIN gd ON gd.qid = b.item_id), h AS (SELECT g.qid, min(rk.rank) AS r FROM g LEFT JOIN rk ON rk.qid = g.qid AND rk.unit = g.unit AND rk.rank <= 5 GROUP BY g.qid)
SELECT count(*) AS questions, round(avg((coalesce(r, 99) <= 1)::INT), 4) AS hit_1, round(avg((coalesce(r, 99) <= 3)::INT), 4) AS hit_3, round(avg((coalesce(r, 99) <= 5)::INT), 4) AS hit_5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr FROM h""")
def e6(spark, d):
    x, b = docs(spark, d), S.table(spark, d, "benchmark")
    anchor = b.select(F.col("item_id").alias("eid"), F.substring("text", 21, 40).alias("part"))
    gold = saved(K.found_phrases(x, anchor).join(anchor, "eid").select(F.col("eid").alias("qid"), F.col("doc_id").alias("unit"), "part"))
    latest_first = F.sort_array(F.collect_list(F.struct("qid", "part")), asc=False)
    prefix = gold.groupBy("unit").agg(F.array_join(F.transform(latest_first, lambda r: r["part"]), " ").alias("prefix"))
    units = x.select(F.col("doc_id").alias("unit"), "text")
    vocab = saved(T.vocabulary(units, T.WORD, 8000))
    told = units.join(prefix, "unit", "left").select("unit", F.concat_ws(" ", "prefix", "text").alias("text"))
    asked = b.select(F.col("item_id").alias("unit"), "text")
    q = saved(T.vectors(asked, T.WORD, vocab))
    ranked = R.top_k(T.vectors(told, T.WORD, vocab, only=q), q, 5)
    every = b.select(F.col("item_id").alias("qid")).join(gold.select("qid", "unit"), "qid", "left")
    return R.gold_metrics(ranked, every)


def names_and_runs(spark, d):
    long = S.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("name"))
    # Both are read several times; cut from the texts once.
    return saved(QUERIES["v1_run_counts"](spark, d)), saved(long.where("length(name) BETWEEN 4 AND 8").distinct())


@query("v2_variants")
def v2(spark, d):
    return L.variants(*names_and_runs(spark, d))


@query("v2_edit_variants")
def v2_edit(spark, d):
    return L.edit_variants(*names_and_runs(spark, d))


EVENTS_SQL = "tl AS (SELECT item_id AS eid, substr(text, 1, 20) AS label, substr(text, 31, 40) AS about, CASE WHEN item_id % 2 = 0 THEN 'p' || item_id % 7 END AS place FROM benchmark), mt AS (SELECT doc_id, eid, place FROM documents JOIN tl ON contains(text, label) OR contains(text, substr(about, 1, 12)))"


def timeline(spark, d):
    i = F.col("item_id")
    place = F.when(i % 2 == 0, F.concat(F.lit("p"), (i % 7).cast("string")))
    events = S.table(spark, d, "benchmark").select(i.alias("eid"), F.substring("text", 1, 20).alias("label"), F.substring("text", 31, 40).alias("description"), place.alias("place"))
    return K.timeline_mentions(docs(spark, d), events)


@query("k2_timeline_mentions", f"WITH {EVENTS_SQL} SELECT doc_id, eid FROM mt")
def k2(spark, d):
    return timeline(spark, d)[0]


@query("k2_timeline_places", f"WITH {EVENTS_SQL} SELECT doc_id, eid, place FROM mt WHERE place IS NOT NULL")
def k2_places(spark, d):
    return timeline(spark, d)[1]


@query("k9_split", f"WITH {JUDGED_SQL} SELECT ord, canonical AS name, confidence FROM vd WHERE verdict = 'confirmed'")
def k9_split(spark, d):
    k = F.col("n_nationkey")
    n = S.table(spark, d, "nation").select(k.cast("long").alias("ord"), F.col("n_name").alias("name"))
    verdict = F.element_at(F.array(F.lit("confirmed"), F.lit("suspicious"), F.lit("rejected")), (k % 3 + 1).cast("int"))
    said = S.table(spark, d, "nation").where(k < 15).select(F.col("n_name").alias("name"), verdict.alias("verdict"), F.lower("n_name").alias("canonical"), F.when(k % 2 == 0, 0.9).alias("confidence"))
    return K.split_verdicts(K.with_verdicts(n, said)).select("ord", "name", "confidence")


@query("k23_fallback", r"WITH x AS (SELECT doc_id, 'outside' AS name FROM labels WHERE quality = 1), e AS (SELECT unnest(['the', 'and', 'une', 'der', 'que']) AS k), b AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x)), r AS (SELECT DISTINCT doc_id, k AS name FROM b JOIN e ON contains(text, k) UNION SELECT doc_id, substr(i.text, 1, 20) FROM b JOIN benchmark i ON contains(b.text, substr(i.text, 1, 20)) OR contains(b.text, substr(i.text, 31, 12)) UNION SELECT doc_id, lpad(regexp_extract(m, '([0-9]+)\.([0-9]+)\.([0-9]+)', 1), 4, '0') || '-' || lpad(regexp_extract(m, '([0-9]+)\.([0-9]+)\.([0-9]+)', 2), 2, '0') || '-' || lpad(regexp_extract(m, '([0-9]+)\.([0-9]+)\.([0-9]+)', 3), 2, '0') FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+')) AS m FROM b)) SELECT doc_id, name, 'external' AS how FROM x UNION ALL SELECT doc_id, name, 'rules' FROM r WHERE name <> 'que'")
def k23(spark, d):
    outside = S.table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("outside").alias("name"))
    known = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("the", "and", "une", "der", "que")])).alias("name"), F.lit(None).cast("string").alias("alias"))
    events = S.table(spark, d, "benchmark").select(F.col("item_id").alias("eid"), F.substring("text", 1, 20).alias("label"), F.substring("text", 31, 12).alias("description"), F.lit(None).cast("string").alias("place"))
    return K.with_fallback(docs(spark, d), outside, known, ("que",), events, r"([0-9]+)\.([0-9]+)\.([0-9]+)")
