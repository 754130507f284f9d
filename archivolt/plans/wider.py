"""Registered queries on load under weather and calendar, quotes, whole itineraries, comparisons, places and slices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from archivolt.operators import chunks as C
from archivolt.operators import graph as K
from archivolt.operators import search as R
from archivolt.operators import tables as G
from archivolt.plans.further import EXPECTED_SQL, STOPS_SQL, expected, stops
from archivolt.plans.linking import QUERIES, SQL
from archivolt.plans.registry import HAV, TERMS, docs, query
from archivolt.sources import tables as S
from archivolt.sources.shared import shared_dir

__all__ = ["QUERIES", "SQL"]

SNAPSHOT_SQL = """a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, c_nationkey AS site FROM orders JOIN customer ON c_custkey = o_custkey),
b AS (SELECT c_nationkey AS site, round_even(avg(e), 0)::BIGINT AS base FROM (SELECT c_nationkey, h, round_even(count(*) * any_value((h % 5) / 4.0::DOUBLE), 0) AS e FROM customer, (SELECT unnest([8, 9, 10, 11]) AS h) GROUP BY ALL) GROUP BY 1),
cp AS (SELECT s_nationkey AS site, count(*) * 8 AS capacity FROM supplier WHERE s_nationkey <> 3 GROUP BY 1),
f AS (SELECT a.day, a.site, base, coalesce(capacity, 0) AS capacity, CASE WHEN (day(day) + a.site) % 3 <> 0 THEN 1.0 WHEN a.site % 4 = 0 THEN 0.6 WHEN a.site % 4 = 1 THEN 0.75 WHEN a.site % 4 = 2 THEN 0.9 WHEN a.site * 3 - 10 >= 33 THEN 0.8 WHEN a.site * 3 - 10 <= 0 THEN 0.85 ELSE 1.0 END::DOUBLE AS weather_factor,
      CASE WHEN day(day) % 10 = 1 THEN 1.8 WHEN dayofweek(day) IN (0, 6) THEN 1.3 ELSE 1.0 END::DOUBLE AS day_factor FROM a JOIN b USING (site) LEFT JOIN cp USING (site)),
v AS (SELECT *, round_even(base * weather_factor * day_factor, 0)::BIGINT AS visitors FROM f), r AS (SELECT *, CASE WHEN capacity > 0 THEN visitors / capacity ELSE 0 END AS x FROM v),
p AS (SELECT day::VARCHAR AS day, site, base, visitors, round(x, 3) AS ratio, CASE WHEN x >= 0.9 THEN 'alert' WHEN x >= 0.7 THEN 'crowded' WHEN x >= 0.4 THEN 'moderate' ELSE 'comfortable' END AS level, weather_factor, day_factor FROM r)"""


def snapshot(spark, d):
    """Every nation on every day with an order of a customer there."""
    c, n = S.table(spark, d, "customer"), F.col("site")
    asked = S.table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("site")), "o_custkey").select(F.to_date("o_orderdate").alias("day"), "site").distinct()
    base = c.groupBy(F.col("c_nationkey").alias("site")).agg(F.count("*").alias("base"))
    load = G.expected_load(base, spark.range(24).select(F.col("id").cast("int").alias("hour"), (F.col("id") % 5 / 4.0).alias("weight")))
    capacity = S.table(spark, d, "supplier").where("s_nationkey <> 3").groupBy(F.col("s_nationkey").alias("site")).agg((F.count("*") * 8).alias("capacity"))
    text = F.when(n % 4 == 0, "storm").when(n % 4 == 1, "light rain").when(n % 4 == 2, "cloudy")
    weather = asked.where((F.dayofmonth("day") + n) % 3 == 0).select("day", "site", text.alias("text"), (n * 3 - 10).cast("string").alias("temp"))
    days = asked.select("day").distinct()
    feasts = days.where(F.dayofmonth("day") % 10 == 1).select("day", F.lit("holiday").alias("kind"), F.lit("feast").alias("name"))
    return G.factored_snapshot(asked, load, capacity, weather, G.day_type(days, feasts), (8, 9, 10, 11)).withColumn("day", F.col("day").cast("string"))


@query("g16_factored_snapshot", f"WITH {SNAPSHOT_SQL} SELECT * FROM p")
def g16_factored(spark, d):
    return snapshot(spark, d)


@query("g16_report", f"WITH {SNAPSHOT_SQL} SELECT day, sum(visitors)::BIGINT AS total, coalesce(string_agg('N' || lpad(site::VARCHAR, 2, '0'), ',' ORDER BY site) FILTER (level = 'alert'), '') AS alerts FROM p GROUP BY day")
def g16_report(spark, d):
    return G.snapshot_report(snapshot(spark, d).withColumn("site", F.concat(F.lit("N"), F.lpad(F.col("site").cast("string"), 2, "0"))))


@query("g17_day_curve", f"WITH {EXPECTED_SQL}, c AS (SELECT event_type AS site, count(*) AS capacity FROM events WHERE event_type <> 'click' GROUP BY 1), g AS (SELECT site, string_agg(expected::VARCHAR, ',' ORDER BY hour) AS series, max(expected) AS peak, max(expected) FILTER (hour = 13) AS current FROM x GROUP BY site), h AS (SELECT site, min(hour) AS peak_hour FROM x JOIN g USING (site) WHERE expected = peak GROUP BY site), r AS (SELECT *, coalesce(current / capacity, 0) AS r FROM g JOIN h USING (site) LEFT JOIN c USING (site)) SELECT site, series, peak_hour, peak, current, CASE WHEN r >= 0.9 THEN 'alert' WHEN r >= 0.7 THEN 'crowded' WHEN r >= 0.4 THEN 'moderate' ELSE 'comfortable' END AS current_level FROM r")
def g17_day(spark, d):
    load, base = expected(spark, d)
    return G.day_curve(load, base.where("site <> 'click'").withColumnRenamed("base", "capacity"), 37).withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


@query("g10_stage_quote", """WITH q AS (SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'adult' WHEN contains(o_orderpriority, 'HIGH') THEN 'senior' WHEN contains(o_orderpriority, 'LOW') THEN 'guest' ELSE 'junior' END AS stage, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 260 END AS size, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 10 END AS days FROM orders),
h AS (SELECT o_orderkey, stage, least(greatest(coalesce(nullif(size, 0), 40), 1), 200) AS n, least(greatest(coalesce(nullif(days, 0), 2), 1), 7) AS d, CASE stage WHEN 'adult' THEN 128 WHEN 'senior' THEN 118 WHEN 'junior' THEN 98 ELSE 0 END AS fee, CASE stage WHEN 'adult' THEN 15 ELSE 20 END AS per FROM q)
SELECT o_orderkey, stage, (fee * d)::INTEGER AS per_head, (fee * d * n)::INTEGER AS total, ceil(n / per)::BIGINT AS guides FROM h""")
def g10_stage(spark, d):
    k = F.col("o_orderkey")
    rows = S.table(spark, d, "orders").select(k, F.col("o_orderpriority").alias("said"), F.when(k % 7 != 0, F.col("o_custkey") % 260).alias("size"), F.when(k % 5 != 0, k % 10).alias("days"))
    fees = spark.createDataFrame([("adult", 128, 15), ("senior", 118, 20), ("junior", 98, None)], "stage string, fee int, per_guide int")
    return G.stage_quote(rows, (("URGENT", "adult"), ("HIGH", "senior"), ("LOW", "guest")), fees, "junior").drop("said", "size", "days")


@query("g9_whole_itinerary", f"""WITH {STOPS_SQL}, m AS (SELECT * FROM (VALUES ('road', 50.0::DOUBLE, 0.0::DOUBLE, 1.35::DOUBLE), ('rail', 200, 0.75, 1.2), ('air', 700, 2.5, 1.05)) AS t(mode, speed, overhead, detour)),
rq AS (SELECT DISTINCT l_orderkey AS request, ['road', 'rail', 'air', 'road'][l_orderkey % 4 + 1] AS mode, CASE WHEN l_orderkey % 5 <> 0 THEN (l_orderkey * 13 % 100 - 50)::DOUBLE END AS dlat, (l_orderkey * 17 % 200 - 100)::DOUBLE AS dlng FROM lineitem),
e AS (SELECT request, arg_min(lat, ord) AS flat, arg_min(lng, ord) AS flng, arg_max(lat, ord) AS llat, arg_max(lng, ord) AS llng FROM x GROUP BY request),
w AS (SELECT request, la, lo, lat, lng FROM x WHERE la IS NOT NULL UNION ALL SELECT request, dlat, dlng, flat, flng FROM e JOIN rq USING (request) WHERE dlat IS NOT NULL UNION ALL SELECT request, llat, llng, dlat, dlng FROM e JOIN rq USING (request) WHERE dlat IS NOT NULL),
k AS (SELECT request, speed, overhead, round({HAV.format(a='la', o='lo')} * detour, 1) AS km FROM w JOIN rq USING (request) JOIN m USING (mode))
SELECT request, count(*) AS ways, round(sum(km), 1) AS total_km, round(sum((10 * round(km * 10)::BIGINT + (speed / 2)::BIGINT) // speed::BIGINT + (overhead * 100)::BIGINT) / 100, 2) AS total_hours FROM k GROUP BY request""")
def g9_whole(spark, d):
    k = F.col("request")
    mode = F.get(F.array(*[F.lit(x) for x in ("road", "rail", "air", "boat")]), (k % 4).cast("int"))
    s = stops(spark, d)
    requests = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request")).distinct().select("request", mode.alias("mode"), F.when(k % 5 != 0, (k * 13 % 100 - 50).cast("double")).alias("dlat"), (k * 17 % 200 - 100).cast("double").alias("dlng"), F.lit(None).cast("int").alias("last_day"))
    return G.whole_totals(G.whole_legs(s, requests))


@query("k22_compared", """WITH s AS (SELECT n_nationkey AS k, n_name AS site, CASE WHEN n_nationkey % 5 <> 4 THEN n_regionkey::VARCHAR END AS profile FROM nation), p AS (SELECT x.site AS a, y.site AS b FROM s x JOIN s y ON y.k = x.k + 1),
sd AS (SELECT a, b, 'a' AS side, a AS site FROM p UNION ALL SELECT a, b, 'b', b FROM p), kn AS (SELECT sd.*, profile, k FROM sd JOIN s USING (site)), fd AS (SELECT * FROM kn WHERE profile IS NOT NULL),
rel AS (SELECT s_suppkey AS ord, s_nationkey AS src, (s_nationkey + 3) % 25 AS tgt FROM supplier), t AS (SELECT k, ord, row_number() OVER (PARTITION BY k ORDER BY ord) AS place FROM s JOIN rel ON k = src OR k = tgt)
SELECT a, b, side, 'profile' AS kind, 0::BIGINT AS ord, coalesce(profile, 'not found') AS item FROM kn UNION ALL SELECT a, b, side, 'event', c_custkey::BIGINT, c_name FROM fd JOIN customer ON c_nationkey = k UNION ALL SELECT a, b, side, 'relation', place::BIGINT, 'S' || ord FROM fd JOIN t USING (k) WHERE place <= 5""")
def k22_compared(spark, d):
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("site"), F.col("n_regionkey").cast("string").alias("profile"))
    name = lambda k, as_: n.select(k.alias("k"), F.col("site").alias(as_))
    pairs = name(F.col("k"), "a").join(name(F.col("k") - 1, "b"), "k").select("a", "b")
    events = S.table(spark, d, "customer").join(name(F.col("k"), "site"), F.col("c_nationkey") == F.col("k")).select("site", F.col("c_custkey").alias("ord"), F.col("c_name").alias("label"))
    s = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("rid"), F.col("s_nationkey").alias("i"), ((F.col("s_nationkey") + 3) % 25).alias("j"))
    relations = s.join(name(F.col("k"), "source").withColumnRenamed("k", "i"), "i").join(name(F.col("k"), "target").withColumnRenamed("k", "j"), "j").select("ord", "rid", "source", "target")
    return K.compared(pairs, n.where("k % 5 <> 4"), events, relations)


@query("k21_nodes", "SELECT 'P' || p_partkey AS id, p_type AS type, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_container ELSE '' END AS description, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS aliases FROM part WHERE p_type = (SELECT max(p_type) FROM part)".replace("p_container", "p_brand"))
def k21_nodes(spark, d):
    k, part = F.col("p_partkey"), S.table(spark, d, "part")
    e = part.select(F.concat(F.lit("P"), k.cast("string")).alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.when(k % 2 == 0, F.col("p_brand")).alias("description"), F.when(k % 3 == 0, F.array("p_brand")).alias("aliases"))
    return K.nodes(e, part.agg(F.max("p_type")).first()[0]).withColumn("aliases", F.array_join("aliases", ","))


METRICS_SQL = "me AS (SELECT source AS method, avg(quality) AS hit_1, avg(toxic) AS mrr FROM documents JOIN labels USING (doc_id) GROUP BY 1)"


@query("c13_methods", f"WITH {METRICS_SQL} SELECT 'hit_1 ' || method AS metric, round(hit_1, 6) AS value FROM me UNION ALL SELECT 'mrr ' || method, round(mrr, 6) FROM me")
def c13_methods(spark, d):
    m = docs(spark, d).join(S.table(spark, d, "labels"), "doc_id").groupBy(F.col("source").alias("method")).agg(F.avg("quality").alias("hit_1"), F.avg("toxic").alias("mrr"))
    return R.method_rows(m).withColumn("value", F.round("value", 6))


@query("r7_within_places", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), pl AS (SELECT place, doc_id AS unit FROM documents, (SELECT unnest(['and', 'the', 'une', 'der', 'que']) AS place) WHERE contains(text, place)), n AS (SELECT place, count(*) AS many FROM pl GROUP BY place),
q AS (SELECT vec_id, e, ['une', 'zzz', 'que'][(vec_id // 100) % 3 + 1] AS place FROM v WHERE vec_id % 100 = 0), w AS (SELECT q.*, coalesce(many, 0) >= 20 AS narrow FROM q LEFT JOIN n USING (place)),
s AS (SELECT w.vec_id AS qid, v.vec_id, round(list_cosine_similarity(v.e, w.e), 6) AS score FROM v JOIN w ON v.vec_id <> w.vec_id AND (NOT narrow OR EXISTS (SELECT 1 FROM pl WHERE pl.place = w.place AND pl.unit = v.vec_id))),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def r7_places(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    names = F.array(*[F.lit(x) for x in ("une", "zzz", "que")])
    asked = e.where("vec_id % 100 = 0").withColumn("place", F.get(names, (F.floor(F.col("vec_id") / 100) % 3).cast("int")))
    places = C.tag_places(docs(spark, d), TERMS).select(F.explode("locations").alias("place"), F.col("doc_id").alias("unit"))
    return R.dense_top_k(e, asked, 5, places=places)


@query("s8_slices_on_disk", "SELECT doc_id, source, 'old' AS state FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE source = 'src1'")
def s8_disk(spark, d):
    x, path = docs(spark, d).select("doc_id", "source"), f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    S.write_slices(x.withColumn("state", F.lit("old")), x, path, "source", 1)
    two = spark.createDataFrame([("src1",), ("src2",)], "source string")
    S.write_slices(x.where("source = 'src1'").withColumn("state", F.lit("new")), two, path, "source", 2)
    return S.read_slices(spark, path, "source", "doc_id long, state string, source string").select("doc_id", "source", "state")
