"""Operational tables: sites, travel, calendar, weather, load, conversations, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators.order import numbered, with_blocks
from archivolt.sources.shared import saved

# Speed km/h, overhead h, detour, least km, and order of preference per mode.
MODES = (("road", 50.0, 0.0, 1.35, 0.0, 0), ("rail", 200.0, 0.75, 1.2, 80.0, 1), ("air", 700.0, 2.5, 1.05, 400.0, 2))
LEVELS = ((0.9, "alert"), (0.7, "crowded"), (0.4, "moderate"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(a))


def modes(spark) -> DataFrame:
    return spark.createDataFrame(list(MODES), "mode string, speed double, overhead double, detour double, min_km double, pref int")


def hours_text(hours: Column) -> Column:
    """Hours as `2h5m` or `5m`; 60 minutes are carried over."""
    minutes = F.floor(hours).cast("int") * 60 + F.bround((hours - F.floor(hours)) * 60, 0).cast("int")
    rest = F.concat((minutes % 60).cast("string"), F.lit("m"))
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), rest)).otherwise(rest)


def travel(pairs: DataFrame, modes_: DataFrame) -> DataFrame:
    """origin, site, mode, pref, min_km, km, hours, time for (origin, olat, olng, site, lat, lng) by each mode (three rows).

    Where a place is unknown (a coordinate is null) km and hours are 0 and the time is `unknown`.
    """
    line = F.round(haversine(F.col("olat"), F.col("olng"), F.col("lat"), F.col("lng")) * F.col("detour"), 1)
    m = pairs.crossJoin(modes_).withColumn("line", line)
    hours = F.col("line") / F.col("speed") + F.col("overhead")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return m.select("origin", "site", "mode", "pref", "min_km", zero(F.col("line")).alias("km"), zero(F.round(hours, 4)).alias("hours"), F.coalesce(hours_text(hours), F.lit("unknown")).alias("time"))


def day_limit(days: Column) -> Column:
    """Hours that a way may take: 2.5 for one day, 5 for two, 8 for more, 10 where the days are not known."""
    return F.coalesce(F.when(days == 1, 2.5).when(days == 2, 5.0).when(days >= 3, 8.0), F.lit(10.0))


def choose_mode(matrix: DataFrame, limit: Column) -> DataFrame:
    """The first mode in order that is far and fast enough, else the last in order if far enough, else the first."""
    most = max(m[5] for m in MODES)
    far = F.col("km") >= F.col("min_km")
    fit = F.when(far & (F.col("hours") <= limit), F.col("pref")).when(far & (F.col("pref") == most), 100).when(F.col("pref") == 0, 101).otherwise(102)
    return matrix.groupBy("origin", "site").agg(F.min_by(F.struct("mode", "km", "hours"), fit).alias("b")).select("origin", "site", "b.*")


def distinct_sites(points: DataFrame, cell: float = 10.0) -> DataFrame:
    """la, lo, point: the first point of each cell of coordinates."""
    at = lambda c: F.bround(F.col(c) / cell, 0) + F.lit(0.0)
    return points.groupBy(at("plat").alias("la"), at("plng").alias("lo")).agg(F.min("point").alias("point"))


def price_quote(rows: DataFrame, fee: Column, size: Column, days: Column, per_guide: int = 20) -> DataFrame:
    """Adds per_head, total and guides for a daily fee; a group has 1 to 200 heads, a course 1 to 7 days."""
    held = lambda c, most: F.least(F.greatest(c, F.lit(1)), F.lit(most)).cast("int")
    n, d = held(size, 200), held(days, 7)
    return rows.withColumn("per_head", fee * d).withColumn("total", fee * d * n).withColumn("guides", F.ceil(n / per_guide))


def stage_quote(rows: DataFrame, aliases: Sequence[tuple[str, str]], fees: DataFrame, default_stage: str, default_size: int = 40, default_days: int = 2) -> DataFrame:
    """Adds stage, per_head, total and guides; rows: said, size, days.

    The stage is that of the first alias that the text contains, else the default; a size or days that are null or 0 are the
    default ones. fees: stage, fee (a day and head), per_guide; a stage without a row costs nothing and has 20 heads a guide.
    """
    r = rows.withColumn("stage", F.coalesce(X.first_of(F.coalesce("said", F.lit("")), aliases), F.lit(default_stage)))
    known = r.join(F.broadcast(fees.limit(10_000)), "stage", "left")  # a price list
    held = lambda c, default, most: F.least(F.greatest(F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(default)), F.lit(1)), F.lit(most)).cast("int")
    n, d = held("size", default_size, 200), held("days", default_days, 7)
    fee = F.coalesce("fee", F.lit(0))
    guides = F.ceil(n / F.coalesce(F.nullif(F.col("per_guide"), F.lit(0)), F.lit(20)))
    return known.select(*rows.columns, "stage", (fee * d).alias("per_head"), (fee * d * n).alias("total"), guides.alias("guides"))


def latency(rows: DataFrame) -> DataFrame:
    """path, n, mean, lo, hi, flagged per path, and over all of them under `all`. rows: path, seconds, flag."""
    by = lambda df: df.agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean"), F.min("seconds").alias("lo"), F.max("seconds").alias("hi"), F.count_if("flag").alias("flagged"))
    return by(rows.groupBy("path")).unionByName(by(rows.groupBy(F.lit("all").alias("path"))))


def path_difference(rows: DataFrame, a: str, b: str) -> DataFrame:
    """difference: the mean of path a less that of path b."""
    mean = lambda p: F.avg(F.when(F.col("path") == p, F.col("seconds")))
    return rows.agg(F.round(mean(a) - mean(b), 6).alias("difference"))


def nearest(points: DataFrame, sites: DataFrame, k: int, cell: int = 10) -> DataFrame:
    """point, site, km, rank: the k nearest sites of each point; ties by order. Rows without coordinates take no part.

    points: point, plat, plng. sites: ord, site, lat, lng. A point meets the sites in the cells of `cell` degrees around its
    own, over the date line too, by an equi-join. What lies beyond that ring is farther than the ring is wide, in latitude
    or, at the point's own latitude, in longitude; points whose k-th site is not nearer than that look into a wider ring, and
    those that are left, near a pole or far from all sites, into all cells.
    """
    rows, columns = 180 // cell, 360 // cell
    i = lambda lat: F.least(F.floor((lat + 90) / cell), F.lit(rows - 1)).cast("int")
    j = lambda lng: F.least(F.floor(F.pmod(lng + 180, F.lit(360.0)) / cell), F.lit(columns - 1)).cast("int")
    s = sites.where("lat IS NOT NULL AND lng IS NOT NULL").select("ord", "site", "lat", "lng", i(F.col("lat")).alias("ci"), j(F.col("lng")).alias("cj"))
    left = points.where("plat IS NOT NULL AND plng IS NOT NULL").select("point", "plat", "plng")
    out = None
    for ring in (1, 3, None):
        near = F.sequence(i(F.col("plat")) - ring, i(F.col("plat")) + ring) if ring else F.sequence(F.lit(0), F.lit(rows - 1))
        along = F.transform(F.sequence(j(F.col("plng")) - ring, j(F.col("plng")) + ring), lambda x: F.pmod(x, F.lit(columns))) if ring else F.sequence(F.lit(0), F.lit(columns - 1))
        met = left.withColumn("ci", F.explode(near)).withColumn("cj", F.explode(along)).join(s, ["ci", "cj"])
        met = met.withColumn("km", F.round(haversine(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")), 6))
        best = met.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("km", "ord"))).where(F.col("rank") <= k).select("point", "plat", "site", "km", "rank")
        if ring:
            best = saved(best)
            turn = F.radians(F.lit(float(ring * cell)))
            wide = 6371 * F.least(turn, F.asin(F.cos(F.radians("plat")) * F.sin(turn)))
            sure = best.groupBy("point").agg(F.count("*").alias("n"), F.max("km").alias("far"), F.max(wide).alias("wide")).where((F.col("n") == k) & (F.col("far") < F.col("wide") - 1e-6)).select("point")
            left = saved(left.join(sure, "point", "left_anti"))
            best = best.join(sure, "point", "left_semi")
        best = best.select("point", "site", "km", "rank")
        out = best if out is None else out.unionByName(best)
        if ring and not left.limit(1).count():
            break
    return out


def day_type(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """day, kind, factor, label: holiday before make-up workday before weekend before workday. calendar: day, kind, name.

    The label of a marked day is its kind and name.
    """
    c = days.join(calendar.withColumnRenamed("kind", "marked"), "day", "left")
    kind = F.when(F.col("marked") == "holiday", "holiday").when(F.col("marked") == "makeup", "makeup_workday").when(F.dayofweek("day").isin(1, 7), "weekend").otherwise("workday")
    factor = F.when(kind == "holiday", 1.8).when(kind == "weekend", 1.3).otherwise(1.0)
    named = F.col("marked").isin("holiday", "makeup") & F.col("name").isNotNull()
    return c.select("day", kind.alias("kind"), factor.alias("factor"), F.when(named, F.concat(kind, F.lit(": "), "name")).otherwise(kind).alias("label"))


def weather_factor(text: Column, temp: Column) -> Column:
    t = temp.try_cast("double")
    rules = F.when(text.rlike("storm|heavy"), 0.6).when(text.rlike("rain|snow"), 0.75).when(text.rlike("cloud"), 0.9)
    return F.coalesce(rules.when(t >= 33, 0.8).when(t <= 0, 0.85), F.lit(1.0))


def level(ratio: Column) -> Column:
    out = F.when(ratio >= LEVELS[0][0], LEVELS[0][1])
    for least, name in LEVELS[1:]:
        out = out.when(ratio >= least, name)
    return out.otherwise("comfortable")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tolerance_s: int) -> DataFrame:
    """left rows with the latest right value of the key at most at their time and strictly younger than the tolerance.

    Union and one window per key and hour bucket: right rows are also dealt to the next bucket, so no key stands alone in
    one task and a hot key is split by time. The tolerance must not exceed the bucket.
    """
    bucket = max(tolerance_s, 3600)
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    b = F.floor(sec(F.col(ts)) / bucket)
    probe = left.withColumn("_b", b).withColumn("_t", F.col(ts)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_s", F.lit(1))
    base = right.select(key, F.explode(F.array(b, b + 1)).alias("_b"), F.col(ts).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_s"))
    both = probe.unionByName(base, allowMissingColumns=True)
    w = Window.partitionBy(key, "_b").orderBy("_t", "_s", "_v")
    last = F.last(F.when(F.col("_s") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))), ignorenulls=True).over(w)
    got = both.withColumn("_l", last).where("_s = 1")
    young = (sec(F.col("_t")) - sec(F.col("_l.t"))) < tolerance_s
    return got.withColumn(value, F.when(young, F.col("_l.v"))).select(*left.columns, value)


def hourly_load(events: DataFrame, capacity: DataFrame) -> DataFrame:
    """site, hour, visitors, ratio, level: partial counts take hot sites before the shuffle; capacity is one row a site."""
    n = events.groupBy("site", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("visitors"))
    ratio = F.when(F.col("capacity") > 0, F.col("visitors") / F.col("capacity")).otherwise(0.0)
    return n.join(capacity, "site").select("site", "hour", "visitors", F.round(ratio, 3).alias("ratio"), level(ratio).alias("level"))


def load_curve(load: DataFrame) -> DataFrame:
    """Mean visitors by hour of day, half-even, and the peak (the earliest of equal hours) per site."""
    by = load.groupBy("site", F.hour("hour").alias("h")).agg(F.bround(F.avg("visitors"), 0).cast("long").alias("v"))
    return by.groupBy("site").agg(F.max("v").alias("peak"), F.max_by("h", F.struct("v", -F.col("h"))).alias("peak_hour"), F.sum("v").alias("total"))


def timeline(rows: DataFrame, date: str | None = None, site: str | None = None, keyword: str | None = None) -> DataFrame:
    """Timeline rows (date, site, label, description, …) whose date begins so, whose site contains that, and whose label or
    description holds the keyword; a criterion that is None lets all pass."""
    if date is not None:
        rows = rows.where(F.col("date").startswith(date))
    if site is not None:
        rows = rows.where(F.contains("site", F.lit(site)))
    if keyword is not None:
        rows = rows.where(F.coalesce(F.contains("label", F.lit(keyword)), F.lit(False)) | F.coalesce(F.contains("description", F.lit(keyword)), F.lit(False)))
    return rows


def routes(rows: DataFrame, army: str) -> DataFrame:
    """Routes (army, …) whose army's name contains that."""
    return rows.where(F.contains("army", F.lit(army)))


def site_profile(asked: DataFrame, profiles: DataFrame) -> DataFrame:
    """qid, site, profile of the sites that are asked for (qid, site) by whole name; null where a site has none."""
    return asked.join(profiles.select("site", "profile"), "site", "left").select("qid", "site", "profile")


def cleared(turns: DataFrame, gone: DataFrame) -> DataFrame:
    """The turns of all conversations but those named in `gone`."""
    return turns.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")


def suggested(users: DataFrame, questions: DataFrame, default: str, by: str = "persona") -> DataFrame:
    """The users with the question suggested to their persona (persona, question), else the default."""
    return users.join(questions, by, "left").withColumn("question", F.coalesce("question", F.lit(default)))


def last_turns(turns: DataFrame, n: int = 24) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def memory_batches(turns: DataFrame, keep: int = 8, batch: int = 6) -> DataFrame:
    """The oldest turns in batches once more than `keep` are there; the rest stays verbatim (batch null)."""
    r = numbered(turns.select("conv_id", "turn", "role", "text"), "conv_id", ("turn", "role", "text"))
    batches = F.when(F.col("many") <= keep, 0).otherwise(F.floor((F.col("many") - (keep - batch + 1)) / batch))
    b = F.floor(F.col("number") / batch)
    return r.select("conv_id", "turn", F.when(b < batches, b).cast("int").alias("batch"))


def context(turns: DataFrame, n: int = 6) -> DataFrame:
    """Each user turn with the last n turns of its conversation before it, joined by line breaks."""
    r = with_blocks(numbered(turns.select("conv_id", "turn", "role", "text"), "conv_id", ("turn", "role", "text")), n)
    w = Window.partitionBy("conv_id", "block").orderBy("number").rowsBetween(-n, -1)
    before = r.withColumn("before", F.array_join(F.collect_list("text").over(w), "\n"))
    return before.where("own AND role = 'user'").select("conv_id", "turn", F.concat_ws("\n", F.nullif("before", F.lit("")), "text").alias("query"))


# The personas; the questions that a profile keeps and shows.
PERSONAS = ("student", "tourist", "researcher")
KEPT, SHOWN = 12, 5


def persona_and_questions(asked: DataFrame) -> DataFrame:
    """user_id, persona (the last valid one, `tourist` without any), recent (the last KEPT questions) and shown (SHOWN).

    asked: user_id, ts, event_id, persona, question. Only the last KEPT rows of a user meet in one list.
    """
    at = F.struct("ts", "event_id")
    last = asked.groupBy("user_id").agg(F.max_by("persona", F.when(F.col("persona").isin(*PERSONAS), at)).alias("persona"))
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    q = asked.where("question <> ''").withColumn("back", back).where(F.col("back") <= KEPT)
    q = q.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("back", "question")), asc=False), lambda x: x["question"]).alias("recent"))
    none = F.array().cast("array<string>")
    r = last.join(q, "user_id", "left").withColumn("recent", F.coalesce("recent", none))
    return r.select("user_id", F.coalesce("persona", F.lit("tourist")).alias("persona"), "recent", F.slice("recent", F.greatest(F.size("recent") - SHOWN + 1, F.lit(1)), SHOWN).alias("shown"))


def visit_counts(visits: DataFrame) -> DataFrame:
    """user_id, counts: a map from site to number of visits."""
    by = visits.groupBy("user_id", "site").agg(F.count("*").alias("n"))
    return by.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("site", "n")))).alias("counts"))


def profile(visits: DataFrame, top: int = 3) -> DataFrame:
    """user_id, visits, last_site, preferred (top sites by count, then name)."""
    by = visits.groupBy("user_id", "site").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "site"))
    r = by.withColumn("place", place)
    pref = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "site")))), lambda x: x["site"]), ",")
    return r.groupBy("user_id").agg(F.sum("n").alias("visits"), F.max_by("site", "at").alias("last_site"), pref.alias("preferred"))


def match_coordinates(points: DataFrame, sites: DataFrame, within: float) -> DataFrame:
    """point, site: the first site, by order, within that many degrees on both axes. Cells make it an equi-join."""
    cell = lambda c: F.floor(c / within)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = points.withColumn("o", F.explode(near)).withColumn("ci", cell(F.col("plat")) + F.col("o.i")).withColumn("cj", cell(F.col("plng")) + F.col("o.j"))
    s = sites.withColumn("ci", cell(F.col("lat"))).withColumn("cj", cell(F.col("lng")))
    hit = p.join(s, ["ci", "cj"]).where((F.abs(F.col("plat") - F.col("lat")) <= within) & (F.abs(F.col("plng") - F.col("lng")) <= within))
    return hit.groupBy("point").agg(F.min_by("site", "ord").alias("site"))


def low_effort(sites: DataFrame) -> DataFrame:
    """request, site, place: of each request's sites the max(2, min(count, 2 * days)) with least energy (null: 2), then date."""
    w = Window.partitionBy("request")
    place = F.row_number().over(w.orderBy(F.coalesce("energy", F.lit(2)), "date", "site"))
    r = sites.withColumn("place", place).withColumn("many", F.count("*").over(w))
    return r.where(F.col("place") <= F.greatest(F.lit(2), F.least(F.col("many"), 2 * F.col("days")))).select("request", "site", "place")


def legs(stops: DataFrame) -> DataFrame:
    """The stops with km and hours of the way to them by the first mode; 0 for the first stop and for unknown places."""
    _, speed, overhead, detour, _, _ = MODES[0]
    w = Window.partitionBy("request").orderBy("ord")
    km = F.round(haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")) * detour, 1)
    s = stops.withColumn("km", km)
    return s.withColumn("hours", F.coalesce(F.round(F.col("km") / speed + overhead, 2), F.lit(0.0))).withColumn("km", F.coalesce("km", F.lit(0.0)))


def whole_legs(stops: DataFrame, requests: DataFrame) -> DataFrame:
    """request, leg (outbound, internal or return), ord, day, km, hours: all ways of an itinerary by its mode.

    stops as of itinerary_days. requests: request, mode (road if unknown), dlat, dlng (the departure; null: no way there and
    back), last_day (of the whole course; null: that of the last stop). The way there counts on the first day, the way back
    on the last; ways to or from an unknown place are 0.
    """
    w = Window.partitionBy("request").orderBy("ord")
    s = stops.select("request", "ord", "day", "lat", "lng", F.lag("lat").over(w).alias("plat"), F.lag("lng").over(w).alias("plng"), (F.row_number().over(w) == 1).alias("first"), F.lead("ord").over(w).isNull().alias("last"))
    known = F.broadcast(modes(stops.sparkSession))
    r = requests.withColumn("mode", F.when(F.col("mode").isin(*[m[0] for m in MODES]), F.col("mode")).otherwise(MODES[0][0])).join(known, "mode")
    j = s.join(r, "request")
    way = lambda kind, day, a, b: F.struct(F.lit(kind).alias("leg"), day.cast("int").alias("day"), *[F.col(x).alias(n) for x, n in zip((*a, *b), ("alat", "alng", "blat", "blng"), strict=True)])
    start, here, before = ("dlat", "dlng"), ("lat", "lng"), ("plat", "plng")
    away = F.col("dlat").isNotNull() & F.col("dlng").isNotNull()
    ways = F.array_compact(F.array(
        F.when(~F.col("first"), way("internal", F.col("day"), before, here)), F.when(F.col("first") & away, way("outbound", F.lit(1), start, here)),
        F.when(F.col("last") & away, way("return", F.coalesce("last_day", "day"), here, start)),
    ))
    e = j.select("request", "ord", "speed", "overhead", "detour", F.explode(ways).alias("x"))
    km = F.round(haversine(F.col("x.alat"), F.col("x.alng"), F.col("x.blat"), F.col("x.blng")) * F.col("detour"), 1)
    hours = F.round(km / F.col("speed") + F.col("overhead"), 2)
    return e.select("request", "x.leg", "ord", "x.day", F.coalesce(km, F.lit(0.0)).alias("km"), F.coalesce(hours, F.lit(0.0)).alias("hours"))


def whole_totals(legs_: DataFrame) -> DataFrame:
    """request, ways, total_km, total_hours over the way there, those between stops and the way back."""
    return legs_.groupBy("request").agg(F.count("*").alias("ways"), F.round(F.sum("km"), 1).alias("total_km"), F.round(F.sum("hours"), 2).alias("total_hours"))


def itinerary_totals(stops: DataFrame) -> DataFrame:
    """request, days, total_km, total_hours."""
    return legs(stops).groupBy("request").agg(F.count_distinct("day").alias("days"), F.round(F.sum("km"), 1).alias("total_km"), F.round(F.sum("hours"), 2).alias("total_hours"))


def itinerary_days(stops: DataFrame) -> DataFrame:
    """request, day, stops, km, hours, energy, level, lodging. stops: request, ord (a total order), day, lat, lng, energy, lodging.

    The leg to a stop, by the first mode, counts on its day of arrival; the lodging is that of the day's last stop.
    """
    d = legs(stops).groupBy("request", "day")
    d = d.agg(F.count("*").alias("stops"), F.round(F.sum("km"), 1).alias("km"), F.round(F.sum("hours"), 2).alias("hours"), F.sum("energy").alias("energy"), F.max_by("lodging", "ord").alias("lodging"))
    return d.withColumn("level", F.when(F.col("energy") <= 3, "easy").when(F.col("energy") <= 6, "medium").otherwise("hard"))


def expected_load(bases: DataFrame, weights: DataFrame) -> DataFrame:
    """site, hour, expected: half-even base × weight for each hour of the day (24 rows at most)."""
    return bases.join(F.broadcast(weights), F.col("hour") >= 0).select("site", "hour", F.bround(F.col("base") * F.col("weight"), 0).cast("long").alias("expected"))


def factored_snapshot(asked: DataFrame, expected: DataFrame, capacity: DataFrame, weather: DataFrame, days: DataFrame, hours: tuple[int, ...]) -> DataFrame:
    """day, site, base, visitors, ratio, level, weather_factor, day_factor of the (day, site) that are asked for.

    The base is the half-even mean of the hours; it is corrected by the weather at the site on the day (day, site, text, temp)
    and by the kind of day (day, factor), 1 where either is unknown. No capacity gives ratio 0.
    """
    base = expected.where(F.col("hour").isin(*hours)).groupBy("site").agg(F.bround(F.avg("expected"), 0).cast("long").alias("base"))
    w = weather.select("day", "site", weather_factor(F.coalesce("text", F.lit("")), F.col("temp")).alias("weather_factor"))
    one = lambda c: F.coalesce(c, F.lit(1.0))
    r = asked.select("day", "site").join(base, "site").join(capacity, "site", "left").join(w, ["day", "site"], "left").join(days.select("day", F.col("factor").alias("day_factor")), "day", "left")
    r = r.withColumn("weather_factor", one(F.col("weather_factor"))).withColumn("day_factor", one(F.col("day_factor")))
    r = r.withColumn("visitors", F.bround(F.col("base") * F.col("weather_factor") * F.col("day_factor"), 0).cast("long"))
    ratio = F.when(F.col("capacity") > 0, F.col("visitors") / F.col("capacity")).otherwise(0.0)
    return r.select("day", "site", "base", "visitors", F.round(ratio, 3).alias("ratio"), level(ratio).alias("level"), "weather_factor", "day_factor")


def snapshot_report(points: DataFrame) -> DataFrame:
    """day, total, alerts: visitors of all sites and the names of those at the level `alert`; sites of a day are few."""
    alerts = F.sort_array(F.collect_list(F.when(F.col("level") == "alert", F.col("site"))))
    return points.groupBy("day").agg(F.sum("visitors").alias("total"), F.array_join(alerts, ",").alias("alerts"))


def day_curve(expected: DataFrame, capacity: DataFrame, now: int) -> DataFrame:
    """site, series (the 24 hours in order), peak_hour (the first of equal ones), peak, current and its level at hour `now`."""
    by = expected.where(F.col("hour").between(0, 23)).groupBy("site")
    at = F.struct("hour", "expected")
    r = by.agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["expected"]).alias("series"), F.max("expected").alias("peak"), F.max_by("hour", F.struct("expected", -F.col("hour"))).alias("peak_hour"), F.max(F.when(F.col("hour") == now % 24, F.col("expected"))).alias("current"))
    ratio = F.when(F.col("capacity") > 0, F.col("current") / F.col("capacity")).otherwise(0.0)
    return r.join(capacity, "site", "left").select("site", "series", "peak_hour", "peak", "current", level(ratio).alias("current_level"))


def load_snapshot(expected: DataFrame, capacity: DataFrame, hours: tuple[int, ...], factor: float) -> DataFrame:
    """site, visitors, ratio, level for a slot of hours under the weather and day factor; no capacity gives ratio 0."""
    m = expected.where(F.col("hour").isin(*hours)).groupBy("site").agg(F.bround(F.avg("expected"), 0).alias("mean"))
    n = m.join(capacity, "site", "left").withColumn("visitors", F.bround(F.col("mean") * factor, 0).cast("long"))
    ratio = F.when(F.col("capacity") > 0, F.col("visitors") / F.col("capacity")).otherwise(0.0)
    return n.select("site", "visitors", F.round(ratio, 3).alias("ratio"), level(ratio).alias("level"))


def recall(questions: DataFrame, memories: DataFrame, top: int = 2, least: float = 0.03) -> DataFrame:
    """conv_id, ord, score: the `top` memories of a question's conversation by Jaccard of tokens, then those of `least`.

    One question a conversation, so the join gives one row a memory. (conv_id, ord, tokens) on either side.
    """
    q = questions.select("conv_id", F.col("tokens").alias("asked"))
    j = memories.join(q, "conv_id")
    both, all_ = F.size(F.array_intersect("tokens", "asked")), F.size(F.array_union("tokens", "asked"))
    s = j.withColumn("score", F.when(all_ > 0, both / all_).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "ord"))
    return s.withColumn("place", place).where((F.col("place") <= top) & (F.col("score") >= least)).select("conv_id", "ord", F.round("score", 6).alias("score"))
