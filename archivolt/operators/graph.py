"""Entities and relations: extraction, validation, resolution, duplicates, review, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators.matching import found_phrases
from archivolt.operators.pairs import similar, within_edits

HASH_ID = "^[A-Z]_[0-9A-F]{8}$"


def dictionary_mentions(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, name) wherever an entity's name or alias occurs in the text, within a word or over several too."""
    parts = entities.select(F.col("name").alias("eid"), F.explode(F.array_distinct(F.array("name", "alias"))).alias("part"))
    return found_phrases(docs, parts.where("part <> ''")).select("doc_id", F.col("eid").alias("name"))


def date_mentions(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, iso): all matches of a pattern with three number groups as zero-padded dates; no calendar check."""
    hit = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"))
    part = lambda i, n: F.lpad(F.regexp_extract("m", pattern, i), n, "0")
    return hit.select("doc_id", F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)).alias("iso"))


def validated(mentions: DataFrame) -> DataFrame:
    """issues and confidence of each mention; the frequency of its name comes by groupBy and join, not by a hot window."""
    m = mentions.withColumn("key", X.normalize_name(F.col("name")))
    m = m.join(m.groupBy("key").agg(F.count("*").alias("freq")), "key")
    n = F.length(X.strip(F.col("name")))
    issues = F.array_compact(F.array(F.when(n < 2, F.lit("short")), F.when(n > 24, F.lit("long")), F.when(F.col("name").rlike(r"\d{4,}"), F.lit("digits")), F.when(F.col("freq") == 1, F.lit("rare"))))
    return m.withColumn("issues", F.array_join(issues, ",")).withColumn("confidence", F.coalesce("confidence", F.when(F.size(issues) > 0, 0.55).otherwise(0.85)))


def resolve(items: DataFrame, save) -> DataFrame:
    """(ord, root): each item joins the earliest item before it that owns its name (base items and blank names are roots).

    items: ord, is_base, name_key, keys (array). Pointer jumping; `save` cuts the lineage of each round.
    """
    owner = items.select("ord", F.explode("keys").alias("key")).where("key <> ''").groupBy("key").agg(F.min("ord").alias("first"))
    named = items.join(owner, items["name_key"] == owner["key"], "left")
    parent = F.when(F.col("is_base") | (F.col("name_key") == "") | F.col("first").isNull() | (F.col("first") >= F.col("ord")), F.col("ord")).otherwise(F.col("first"))
    roots = save(named.select("ord", parent.alias("root")))
    while True:
        up = roots.select(F.col("ord").alias("root"), F.col("root").alias("next"))
        step = save(roots.join(up, "root").select("ord", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        moved = step.where("moved").limit(1).count()
        roots = step.select("ord", "root")
        if not moved:
            return roots


def merged_entities(items: DataFrame, roots: DataFrame) -> DataFrame:
    """id, name, type, aliases, description, confidence, is_base of each root.

    items: ord, is_base, id, name, type, aliases, description, confidence. A root takes the aliases that it lacks from what
    joins it, in order, and the first description if it has none; new ones get a stable id and a confidence of 0.8.
    """
    of = items.join(roots, "ord")
    alias = of.select("root", "ord", F.posexplode("aliases").alias("pos", "alias")).where("trim(alias) <> ''")
    alias = alias.groupBy("root", "alias").agg(F.min(F.struct("ord", "pos")).alias("at"))
    alias = alias.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("all"))
    told = of.where("description IS NOT NULL").groupBy("root").agg(F.min_by("description", "ord").alias("told"))
    r = items.join(roots.where("ord = root").select(F.col("root").alias("ord")), "ord").withColumn("root", F.col("ord")).join(alias, "root", "left").join(told, "root", "left")
    name = F.when(F.col("is_base"), F.col("id")).otherwise(X.entity_id(F.col("type"), F.col("name")))
    return r.select(name.alias("id"), "name", "type", F.coalesce("all", F.array().cast("array<string>")).alias("aliases"), F.coalesce("description", "told").alias("description"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"), "is_base")


def near_duplicates(entities: DataFrame, least: float = 0.8) -> DataFrame:
    """a_id, b_id, ratio: entities whose normal names differ and match to `least` of their characters; lossless.

    entities: ord, id, name. The earlier name comes first. Of entities with one normal name the first stands for all.
    """
    e = entities.where(F.length("name") >= 2).withColumn("key", X.normalize("name")).where("key <> ''")
    one = e.groupBy("key").agg(F.min(F.struct("ord", "id")).alias("x")).select("key", "x.ord", "x.id")
    met = similar(one.select(F.col("key").alias("a")), one.select(F.col("key").alias("b")), least).where("a <> b")
    side = lambda p: one.select(F.col("key").alias(p), F.col("id").alias(f"{p}_id"), F.col("ord").alias(f"{p}_ord"))
    return met.join(side("a"), "a").join(side("b"), "b").where("a_ord < b_ord").select("a_id", "b_id", F.round("ratio", 3).alias("ratio"))


def exact_duplicates(entities: DataFrame) -> DataFrame:
    """key, n, keep_id: groups of one normal name; the first id that is no hash id stays, else the first."""
    e = entities.withColumn("key", X.normalize(F.lower("name"))).where("key <> ''")
    keep = F.min_by("id", F.struct(F.col("id").rlike(HASH_ID), F.col("ord")))
    return e.groupBy("key").agg(F.count("*").alias("n"), keep.alias("keep_id")).where("n > 1")


def near_pairs(names: DataFrame, most: int = 2) -> DataFrame:
    """Pairs of different names within an edit distance, blocked without loss.

    An edit destroys two bigrams at most: names meet on bigrams, rarest first, as many as the edits can destroy and one more.
    Names with fewer bigrams than that can lose all of them: they meet on what is left of them without a few characters.
    """
    n = names.select("name").distinct()
    grams = n.select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1))), lambda i: F.substring("name", i, F.lit(2))))).alias("g"))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    order = F.row_number().over(Window.partitionBy("name").orderBy("df", "g"))
    prefix = grams.join(df, "g").withColumn("r", order).where(F.col("r") <= 2 * most + 1).select("name", "g")
    a, b = prefix.select(F.col("name").alias("a"), "g"), prefix.select(F.col("name").alias("b"), "g")
    met = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= most)).select("a", "b")
    many = grams.groupBy("name").agg(F.count("*").alias("many"))
    few = lambda most_, c: many.where(F.col("many") <= most_).select(F.col("name").alias(c))
    # A name near one of few bigrams has few itself: an edit makes two new ones at most.
    alike = within_edits(few(2 * most, "a"), few(4 * most, "b"), most).where("a <> b")
    met = met.union(alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    return met.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= most)


def reviewed(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entities after review: removed ones go, renamed ones get the canonical name. decisions: one row a name."""
    d = decisions.select(X.strip(F.col("name")).alias("key"), "action", "canonical_name")
    e = entities.join(d, X.strip(entities["name"]) == d["key"], "left")
    name = F.when(F.col("action") == "rename", F.col("canonical_name")).otherwise(F.col("name"))
    return e.where("action IS NULL OR action <> 'remove'").select("id", name.alias("name"), F.coalesce("action", F.lit("pending")).alias("status"))


def removed_ids(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    d = decisions.where("action = 'remove'").select(X.strip(F.col("name")).alias("key")).distinct()
    return entities.join(d, X.strip(entities["name"]) == d["key"], "left_semi").select("id")


def reviewed_relations(relations: DataFrame, entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Relations without those that touch a removed entity at either end."""
    gone = removed_ids(entities, decisions)
    for end in ("source", "target"):
        relations = relations.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return relations


def review_stats(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """action, n: entities approved, renamed and removed, and the decisions on names that no entity has (missing)."""
    names = entities.select(X.strip(F.col("name")).alias("key"))
    d = decisions.select(X.strip(F.col("name")).alias("key"), "action")
    done = names.join(d, "key").groupBy("action").agg(F.count("*").alias("n"))
    missing = d.join(names.distinct(), "key", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing").alias("action"), "n")
    return done.unionByName(missing)


def pending(names: DataFrame, resolved: DataFrame) -> DataFrame:
    """The names of a review list that are not resolved yet."""
    return names.join(resolved.select("name").distinct(), "name", "left_anti")


def values_by_type(entities: DataFrame, column: str) -> DataFrame:
    """type, entities, values: how many entities a type has, and the different values of a column of few values."""
    return entities.groupBy("type").agg(F.count("*").alias("entities"), F.array_join(F.sort_array(F.collect_set(column)), ",").alias("values"))


def graph_summary(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """metric, name, n: totals of both tables, entities per type, relations per relation type."""
    count = lambda df, metric, name: df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "name", "n")
    all_ = [count(df, "total", F.lit(n)) for df, n in ((entities, "entities"), (relations, "relations"))]
    return all_[0].union(all_[1]).union(count(entities, "entities", F.col("type"))).union(count(relations, "relations", F.col("relation")))


def query_seeds(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id) of the entities that a query asks for: any of its criteria will do, none gives no seed.

    entities: id, name, type, aliases, description, year. queries: qid, entity (a whole name or alias), event (a part of an
    event's name or alias), topic (a part of a name, alias or description), year.
    """
    said = entities.select("id", "type", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("text")).where("text IS NOT NULL")
    told = entities.select("id", F.col("description").alias("text")).where("text IS NOT NULL")
    part = lambda name: queries.where(F.col(name) != "").select(F.col("qid").alias("eid"), F.col(name).alias("part"))
    holds = lambda texts, name: found_phrases(texts.select(F.struct("id", "text").alias("doc_id"), "text"), part(name)).select(F.col("eid").alias("qid"), F.col("doc_id.id").alias("id"))
    whole = queries.where("entity <> ''").select("qid", F.col("entity").alias("text")).join(said, "text").select("qid", "id")
    dated = queries.where("year IS NOT NULL").select("qid", F.col("year").cast("string").alias("y")).join(entities.select("id", F.col("year").cast("string").alias("y")), "y").select("qid", "id")
    named = holds(said.where("type = 'event'"), "event").union(holds(said.select("id", "text").union(told), "topic"))
    return whole.union(dated).union(named).distinct()


def problems(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """problem, ref: repeated ids, dangling ends, blank relations."""
    dup = entities.groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("problem"), F.col("id").alias("ref"))
    ends = [relations.join(entities.select(F.col("id").alias(c)), c, "left_anti").select(F.lit(f"dangling_{c}").alias("problem"), F.col("rid").alias("ref")) for c in ("source", "target")]
    blank = relations.where(X.strip(F.coalesce("relation", F.lit(""))) == "").select(F.lit("blank_relation").alias("problem"), F.col("rid").alias("ref"))
    return dup.union(ends[0]).union(ends[1]).union(blank)


def neighbours(seeds: DataFrame, relations: DataFrame, limit: int, kinds: DataFrame | None = None) -> DataFrame:
    """First relations, in order, that touch a query's seed at either end: two equi-joins. seeds: qid, id.

    kinds: (qid, relation) for queries that want one type of relation only; the others take all.
    """
    if kinds is not None:
        wanted = kinds.select("qid", F.col("relation").alias("kind"))
        some = neighbours(seeds.join(wanted.select("qid"), "qid", "left_semi").join(wanted, "qid").select("qid", "id", "kind"), relations, limit)
        return neighbours(seeds.join(wanted.select("qid"), "qid", "left_anti"), relations, limit).unionByName(some)
    limit = max(1, limit)
    if "kind" in seeds.columns:
        relations = relations.withColumn("kind", F.col("relation"))
        on = lambda end: [relations[end] == seeds["id"], relations["kind"] == seeds["kind"]]
    else:
        on = lambda end: [relations[end] == seeds["id"]]
    one = relations.join(seeds, on("source")).select("qid", "ord", "rid", F.col("target").alias("other"))
    two = relations.join(seeds, on("target")).select("qid", "ord", "rid", F.col("source").alias("other"))
    first = F.row_number().over(Window.partitionBy("qid").orderBy("ord", "other"))
    return one.union(two).dropDuplicates(["qid", "rid"]).withColumn("place", first).where(F.col("place") <= limit)


def coerced_type(c: Column, allowed: tuple[str, ...], rules: tuple[tuple[str, str], ...]) -> Column:
    """An allowed type as it is, else that of the first rule whose text it contains, else 'other'."""
    out = F.when(c.isin(*allowed), c)
    for part, kind in rules:
        out = out.when(F.contains(c, F.lit(part)), F.lit(kind))
    return out.otherwise("other")


def without_junk(mentions: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """Mentions whose stripped name has two characters or more and is not in the stop list."""
    name = X.strip(F.col("name"))
    return mentions.where((F.length(name) >= 2) & ~name.isin(*stop))


def generic(entities: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Entities whose normal name is one of the generic ones."""
    return entities.where(X.normalize(F.lower("name")).isin(*names))


def exported(relations: DataFrame) -> DataFrame:
    """id, source, relation, label of the edges; an edge without a label has its relation for one."""
    return relations.select("id", "source", "relation", F.coalesce("label", "relation").alias("label"))


def side_by_side(pairs: DataFrame, members: DataFrame, first: int = 5) -> DataFrame:
    """a, b and of each the number of its members (site, member) and the first ones. The pairs (a, b) are stated."""
    n = members.groupBy("site").agg(F.count("*").alias("n"))
    i = F.row_number().over(Window.partitionBy("site").orderBy("member"))
    near = members.withColumn("i", i).where(F.col("i") <= first).groupBy("site").agg(F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("near"))
    k = n.join(near, "site")
    side = lambda x: k.select(F.col("site").alias(x), F.col("n").alias(f"n_{x}"), F.col("near").alias(f"near_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def nodes(entities: DataFrame, kind: str | None = None) -> DataFrame:
    """id, type, name, description, aliases of all entities or those of one type; what is missing is empty."""
    e = entities if kind is None else entities.where(F.col("type") == kind)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return e.select(*[blank(c) for c in ("id", "type", "name", "description")], F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def compared(pairs: DataFrame, profiles: DataFrame, events: DataFrame, relations: DataFrame, limit: int = 5) -> DataFrame:
    """a, b, side, kind, ord, item: what is known of both sites of each pair, a row each.

    kind: profile (one row, `not found` without a profile, and then nothing else), event (all events by their order) and
    relation (the first `limit` that touch the site). profiles: site, profile. events: site, ord, label. relations: ord, rid,
    source, target. Long rows instead of lists: a site with many events stays many rows.
    """
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("site")), F.struct(F.lit("b").alias("side"), F.col("b").alias("site")))).alias("x")).select("a", "b", "x.side", "x.site")
    known = sides.join(profiles.select("site", "profile"), "site", "left")
    row = lambda df, kind, ord_, item: df.select("a", "b", "side", F.lit(kind).alias("kind"), ord_.cast("long").alias("ord"), item.cast("string").alias("item"))
    found = known.where("profile IS NOT NULL")
    seeds = found.select(F.col("site").alias("qid"), F.col("site").alias("id")).distinct()
    near = neighbours(seeds, relations, limit).select(F.col("qid").alias("site"), F.col("place"), "rid")
    out = row(known, "profile", F.lit(0), F.coalesce("profile", F.lit("not found")))
    return out.unionByName(row(found.join(events, "site"), "event", F.col("ord"), F.col("label"))).unionByName(row(found.join(near, "site"), "relation", F.col("place"), F.col("rid")))


def with_verdicts(entities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """ord, name, verdict, canonical, confidence: a name without verdict is suspicious (0.5); verdicts: one row a name."""
    v = verdicts.select(F.col("name").alias("_n"), "verdict", "canonical", "confidence")
    j = entities.join(v, entities["name"] == v["_n"], "left")
    sure = F.when(F.col("verdict").isNull(), 0.5).otherwise(F.coalesce("confidence", F.lit(0.6)))
    return j.select("ord", "name", F.coalesce("verdict", F.lit("suspicious")).alias("verdict"), F.coalesce("canonical", "name").alias("canonical"), sure.alias("confidence"))


def renamed_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Both ends renamed through the normal name to the canonical one (the last of a name wins); others stay."""
    names = entities.groupBy(X.normalize_name(F.col("name")).alias("key")).agg(F.max_by("canonical", "ord").alias("canonical"))
    out = relations
    for end in ("source", "target"):
        n = names.select(F.col("key").alias("_k"), F.col("canonical").alias("_c"))
        out = out.join(n, X.normalize_name(out[end]) == n["_k"], "left").withColumn(end, F.coalesce("_c", end)).drop("_k", "_c")
    return out


def merged_relations(new: DataFrame, names: DataFrame, rules: DataFrame, base: DataFrame) -> DataFrame:
    """Resolved, rule-checked new relations that the base lacks; the first of each (source, target, relation).

    names: name, id, type, one row a name. rules: relation, stype, ttype (nulls allow any); relations without a rule go.
    A relation that fits only the other way round is turned.
    """
    side = lambda p: names.select(F.col("name").alias(p), F.col("id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type"))
    j = new.join(side("source"), "source").join(side("target"), "target").join(rules, "relation")
    fits = lambda a, b: F.coalesce(F.col("stype") == F.col(f"{a}_type"), F.col("stype").isNull()) & F.coalesce(F.col("ttype") == F.col(f"{b}_type"), F.col("ttype").isNull())
    j = j.withColumn("ahead", fits("source", "target")).where(F.col("ahead") | fits("target", "source"))
    ends = j.select("ord", "relation", "label", F.when(F.col("ahead"), F.col("source_id")).otherwise(F.col("target_id")).alias("source"), F.when(F.col("ahead"), F.col("target_id")).otherwise(F.col("source_id")).alias("target"))
    first = ends.groupBy("source", "target", "relation").agg(F.min_by("label", "ord").alias("label"))
    fresh = first.join(base, ["source", "target", "relation"], "left_anti")
    digest = F.upper(F.substring(F.sha1(F.concat_ws(":", "source", "relation", "target")), 1, 8))
    return fresh.select(F.concat(F.lit("X_"), digest).alias("id"), "source", "target", "relation", F.coalesce("label", "relation").alias("label"))


def kept_ids(entities: DataFrame) -> DataFrame:
    """(key, keep_id, n, first): the id that entities of a normal name keep, their number and the place of the first.

    entities: ord, id, name. Ids given by hand go before hash ids, then the first counts. Blank names have no group.
    """
    e = entities.withColumn("key", X.normalize(F.lower("name"))).where("key <> ''")
    return e.groupBy("key").agg(F.min_by("id", F.struct(F.col("id").rlike(HASH_ID), F.col("ord"))).alias("keep_id"), F.count("*").alias("n"), F.min("ord").alias("first"))


def merged_duplicates(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, keep_id, n, aliases, properties) of each normal name, and the map id → keep_id, one row an id.

    entities: ord, id, name, aliases, properties. Of each property the first value by ord stays. Groups shuffle as sets
    of distinct aliases and one value a property, so copies do not pile up. An id of several groups goes to the first of
    those that have copies.
    """
    e = entities.withColumn("key", X.normalize(F.lower("name"))).where("key <> ''")
    kept = kept_ids(entities)
    alias = e.select("key", F.explode("aliases").alias("a")).groupBy("key").agg(F.sort_array(F.collect_set("a")).alias("aliases"))
    prop = e.select("key", "ord", F.explode("properties").alias("k", "v")).groupBy("key", "k").agg(F.min_by("v", "ord").alias("v"))
    prop = prop.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("properties"))
    ids = e.select("key", "id").join(kept, "key").groupBy("id").agg(F.min_by("keep_id", F.struct(F.col("n") == 1, F.col("first"))).alias("keep_id"))
    return kept.drop("first").join(alias, "key", "left").join(prop, "key", "left"), ids


def redirected(relations: DataFrame, ids: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Relations with both ends redirected by a map id → keep_id, one row each; equal relations are not joined up.

    Hash ids have 32 bits, so different entities may share one. Where the relations hold the name of an end's entity
    (source_name, target_name), that end goes by the name to `kept` (key, keep_id) instead, and the name is left out.
    """
    out = relations
    for end in ("source", "target"):
        name = f"{end}_name"
        if kept is not None and name in out.columns:
            m, by = kept.select(F.col("key").alias("_i"), F.col("keep_id").alias("_k")), X.normalize(F.lower(name))
        else:
            m, by = ids.select(F.col("id").alias("_i"), F.col("keep_id").alias("_k")), F.col(end)
        out = out.join(m, by == m["_i"], "left").withColumn(end, F.coalesce("_k", end)).drop("_i", "_k", name)
    return out


def timeline_mentions(docs: DataFrame, events: DataFrame, lead: int = 12) -> tuple[DataFrame, DataFrame]:
    """(doc_id, eid) of events whose label or start of description stands in the text, and (doc_id, eid, place) relations.

    events: eid, label, description, place. An event without a description stands in every text.
    """
    start = F.substring(F.coalesce("description", F.lit("")), 1, lead)
    met = found_phrases(docs, events.select("eid", F.explode(F.array_distinct(F.array(F.nullif("label", F.lit("")), start))).alias("part")))
    return met, met.join(events.where("place IS NOT NULL").select("eid", "place"), "eid").select("doc_id", "eid", "place")


def split_verdicts(judged: DataFrame, with_suspicious: bool = False) -> DataFrame:
    """Judged entities that enter the merge, under their canonical names: rejected ones go, suspicious ones if not asked for."""
    kept = ("confirmed", "suspicious") if with_suspicious else ("confirmed",)
    return judged.where(F.col("verdict").isin(*kept)).withColumn("name", F.col("canonical"))


def with_fallback(docs: DataFrame, external: DataFrame, entities: DataFrame, stop: tuple[str, ...], events: DataFrame | None = None, dates: str | None = None) -> DataFrame:
    """(doc_id, name, how): external mentions, and what the rules find in texts that have none; no junk names.

    The rules: names of the dictionary, labels of timeline events (eid, label, description, place), dates of a pattern.
    """
    bare = docs.join(external.select("doc_id").distinct(), "doc_id", "left_anti")
    rules = dictionary_mentions(bare, entities)
    if events is not None:
        rules = rules.union(timeline_mentions(bare, events)[0].join(events.select("eid", "label"), "eid").select("doc_id", "label"))
    if dates is not None:
        rules = rules.union(date_mentions(bare, dates))
    rules = rules.distinct().withColumn("how", F.lit("rules"))
    return without_junk(external.select("doc_id", "name", F.lit("external").alias("how")).unionByName(rules), stop)
