"""Entities: exact lookups, trigram candidates by an inverted index, and the resolution ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from factloom.functions.text import entity_name, word_trigrams
from factloom.operators.nearest_names import nearest_names
from factloom.operators.skew import hot_join
from factloom.session import Scratch

THRESHOLD = 0.85
LIMIT = 5


def mentions(facts: DataFrame) -> DataFrame:
    """(name, type, n, first_at): distinct normalized subjects of unresolved facts."""
    named = facts.where(F.col("entity_id").isNull()).select(
        entity_name(F.col("subject_raw"), F.col("subject_type")).alias("name"), F.col("subject_type").alias("type"), "created_at", "fact_id")
    return named.where("name <> ''").groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("created_at", "fact_id")).alias("first_at"))


def alias_exact(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, type, entity_id) by known alias; of several the oldest alias counts."""
    typed = aliases.join(entities.select("entity_id", F.col("entity_type").alias("type")), "entity_id")
    oldest = typed.groupBy(F.col("normalized_alias").alias("name"), "type").agg(F.min(F.struct("created_at", "alias_id", "entity_id")).alias("a"))
    return names.join(oldest, ["name", "type"]).select("name", "type", F.col("a.entity_id").alias("entity_id"))


def canonical_exact(names: DataFrame, entities: DataFrame) -> DataFrame:
    return names.join(entities.select(F.col("normalized_name").alias("name"), F.col("entity_type").alias("type"), "entity_id"), ["name", "type"]).select("name", "type", "entity_id")


def similarities(names: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(name, type, key, similarity) of pairs with trigram similarity >= ``least`` > 0.

    names (name, type) and known (key, other, type) meet on shared trigrams, and only through the
    rarest of them: with a trigrams, a pair above the bound shares at least ceil(a * least), so it
    shares one of the a - ceil(a * least) + 1 rarest. The first trigram shared, in order of rarity, also
    tells how many can follow on either side; pairs that cannot reach the bound are left out before
    they are gathered. Exact, no pair is lost.
    """
    a = names.select("name", "type").distinct().withColumn("g", word_trigrams(F.col("name")))
    b = known.select("key", "other", "type").distinct().withColumn("g", word_trigrams(F.col("other")))
    weight = a.select("type", F.explode("g").alias("t")).unionByName(b.select("type", F.explode("g").alias("t"))).groupBy("type", "t").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(rows: DataFrame, ids: list[str], side: str) -> DataFrame:
        each = rows.select(*ids, "type", F.size("g").alias("size"), F.explode("g").alias("t")).join(weight, ["type", "t"])
        ordered = each.withColumn("r", F.row_number().over(Window.partitionBy(*ids, "type").orderBy("df", "t")))
        return ordered.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select(
            *ids, "type", "t", F.col("size").alias(f"size_{side}"), (F.col("size") - F.col("r") + 1).alias(f"left_{side}"))

    shares = F.ceil((F.col("size_a") + F.col("size_b")) * (least / (1 + least)) - 1e-6)
    met = (prefixes(a, ["name"], "a").join(prefixes(b, ["key", "other"], "b"), ["type", "t"]).where(F.least("left_a", "left_b") >= shares)
           .select("name", "type", "key", "other").distinct())
    full = met.join(a.withColumnRenamed("g", "ga"), ["name", "type"]).join(b.withColumnRenamed("g", "gb"), ["key", "other", "type"])
    shared = F.size(F.array_intersect("ga", "gb"))
    sim = F.round(shared / (F.size("ga") + F.size("gb") - shared), 6)
    return full.select("name", "type", "key", sim.alias("similarity")).where(F.col("similarity") >= least)


def trigram_candidates(names: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.3, limit: int = LIMIT) -> DataFrame:
    """(name, type, entity_id, similarity, rank): the best entities by name or any alias, older ones first in ties."""
    if limit < 1:
        raise ValueError("limit must be a positive integer")
    own = entities.select(F.col("entity_id").alias("key"), F.col("normalized_name").alias("other"), F.col("entity_type").alias("type"))
    more = aliases.join(entities.select("entity_id", F.col("entity_type").alias("type")), "entity_id").select(F.col("entity_id").alias("key"), F.col("normalized_alias").alias("other"), "type")
    first = entities.groupBy(F.col("entity_id").alias("key")).agg(F.min("created_at").alias("created_at"))
    found = nearest_names(names, own.unionByName(more).distinct().join(first, "key"), least, limit)
    best = found.groupBy("name", "type", "key").agg(F.max("similarity").alias("similarity"))
    dated = best.join(entities.select(F.col("entity_id").alias("key"), "created_at"), "key")
    order = Window.partitionBy("name", "type").orderBy(F.desc("similarity"), F.asc_nulls_last("created_at"), "key")
    return dated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("name", "type", F.col("key").alias("entity_id"), "similarity", "rank")


def resolve(facts: DataFrame, entities: DataFrame, aliases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(fact_id, entity_id, match_method, similarity) for unresolved facts with a name.

    Ladder: alias, canonical name, trigram similarity, else a new entity (id from its name). Names
    that end up alike found one entity: the first seen founds it, later ones join it through the
    similarity edges between them.
    """
    names = mentions(facts)
    by_alias = alias_exact(names, entities, aliases).withColumn("match_method", F.lit("ALIAS_EXACT")).withColumn("similarity", F.lit(1.0))
    rest = names.join(by_alias.select("name", "type"), ["name", "type"], "left_anti")
    by_name = canonical_exact(rest, entities).withColumn("match_method", F.lit("CANONICAL_EXACT")).withColumn("similarity", F.lit(1.0))
    rest = rest.join(by_name.select("name", "type"), ["name", "type"], "left_anti")
    old = trigram_candidates(rest, entities, aliases, threshold, 1).select("name", "type", "entity_id", "similarity")
    edges = similarities(rest, rest.select(F.col("name").alias("key"), F.col("name").alias("other"), "type"), threshold).where("name <> key")
    grown = place_in_order(rest.join(old, ["name", "type"], "left").select("name", "type", "first_at", "entity_id", "similarity"), edges)
    every = by_alias.select("name", "type", "entity_id", "match_method", "similarity").unionByName(by_name.select("name", "type", "entity_id", "match_method", "similarity")).unionByName(grown)
    every = every.join(names.select("name", "type", "n"), ["name", "type"])
    named = facts.where(F.col("entity_id").isNull()).select("fact_id", entity_name(F.col("subject_raw"), F.col("subject_type")).alias("name"), F.col("subject_type").alias("type"))
    return hot_join(named, every, ["name", "type"], "n", facts.count()).select("fact_id", "entity_id", "match_method", "similarity")


def place_in_order(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, type, entity_id, match_method, similarity): what a pass over the names in order of first_at would decide.

    names: name, type, first_at and, where an old entity is similar, entity_id and similarity. A name
    follows the most similar of its old entity and the similar names before it (of equals the old entity, then
    the earliest name); a name with neither founds an entity. A name is decided once all names before it
    that are similar are: rounds of joins, as many as the longest chain of such names, and no group in one task.
    """
    scratch = Scratch(names.sparkSession, "entities")
    order = names.select(F.col("name").alias("key"), "type", F.col("first_at").alias("before"))
    earlier = scratch.keep(edges.select("name", "type", "key", F.col("similarity").alias("s")).join(names.select("name", "type", "first_at"), ["name", "type"])
                           .join(order, ["key", "type"]).where("before < first_at").select("name", "type", "key", "s", "before"))
    waits = earlier.groupBy("name", "type").agg(F.count(F.lit(1)).alias("waits"))
    pending = scratch.keep(names.join(waits, ["name", "type"], "left").fillna(0, ["waits"]))

    def decide(rows: DataFrame) -> DataFrame:
        old = F.when(F.col("entity_id").isNotNull() & (F.col("similarity") >= F.coalesce("near.s", F.lit(0.0))), F.struct("entity_id", F.col("similarity").alias("s")))
        best = F.coalesce(old, F.when(F.col("near").isNotNull(), F.struct(F.col("near.entity_id").alias("entity_id"), F.col("near.s").alias("s"))))
        new = F.concat(F.lit("new-"), F.sha2(F.concat_ws("|", "type", "name"), 256))
        return rows.withColumn("best", best).select(
            "name", "type", F.coalesce("best.entity_id", new).alias("entity_id"), F.when(F.col("best").isNull(), "CREATED").otherwise("TRIGRAM").alias("match_method"),
            F.coalesce("best.s", F.lit(1.0)).alias("similarity"))

    near = "struct<entity_id:string,s:double>"
    done = scratch.keep(decide(pending.where("waits = 0").withColumn("near", F.lit(None).cast(near))))
    pending = scratch.keep(pending.where("waits > 0"))
    while not pending.isEmpty():
        known = done.select(F.col("name").alias("key"), "type", F.col("entity_id").alias("to"))
        met = earlier.join(known, ["key", "type"]).groupBy("name", "type").agg(
            F.count(F.lit(1)).alias("seen"), F.min_by(F.struct(F.col("to").alias("entity_id"), "s"), F.struct(-F.col("s"), "before", "key")).alias("near"))
        ready = scratch.keep(decide(pending.join(met, ["name", "type"]).where("seen = waits")))
        after, rest = scratch.keep(done.unionByName(ready)), scratch.keep(pending.join(ready.select("name", "type"), ["name", "type"], "left_anti"))
        for gone in (done, pending, ready):
            scratch.drop(gone)
        done, pending = after, rest
    return done


def learned_aliases(resolved: DataFrame, facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases to add: names matched by canonical name or similarity, first writer wins."""
    seen = resolved.where(F.col("match_method").isin("CANONICAL_EXACT", "TRIGRAM")).join(
        facts.select("fact_id", "subject_raw", "subject_type", "document_id", "created_at"), "fact_id")
    made = seen.select("entity_id", F.col("subject_raw").alias("alias"), entity_name(F.col("subject_raw"), F.col("subject_type")).alias("normalized_alias"),
                       "document_id", F.col("similarity").alias("confidence"), "created_at")
    first = made.groupBy("entity_id", "normalized_alias").agg(F.min(F.struct("created_at", "alias", "document_id", "confidence")).alias("x")).select(
        "entity_id", "normalized_alias", "x.alias", "x.document_id", "x.confidence", "x.created_at")
    return first.join(aliases.select("entity_id", "normalized_alias"), ["entity_id", "normalized_alias"], "left_anti")
