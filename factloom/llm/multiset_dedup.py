"""Duplicates hidden by formatting differences (problem 7).

Each record is a set of named values. A normalized (name, value) pair is hashed, the hashes of a
record are added up - addition commutes, so field order does not matter and nothing is sorted -
and records with one fingerprint in one scope are compared field by field with the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.skew import hot_join
from factloom.session import Scratch

BLANK = r"[\s\p{Z}]+"
LANE = 2**47 - 1  # 47 bits of each hash: the sum of up to 65,536 of them stays within a BIGINT
NULL = "\x00null"


def fold_text(c: Column) -> Column:
    """Without white space, letter case and punctuation; null stays apart from the empty text."""
    return F.coalesce(F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{P}]+", ""), F.lit(NULL))


def fold_value(c: Column) -> Column:
    """As fold_text, but keeps what bears on the amount.

    Kept: a sign or bracket in front, the decimal point or comma, percent and per-mille signs,
    symbols of currency. Commas that group thousands (also in the Indian way) go.
    """
    s = F.regexp_replace(F.lower(c), BLANK, "")
    sign = F.regexp_extract(s, r"^[(\-−–]", 0)
    s = F.regexp_replace(s, r"(?<=\d),(?=(?:\d{2,3},)*\d{3}(?!\d))", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?<=\d)\.(?=\d)", "¦"), r"(?<=\d),(?=\d)", "¬")  # symbols, no punctuation
    return F.coalesce(F.concat(sign, F.regexp_replace(s, r"[\p{P}&&[^%‰]]+", "")), F.lit(NULL))


def qualifier_map(c: Column) -> Column:
    """Folded name -> folded value of a JSON object; a text that is none is one value under its own name."""
    parsed = F.from_json(c, "map<string,string>")
    entries = F.transform(F.map_entries(parsed), lambda e: F.struct(fold_text(e["key"]).alias("key"), fold_value(e["value"]).alias("value")))
    broken = F.create_map(F.lit("\x00text"), fold_value(c))
    return F.when(c.isNull(), F.create_map().cast("map<string,string>")).when(parsed.isNull(), broken).otherwise(F.map_from_entries(entries))


def _lane(name: Column, value: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), name, value).bitwiseAND(F.lit(LANE))


def fingerprint(fields: dict[str, Column], bag: Column, seed: int) -> Column:
    total = F.aggregate(F.map_entries(bag), F.lit(0).cast("bigint"),
                        lambda acc, e: acc + _lane(F.concat(F.lit("q:"), e["key"]), e["value"], seed))
    for name, value in fields.items():
        total = total + _lane(F.lit(name), value, seed)
    return total


def same_bag(a: Column, b: Column) -> Column:
    """Equal maps, without sorting: as many entries, and each is found in the other."""
    return (F.size(a) == F.size(b)) & F.forall(F.map_entries(a), lambda e: F.coalesce(F.try_element_at(b, e["key"]) == e["value"], F.lit(False)))


def duplicate_sets(facts: DataFrame, id_col: str = "fact_id", scope: str = "document_id") -> DataFrame:
    """(first_fact_id, copy_fact_id, n_copies): one row for each member of a set of two or more, the first too.

    A null scope is no scope: such rows have no copies. Null fields equal null only. Two rows under
    one id are one record (the pair of an id with itself is not reported). Extra columns are
    ignored. An empty table gives an empty result. Group keys with a large share of all rows are
    joined by broadcast (hot_join); the groups themselves are never gathered.
    """
    spark = facts.sparkSession
    fields = {"subject": fold_text(F.col("subject_raw")), "predicate": fold_text(F.col("predicate_raw")), "value": fold_value(F.col("value_raw"))}
    base = facts.where(F.col(scope).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("fact_id"), F.col(scope).alias("scope"), *[v.alias(k) for k, v in fields.items()],
        qualifier_map(F.col("qualifiers")).alias("bag"))
    named = {k: F.col(k) for k in fields}
    base = base.withColumn("h1", fingerprint(named, F.col("bag"), 1)).withColumn("h2", fingerprint(named, F.col("bag"), 2))
    scratch = Scratch(spark, "p7")
    base = scratch.keep(base)  # folded once, read for the groups and again for their members
    keys = ["scope", "h1", "h2"]
    record = F.struct(*fields, "bag")
    groups = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first"),
                                     F.min_by(record, "fact_id").alias("head")).where("n > 1")
    total = facts.count()
    met = hot_join(base, groups, keys, "n", total).where(F.col("fact_id").isNotNull())
    equal = same_bag(F.col("bag"), F.col("head.bag"))
    for k in fields:
        equal = equal & (F.col(k) == F.col(f"head.{k}"))
    checked = scratch.keep(met.select("first", "fact_id", equal.alias("equal"), "scope"))
    right = checked.where("equal").select(F.col("first").alias("first_fact_id"), F.col("fact_id").alias("copy_fact_id"))
    collided = checked.where("not equal").select("fact_id")
    if not collided.isEmpty():
        # Fingerprints that collide: those few records are grouped by their fields as they are.
        text = F.concat_ws("\x01", F.array_sort(F.transform(F.map_entries("bag"), lambda e: F.concat_ws("\x02", e["key"], e["value"]))))
        rest = base.join(collided, "fact_id", "left_semi").withColumn("bag_text", text)
        exact = ["scope", *fields, "bag_text"]
        heads = rest.groupBy(*exact).agg(F.min("fact_id").alias("first_fact_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        right = right.unionByName(hot_join(rest, heads, exact, "n", total).select("first_fact_id", F.col("fact_id").alias("copy_fact_id")))
    return right.distinct()


def copies(facts: DataFrame) -> DataFrame:
    """p7_found: one row for each copy but the first."""
    return duplicate_sets(facts).where("first_fact_id <> copy_fact_id")


def statements(facts: DataFrame) -> DataFrame:
    """Each distinct statement once (by its smallest fact_id) with its number of copies."""
    sets = duplicate_sets(facts)
    counts = sets.groupBy("first_fact_id").agg(F.count(F.lit(1)).alias("n_copies"))
    dropped = sets.where("first_fact_id <> copy_fact_id").select(F.col("copy_fact_id").alias("fact_id"))
    return (facts.select("fact_id", "document_id").join(dropped, "fact_id", "left_anti")
            .join(counts.withColumnRenamed("first_fact_id", "fact_id"), "fact_id", "left")
            .select("fact_id", "document_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies")))
