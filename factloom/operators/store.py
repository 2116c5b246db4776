"""Keyed changes to tables as set operations: upsert, insert if absent, replace by key, cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keyed_upsert(existing: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """New rows replace those of the same key; within the new rows the one with the greatest ``newest`` counts."""
    others = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(newest, F.xxhash64(*others))).alias("x")).select(*keys, "x.*")
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*existing.columns))


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], oldest: str) -> DataFrame:
    """The first writer of a key wins, among old rows and new ones."""
    others = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(oldest, F.xxhash64(*others))).alias("x")).select(*keys, "x.*")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def replace_by(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that come anew are replaced."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*existing.columns))


def cascade(documents: DataFrame, gone: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left after documents are deleted.

    children: facts, evidence, fact_embeddings, fact_relationships, entity_aliases, as present. Facts go with their document,
    all that hangs on a fact goes with it; aliases stay and forget the document; entities stay.
    """
    left = {"documents": documents.join(gone.select("document_id"), "document_id", "left_anti")}
    facts = children["facts"].join(gone.select("document_id"), "document_id", "left_anti")
    lost = children["facts"].join(gone.select("document_id"), "document_id", "left_semi").select("fact_id").distinct()
    left["facts"] = facts
    for name in ("evidence", "fact_embeddings"):
        if name in children:
            left[name] = children[name].join(lost, "fact_id", "left_anti")
    if "fact_relationships" in children:
        left["fact_relationships"] = (children["fact_relationships"].join(lost.withColumnRenamed("fact_id", "left_fact_id"), "left_fact_id", "left_anti")
                                      .join(lost.withColumnRenamed("fact_id", "right_fact_id"), "right_fact_id", "left_anti"))
    if "entity_aliases" in children:
        a = children["entity_aliases"]
        hit = gone.select("document_id").distinct().withColumn("__gone", F.lit(True))
        left["entity_aliases"] = a.join(hit, "document_id", "left").withColumn("document_id", F.when(F.col("__gone").isNull(), F.col("document_id"))).drop("__gone").select(*a.columns)
    return left


def insert_counts(facts: DataFrame, evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """(document_id, facts_received, facts_inserted, evidence_inserted) of a delivery against the stored fact ids.

    Evidence goes in with its fact or not at all.
    """
    judged = facts.join(stored.select("fact_id").distinct().withColumn("known", F.lit(True)), "fact_id", "left").select("fact_id", "document_id", F.col("known").isNull().alias("new"))
    n = evidence.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"))
    return judged.join(n, "fact_id", "left").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("facts_received"), F.count_if("new").alias("facts_inserted"), F.coalesce(F.sum(F.when(F.col("new"), F.coalesce("n", F.lit(0)))), F.lit(0)).alias("evidence_inserted"))
