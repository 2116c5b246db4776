"""Comparable facts of other documents: by entity and predicate, by entity and vector, by subject and vector.

Each branch of the condition is a join of its own on the columns that have to be equal: entity and
predicate, entity and value type, similar subject and value type. Where a key holds many facts they are
compared in pairs of blocks by matrix products: a group never holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.functions.vectors import valid_vector
from factloom.operators.entities import similarities
from factloom.operators.skew import hot_join

THRESHOLD, TOP_K = 0.62, 10
SUBJECT_THRESHOLD, VECTOR_BONUS = 0.85, 0.1
BLOCK = 2048

OUT = "source_id string, candidate_id string, similarity double, direct boolean, created bigint"


def latest_vectors(embeddings: DataFrame, dims: int) -> DataFrame:
    good = embeddings.where(valid_vector(F.col("embedding"), dims) & ((F.array_max("embedding") != 0) | (F.array_min("embedding") != 0)))
    return good.groupBy("fact_id").agg(F.max_by("embedding", F.struct("created_at", "model")).alias("embedding"))


ASKS, GIVES, BOTH = 0, 1, 2


class _Rows:
    """Columns of a group as arrays."""

    def __init__(self, t: pa.Table):
        n = t.num_rows
        x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        self.x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.ids = t.column("fact_id").to_numpy()
        self.documents = np.unique(t.column("document_id").to_numpy().astype(str), return_inverse=True)[1]
        self.made = t.column("created").to_numpy()
        self.key, self.side, self.role = (t.column(c).to_numpy() for c in ("k", "side", "role"))

    def best(self, asks: np.ndarray, gives: np.ndarray, least: float, top_k: int, direct: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asking, given, similarity): for each asking fact the top_k facts of other documents: nearer first, then older, then by id."""
        asks, gives = asks[self.role[asks] != GIVES], gives[self.role[gives] != ASKS]
        sims = self.x[asks] @ self.x[gives].T
        ok = self.documents[asks][:, None] != self.documents[gives][None, :]
        if not direct:
            ok &= 1 - sims <= 1 - least
        r, c = np.nonzero(ok)
        order = np.lexsort((self.ids[gives[c]], self.made[gives[c]], -sims[r, c], r)) if len(r) else r
        r, c = r[order], c[order]
        keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(asks)))[r] < top_k
        r, c = r[keep], c[keep]
        return asks[r], gives[c], sims[r, c]


def _cell(least: float, top_k: int, direct: bool):
    """Of each key, facts of one block with each other, or of two blocks (side 0 and 1) with those of the other."""

    def run(t: pa.Table) -> pa.Table:
        rows = _Rows(t)
        order = np.lexsort((rows.side, rows.key))
        ends = np.append(np.nonzero(np.diff(rows.key[order]))[0] + 1, len(order))
        found, start = [], 0
        for end in ends:
            mine = order[start:end]
            start = end
            second = int(np.searchsorted(rows.side[mine], 1))
            a, b = mine[:second], mine[second:]
            found += [rows.best(x, y, least, top_k, direct) for x, y in ([(a, b), (b, a)] if len(b) else [(a, a)])]
        r, c, s = (np.concatenate(z) for z in zip(*found))
        return pa.table({"source_id": pa.array(rows.ids[r], pa.string()), "candidate_id": pa.array(rows.ids[c], pa.string()), "similarity": s,
                         "direct": np.full(len(r), direct), "created": rows.made[c]})

    return run


def _within(rows: DataFrame, keys: list[str], total: int, least: float, top_k: int, direct: bool) -> DataFrame:
    """All facts of a key against all facts of the key; each fact is sent once for each block of its key.

    A group is one block or two; keys of a single block share groups of about as many facts.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("document_id").alias("d1"), F.max("document_id").alias("d2")).where("d1 <> d2")
    sizes = sizes.select(*keys, "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = hot_join(rows, sizes, keys, "size", total).withColumn("own", F.pmod(F.xxhash64("fact_id"), F.col("blocks")).cast("int")).withColumn("k", F.xxhash64(*keys))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = F.when(F.col("blocks") > 1, F.col("k")).otherwise(F.pmod("k", F.lit(max(1, total // BLOCK))))
    cells = sent.select((F.col("blocks") > 1).alias("many"), shared.alias("group"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                        (F.col("own") > F.col("other")).cast("int").alias("side"), "role", "k", "fact_id", "document_id", "created", "embedding")
    return cells.groupBy("many", "group", "low", "high").applyInArrow(_cell(least, top_k, direct), OUT)


def retrieve(facts: DataFrame, embeddings: DataFrame, dims: int, threshold: float = THRESHOLD, top_k: int = TOP_K) -> DataFrame:
    """(source_id, candidate_id, similarity, match_reason, rank): the top_k comparable facts for each fact.

    Direct predicate matches come first, then the nearer vector, the older fact, the smaller id.
    Facts without a usable vector take no part.
    """
    base = facts.select("fact_id", "document_id", "entity_id", F.col("subject_normalized").alias("subject"), "predicate_canonical", "value_type", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"))
    rows = base.withColumnRenamed("predicate_canonical", "predicate").join(latest_vectors(embeddings, dims), "fact_id")
    total = facts.count()
    known = rows.where("entity_id is not null").withColumn("role", F.lit(BOTH))
    # Two unknown predicates are not the same predicate.
    resolved = _within(known.where("predicate is not null"), ["entity_id", "predicate"], total, threshold, top_k, True).unionByName(
        _within(known.where("value_type is not null"), ["entity_id", "value_type"], total, threshold, top_k, False))
    # Unresolved facts ask all facts with a similar subject: similar subjects are found through their distinct spellings.
    loose = rows.where("entity_id is null and subject is not null")
    spelled = loose.select(F.col("subject").alias("name"), F.lit("").alias("type")).distinct()
    subjects = rows.where("subject is not null").select(F.col("subject").alias("key"), F.col("subject").alias("other"), F.lit("").alias("type")).distinct()
    pairs = similarities(spelled, subjects, SUBJECT_THRESHOLD).select("name", F.col("key").alias("subject"))
    fields = ["name", "value_type", "fact_id", "document_id", "created", "embedding", "role"]
    gives = rows.join(pairs, "subject").withColumn("role", F.lit(GIVES)).select(*fields)
    asks = loose.withColumn("name", F.col("subject")).withColumn("role", F.lit(ASKS)).select(*fields)
    every = asks.unionByName(gives).where("value_type is not null")
    unresolved = _within(every, ["name", "value_type"], total, min(1.0, threshold + VECTOR_BONUS), top_k, False)
    either = resolved.withColumn("by_subject", F.lit(False)).unionByName(unresolved.withColumn("by_subject", F.lit(True)))
    met = either.groupBy("source_id", "candidate_id").agg(F.max("direct").alias("direct"), F.max("similarity").alias("similarity"), F.min("created").alias("created"), F.bool_and("by_subject").alias("by_subject"))
    order = Window.partitionBy("source_id").orderBy(F.desc("direct"), F.desc("similarity"), "created", "candidate_id")
    reason = F.when(F.col("by_subject"), "UNRESOLVED_SUBJECT_VECTOR").when(F.col("direct"), "ENTITY_PREDICATE").otherwise("ENTITY_VECTOR")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(
        "source_id", "candidate_id", F.round("similarity", 6).alias("similarity"), reason.alias("match_reason"), "rank")
