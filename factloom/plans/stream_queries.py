"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.streaming.incremental import run_incremental_links, stream_windows
from factloom.tables import table


def incremental_link_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with one entity, canonical predicate, value and period in different documents, linked batch by batch."""
    facts = table(spark, sf_dir, "facts").where("entity_id is not null and predicate_canonical is not null and normalized_number is not null").select(
        "fact_id", "document_id", "entity_id", "predicate_canonical", "value_raw", F.coalesce("normalized_context.time_label", F.lit("")).alias("period"))
    return run_incremental_links(spark, facts, 3, ["entity_id", "predicate_canonical", "value_raw", "period"])


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted by a stream with a watermark over files in order of time; every window is closed and written once."""
    out = stream_windows(spark, table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


QUERIES = {"incremental_link_stream": incremental_link_stream, "events_by_hour": events_by_hour}
ORACLE = {
    "incremental_link_stream": """WITH f AS (SELECT fact_id, document_id, entity_id, predicate_canonical, value_raw, coalesce(normalized_context.time_label, '') AS period FROM facts
WHERE entity_id IS NOT NULL AND predicate_canonical IS NOT NULL AND normalized_number IS NOT NULL),
k AS (SELECT entity_id, predicate_canonical, value_raw, period, count(*) AS total, count(DISTINCT document_id) AS documents, min(fact_id) AS class_id FROM f GROUP BY ALL),
p AS (SELECT entity_id, predicate_canonical, value_raw, period, document_id, count(*) AS n FROM f GROUP BY ALL)
SELECT fact_id, class_id, total - n AS n_links FROM f JOIN k USING (entity_id, predicate_canonical, value_raw, period) JOIN p USING (entity_id, predicate_canonical, value_raw, period, document_id) WHERE documents > 1""",
    "events_by_hour": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
}
