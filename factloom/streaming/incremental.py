"""Incremental processing: files or tables as queues, idempotent micro-batches, new rows against stored ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.skew import hot_join
from factloom.session import Scratch, exists


def drain(spark: SparkSession, path: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str, file_format: str = "parquet", max_files: int = 1) -> int:
    """Runs every file that has arrived through ``handle`` and returns the number of micro-batches.

    The checkpoint holds the offsets: a restart resumes after the last finished batch, a batch
    that was cut short runs again, so ``handle`` has to replace what it wrote for the same batch.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(file_format).load(path)
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(q.recentProgress)


def batch_writer(target: str) -> Callable[[DataFrame, int], None]:
    """Each batch owns a folder, which a repeated run overwrites: exactly-once in effect."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def class_parts(new: DataFrame, keys: list[str]) -> DataFrame:
    """What a batch adds to the classes of equal keys: for each key and document the number of facts and the least id."""
    return new.groupBy(*keys, "document_id").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first"))


def classes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document_id, n, class_id, n_links): keys found in two documents or more; n facts of the document link with n_links others."""
    merged = parts.groupBy(*keys, "document_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    whole = merged.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("documents"), F.min("first").alias("class_id")).where("documents > 1")
    return merged.join(whole, keys).select(*keys, "document_id", "n", "class_id", (F.col("total") - F.col("n")).alias("n_links"))


def link_writer(spark: SparkSession, target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Stores the facts of a batch and what it adds to the classes, each in the batch's own folder.

    Nothing written depends on other batches, and a batch that runs again replaces what it wrote: whatever
    was cut short, the merged classes are those of every fact once.
    """
    facts, parts = batch_writer(f"{target}/facts"), batch_writer(f"{target}/parts")

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.select("fact_id", "document_id", *keys)
        facts(rows, batch_id)
        parts(class_parts(rows, keys), batch_id)

    return write


def linked_facts(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """(fact_id, class_id, n_links) of all facts so far that share their keys with facts of other documents.

    One row for each fact in place of all pairs: class_id is the smallest fact of the class, n_links the
    number of its facts in other documents.
    """
    if not exists(spark, f"{target}/facts"):
        return spark.createDataFrame([], "fact_id string, class_id string, n_links bigint")
    facts, parts = spark.read.parquet(f"{target}/facts"), spark.read.parquet(f"{target}/parts")
    return hot_join(facts, classes(parts, keys), [*keys, "document_id"], "n", facts.count()).select("fact_id", "class_id", "n_links")


def run_incremental_links(spark: SparkSession, facts: DataFrame, batches: int, keys: list[str]) -> DataFrame:
    """Facts arrive as files of a queue, about ``batches`` micro-batches of them; each adds to the classes of all before."""
    scratch = Scratch(spark, "stream")
    source, target = f"{scratch.base}/in", f"{scratch.base}/links"
    rows = facts.select("fact_id", "document_id", *keys)
    arrival = F.pmod(F.xxhash64("document_id"), F.lit(batches)).cast("int")
    rows.withColumn("arrival", arrival).write.partitionBy("arrival").parquet(source)
    files = len(spark.read.schema(rows.schema).parquet(source).inputFiles())
    drain(spark, source, rows.schema, link_writer(spark, target, keys), f"{scratch.base}/offsets", max_files=max(1, -(-files // batches)))
    return linked_facts(spark, target, keys)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Events and their values by type in tumbling windows; on a stream rows later than ``late`` are dropped by the watermark."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total")


def stream_windows(spark: SparkSession, events: DataFrame, length: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """The windows of events that arrive as files in order of time, written as the watermark closes them.

    A last empty-handed batch cannot close the windows behind the watermark, so the queue ends with
    one marker event a window and the delay after the last; its own window stays open and unwritten.
    """
    scratch = Scratch(spark, "windows")
    source, target = f"{scratch.base}/in", f"{scratch.base}/out"
    rows = events.select(time, "event_type", "value")
    end = F.col("t") + F.expr(f"INTERVAL {length}") * 2 + F.expr(f"INTERVAL {late}")
    rows.repartitionByRange(4, time).sortWithinPartitions(time).write.parquet(source)
    marker = rows.agg(F.max(time).alias("t")).where("t is not null").select(end.alias(time), F.lit("end of queue").alias("event_type"), F.lit(0).cast(rows.schema["value"].dataType).alias("value"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    counted = windowed_counts(stream, length, late, time)

    def start():
        return counted.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", f"{scratch.base}/offsets").trigger(availableNow=True).start()

    start().awaitTermination()
    marker.write.mode("append").parquet(source)  # arrives last
    start().awaitTermination()
    shape = "start timestamp, event_type string, n bigint, total double"
    return spark.read.schema(shape).parquet(target).where("event_type <> 'end of queue'") if exists(spark, target) else spark.createDataFrame([], shape)
