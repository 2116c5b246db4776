from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import display as dp
from factloom.operators.providers import TemplateExtraction, extract_cached, extract_facts, extraction_key, validate_drafts


def test_display(spark):
    r = spark.createDataFrame([("NET_income", 0.876, "FAILED", "waiting", {"a": "1", "b": " ", "c": None})], "a string, c double, s string, j string, m map<string,string>").select(
        dp.humanize(F.col("a")), dp.confidence(F.col("c")), dp.terminal(F.col("s")), dp.active(F.col("j")), dp.context_entries(F.col("m"))).first()
    assert tuple(r) == ("Net income", "88%", True, True, {"a": "1"})
    box = spark.range(1).select(dp.box_percent(*[F.lit(x) for x in (61.2, 700.0, 122.4, 12.0, 612.0, 792.0)])).first()[0]
    assert (box["left"], box["top"], box["width"], box["height"]) == (10.0, 10.101, 20.0, 1.5152)


class Counting(TemplateExtraction):
    def extract(self, text):
        if text == "boom":
            raise ValueError("no")
        return super().extract(text)


def test_extraction_cache(spark):
    chunks = spark.createDataFrame([("Acme Ltd had net sales of $5 million in FY2025.",), ("Acme Ltd had net sales of $5 million in FY2025.",), ("boom",), ("",)], "text string")
    empty = extract_facts(chunks.limit(0).withColumn("cache_key", F.lit("x")), Counting(), key="cache_key")
    every, fresh = extract_cached(chunks, empty, Counting())
    assert every.where("subject is not null").count() == 1 and every.where("error is not null").count() == 1 and fresh.count() == 1
    stored = spark.createDataFrame(fresh.collect(), fresh.schema)
    again, more = extract_cached(chunks.limit(2), stored, Counting())
    assert more.count() == 0 and again.count() == 1
    assert chunks.select(extraction_key("1", "m")).distinct().count() == 3
    good, bad = validate_drafts(every)
    assert good.count() == 1 and bad.count() == 1
