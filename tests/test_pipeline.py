from __future__ import annotations

from datetime import datetime

from factloom.operators.providers import TemplateExtraction
from factloom.plans.pipeline import PipelineConfig, process_documents


class Inventing(TemplateExtraction):
    """Proposes a statement nobody made, and fails on some texts."""

    def extract(self, text):
        if "unreadable" in text:
            raise ValueError("no answer")
        made = {"subject": "Acme Corp", "predicate": "staff", "value": "9", "time": "FY2024", "quote": "Acme Corp employs nine hundred people in total today", "confidence": 0.9, "start": 0}
        return super().extract(text) + ([made] if "Globex" in text else [])


def test_documents_to_relationships(spark):
    at = datetime(2024, 1, 1)
    rows = [("d1", "Acme Corp had net revenue of USD 5.0 million in FY2024. It rained.", at), ("d2", "Acme Corporation had net revenue of USD 5.01 million in FY2024.\n\nGlobex Ltd had net revenue of USD 7 million in FY2024.", at),
            ("d3", "Acme Corp had net revenue of USD 9 million in FY2024.", at), ("d4", "unreadable", at), ("d5", None, at), ("d6", " \n ", at)]
    d = spark.createDataFrame(rows, "document_id string, text string, ingested_at timestamp")
    e = spark.createDataFrame([("e1", "Acme Corp", "acme", "ORGANIZATION", at)], "entity_id string, canonical_name string, normalized_name string, entity_type string, created_at timestamp")
    a = spark.createDataFrame([], "alias_id string, entity_id string, normalized_alias string, created_at timestamp")
    got = process_documents(d, e, a, PipelineConfig(extraction=Inventing(), concurrency=2))
    facts = {(r["document_id"], r["subject_normalized"]): r for r in got["facts"].collect()}
    assert set(facts) == {("d1", "acme corp"), ("d2", "acme corporation"), ("d2", "globex ltd"), ("d3", "acme corp")}
    assert facts["d1", "acme corp"]["entity_id"] == facts["d2", "acme corporation"]["entity_id"] == "e1" and float(facts["d3", "acme corp"]["normalized_number"]) == 9e6
    by_id = {r["fact_id"]: r["document_id"] for r in facts.values()}
    outcomes = {frozenset((by_id[r["l_fact_id"]], by_id[r["r_fact_id"]])): r["outcome"] for r in got["relationships"].collect()}
    assert outcomes == {frozenset(("d1", "d2")): "CORROBORATES", frozenset(("d1", "d3")): "CONTRADICTS", frozenset(("d2", "d3")): "CONTRADICTS"}
    assert [r["document_id"] for r in got["rejected"].collect()] == ["d2"]
    done = {r["document_id"]: r for r in got["documents"].collect()}
    assert {k: r["status"] for k, r in done.items()} == {"d1": "COMPLETED", "d2": "COMPLETED_WITH_ISSUES", "d3": "COMPLETED", "d4": "COMPLETED_WITH_ISSUES", "d5": "FAILED", "d6": "FAILED"}
    assert (done["d2"]["facts"], done["d2"]["created"], done["d2"]["matched"], done["d2"]["relationships"], done["d4"]["failed_chunks"]) == (2, 1, 1, 2, 1)
    assert process_documents(d.limit(0), e, a)["documents"].count() == 0
