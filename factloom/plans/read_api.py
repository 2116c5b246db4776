"""The read API: filters, pages, details and summaries as DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import blocks, contains_folded
from factloom.functions.vectors import valid_vector

MAX_PAGE = 100
DOCUMENT_COLUMNS = ["document_id", "filename", "status", "page_count", "source", "lang", "n_chars"]


@dataclass
class Page:
    """Rows of one page with the envelope a client needs."""

    rows: DataFrame
    total: int
    page: int
    page_size: int

    @property
    def pages(self) -> int:
        return math.ceil(self.total / self.page_size)

    def envelope(self) -> DataFrame:
        """One row of JSON with data and pagination; a page is at most MAX_PAGE rows."""
        body = self.rows.agg(F.collect_list(F.struct(*self.rows.columns)).alias("data"))
        meta = F.struct(F.lit(self.page).alias("page"), F.lit(self.page_size).alias("page_size"), F.lit(self.total).alias("total"), F.lit(self.pages).alias("total_pages"))
        return body.select(F.to_json(F.struct("data", meta.alias("pagination"))).alias("body"))


class RequestError(ValueError):
    """INVALID_REQUEST."""


# What a request may name.
CHOICES = {
    "value_type": {"TEXT", "NUMBER", "MONEY", "PERCENTAGE", "DATE", "BOOLEAN", "PERSON", "ORGANIZATION", "LOCATION", "QUANTITY", "DURATION", "OTHER"},
    "relationship_type": {"CORROBORATES", "CONTRADICTS", "RECONCILABLE", "UNCERTAIN"},
    "severity": {"INFO", "WARNING", "ERROR"},
}


def check_choice(**given: str | None) -> None:
    """Values of a closed list; ids are texts of 1 to 200 characters without white space."""
    for name, value in given.items():
        if value is None:
            continue
        if name in CHOICES and value not in CHOICES[name]:
            raise RequestError(f"{name} is one of {', '.join(sorted(CHOICES[name]))}")
        if name.endswith("_id") and not (0 < len(value) <= 200 and not any(c.isspace() for c in value)):
            raise RequestError(f"{name} is no id")


def check(page: int = 1, page_size: int = 20, least_confidence: float | None = None, predicate: str | None = None, search: str | None = None, stage: str | None = None) -> None:
    if page < 1 or not 1 <= page_size <= MAX_PAGE:
        raise RequestError(f"page from 1, page_size from 1 to {MAX_PAGE}")
    if least_confidence is not None and not 0 <= least_confidence <= 1:
        raise RequestError("confidence from 0 to 1")
    for value, longest in ((predicate, 200), (search, 500), (stage, 100)):
        if value is not None and not 0 < len(value) <= longest:
            raise RequestError(f"text of 1 to {longest} characters")


def paged(rows: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> Page:
    check(page, page_size)
    return Page(rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size), rows.count(), page, page_size)


def where_facts(facts: DataFrame, document_id: str | None = None, entity_id: str | None = None, predicate: str | None = None,
                value_type: str | None = None, least_confidence: float | None = None, search: str | None = None) -> DataFrame:
    """A filter that is not given filters nothing; texts are found anywhere, whatever their case."""
    check(least_confidence=least_confidence, predicate=predicate, search=search)
    check_choice(document_id=document_id, entity_id=entity_id, value_type=value_type)
    tests = [F.lit(True)]
    if document_id is not None:
        tests.append(F.col("document_id") == document_id)
    if entity_id is not None:
        tests.append(F.col("entity_id") == entity_id)
    if predicate is not None:
        tests.append(contains_folded(F.col("predicate_canonical"), predicate))
    if value_type is not None:
        tests.append(F.col("value_type") == value_type)
    if least_confidence is not None:
        tests.append(F.col("confidence") >= least_confidence)
    if search is not None:
        hit = F.lit(False)
        for c in ("subject_raw", "predicate_raw", "predicate_canonical", "value_raw"):
            hit = hit | F.coalesce(contains_folded(F.col(c), search), F.lit(False))
        tests.append(hit)
    out = facts
    for t in tests[1:]:
        out = out.where(t)
    return out


def where_documents(documents: DataFrame, status: str | None = None, filename: str | None = None) -> DataFrame:
    out = documents
    if status is not None:
        out = out.where(F.col("status") == status)
    if filename is not None:
        out = out.where(contains_folded(F.col("filename"), filename))
    return out


def recent(documents: DataFrame, n: int = 5) -> DataFrame:
    """The documents ingested last."""
    return documents.orderBy(F.desc("ingested_at"), "document_id").limit(n)


def pages(documents: DataFrame, per_page: int = 12) -> DataFrame:
    """(document_id, page_number, text, n_chars): stored texts laid out in pages of so many paragraphs, in order; texts without any have no page."""
    each = documents.where(F.col("text").isNotNull()).select("document_id", F.posexplode(blocks(F.col("text"))).alias("i", "p"))
    made = each.groupBy("document_id", (F.floor(F.col("i") / per_page) + 1).cast("int").alias("page_number")).agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("ps"))
    return made.select("document_id", "page_number", F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n").alias("text")).withColumn("n_chars", F.length("text"))


def fact_details(facts: DataFrame, entities: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with entity name, file name and their evidence, counted and best first by page and time."""
    quotes = evidence.groupBy("fact_id").agg(
        F.countDistinct("evidence_id").alias("n_evidence"), F.min(F.struct("page_number", "created_at", "evidence_id")).alias("head"), F.max("verification_score").alias("best_score"))
    return (facts.join(documents.select("document_id", "filename"), "document_id").join(entities.select("entity_id", "canonical_name"), "entity_id", "left")
            .join(quotes, "fact_id", "left").select("fact_id", "document_id", "filename", "entity_id", "canonical_name", "predicate_canonical", "value_raw", "confidence",
                                                    F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.col("head.evidence_id").alias("first_evidence_id"), "best_score"))


def relationship_counts(pairs: DataFrame) -> DataFrame:
    """For each fact the number of its relationships, in all and by type."""
    ends = pairs.select("relationship_type", F.explode(F.array("left_fact_id", "right_fact_id")).alias("fact_id"))
    kinds = ["CORROBORATES", "CONTRADICTS", "RECONCILABLE", "UNCERTAIN"]
    return ends.groupBy("fact_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("relationship_type") == k).alias(k.lower()) for k in kinds])


def relationship_details(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return facts.select(F.col("fact_id").alias(f"{name}_fact_id"), F.col("document_id").alias(f"{name}_document_id"), F.col("entity_id").alias(f"{name}_entity_id"),
                            F.col("predicate_canonical").alias(f"{name}_predicate"), F.col("value_raw").alias(f"{name}_value"))
    return pairs.join(side("left"), "left_fact_id").join(side("right"), "right_fact_id")


def where_relationships(details: DataFrame, relationship_type: str | None = None, least_confidence: float | None = None,
                        document_id: str | None = None, entity_id: str | None = None) -> DataFrame:
    check(least_confidence=least_confidence)
    check_choice(relationship_type=relationship_type, document_id=document_id, entity_id=entity_id)
    out = details
    if relationship_type is not None:
        out = out.where(F.col("relationship_type") == relationship_type)
    if least_confidence is not None:
        out = out.where(F.col("confidence") >= least_confidence)
    if document_id is not None:
        out = out.where((F.col("left_document_id") == document_id) | (F.col("right_document_id") == document_id))
    if entity_id is not None:
        out = out.where((F.col("left_entity_id") == entity_id) | (F.col("right_entity_id") == entity_id))
    return out


ISSUE_KINDS = {  # type -> stage, severity
    "EMPTY_PAGE": ("PARSING", "WARNING"), "LOW_FACT_CONFIDENCE": ("EXTRACTING", "INFO"), "EVIDENCE_NOT_FOUND": ("EVIDENCE", "WARNING"),
    "NORMALIZATION_FAILURE": ("NORMALIZING", "WARNING"), "AMBIGUOUS_ENTITY": ("ENTITY_RESOLUTION", "WARNING"), "EMBEDDING_FAILURE": ("EMBEDDING", "ERROR"),
}


def issues(documents: DataFrame, facts: DataFrame, evidence: DataFrame, embeddings: DataFrame, dims: int, least_confidence: float = 0.65) -> DataFrame:
    """(issue_id, issue_type, stage, severity, document_id, fact_id) found in the tables."""
    nothing = F.lit(None).cast("string")

    def kind(name: str, rows: DataFrame, ident: Column, document: Column, fact: Column) -> DataFrame:
        stage, severity = ISSUE_KINDS[name]
        return rows.select(F.concat(F.lit(name + ":"), ident.cast("string")).alias("issue_id"), F.lit(name).alias("issue_type"), F.lit(stage).alias("stage"),
                           F.lit(severity).alias("severity"), document.alias("document_id"), fact.alias("fact_id"))

    c = F.col
    blank = F.coalesce(F.length(F.regexp_replace("text", r"[\s\p{Z}]+", "")) == 0, F.lit(True))
    unusable = embeddings.where(~valid_vector(c("embedding"), dims)).select("fact_id").distinct().join(facts.select("fact_id", "document_id"), "fact_id")
    unfound = evidence.where("start_char is null").select("evidence_id", "document_id", "fact_id").distinct()
    parts = [
        kind("EMPTY_PAGE", documents.where(blank), c("doc_id"), c("document_id"), nothing),
        kind("LOW_FACT_CONFIDENCE", facts.where(c("confidence") < least_confidence), c("fact_id"), c("document_id"), c("fact_id")),
        kind("EVIDENCE_NOT_FOUND", unfound, c("evidence_id"), c("document_id"), c("fact_id")),
        kind("NORMALIZATION_FAILURE", facts.where("normalized_number is null"), c("fact_id"), c("document_id"), c("fact_id")),
        kind("AMBIGUOUS_ENTITY", facts.where("entity_id is null"), c("fact_id"), c("document_id"), c("fact_id")),
        kind("EMBEDDING_FAILURE", unusable, c("fact_id"), c("document_id"), c("fact_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def page_issues(pages: DataFrame) -> DataFrame:
    """EMPTY_PAGE for each page without text, and OCR_REQUIRED beside it where the page holds images (document_id, page_number, text, n_images)."""
    blank = F.coalesce(F.length(F.regexp_replace("text", r"[\s\p{Z}]+", "")) == 0, F.lit(True))
    kinds = F.filter(F.array(F.lit("EMPTY_PAGE"), F.when(F.col("n_images") > 0, "OCR_REQUIRED")), lambda k: k.isNotNull())
    return pages.where(blank).select("document_id", "page_number", F.explode(kinds).alias("issue_type"), F.lit("PARSING").alias("stage"), F.lit("WARNING").alias("severity"))


def relationship_issues(decided: DataFrame, gate: float = 0.60) -> DataFrame:
    """RELATIONSHIP_UNCERTAIN for each judgement of the reasoner below the gate."""
    name = "RELATIONSHIP_UNCERTAIN"
    low = decided.where((F.col("method") == "REASONER") & (F.col("decided_confidence") < gate))
    return low.select(F.concat(F.lit(name + ":"), "l_fact_id", F.lit("|"), "r_fact_id").alias("issue_id"), F.lit(name).alias("issue_type"), F.lit("RELATIONSHIP_REASONING").alias("stage"),
                      F.lit("WARNING").alias("severity"), F.col("l_document_id").alias("document_id"), F.col("l_fact_id").alias("fact_id"))


def where_issues(rows: DataFrame, document_id: str | None = None, stage: str | None = None, issue_type: str | None = None, severity: str | None = None) -> DataFrame:
    check(stage=stage)
    check_choice(document_id=document_id, severity=severity)
    out = rows
    if document_id is not None:
        out = out.where(F.col("document_id") == document_id)
    if stage is not None:
        out = out.where(F.lower("stage") == stage.lower())
    if issue_type is not None:
        out = out.where(F.col("issue_type") == issue_type)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    return out


def document_counts(documents: DataFrame, facts: DataFrame, pairs: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """Each document with its numbers of facts, relationships on either side and issues."""
    n_facts = facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_facts"))
    side = facts.select("fact_id", "document_id")
    left = pairs.join(side.withColumnRenamed("fact_id", "left_fact_id"), "left_fact_id").select("relationship_id", "document_id")
    right = pairs.join(side.withColumnRenamed("fact_id", "right_fact_id"), "right_fact_id").select("relationship_id", "document_id")
    n_pairs = left.unionByName(right).distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("n_relationships"))
    n_issues = issue_rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_issues"))
    zero = F.lit(0).cast("bigint")
    return (documents.select("document_id").join(n_facts, "document_id", "left").join(n_pairs, "document_id", "left").join(n_issues, "document_id", "left")
            .select("document_id", *[F.coalesce(c, zero).alias(c) for c in ("n_facts", "n_relationships", "n_issues")]))


def summary(documents: DataFrame, facts: DataFrame, entities: DataFrame, issue_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of totals; every table is counted once, the counts are turned into columns."""
    kinds = ["CORROBORATES", "CONTRADICTS", "RECONCILABLE", "UNCERTAIN"]
    counted = pairs.where(F.col("relationship_type").isin(kinds)).groupBy(F.lower("relationship_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for name, rows in (("documents", documents), ("facts", facts), ("entities", entities), ("issues", issue_rows)):
        counted = counted.unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    names = ["documents", "facts", "entities", "issues", *[k.lower() for k in kinds]]
    totals = counted.groupBy().pivot("name", names).agg(F.sum("n"))
    return totals.select(*[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in names])
