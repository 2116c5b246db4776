"""From texts to judged relationships in one run: the stages in their order, their tables, and what each document came to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.functions.values import currency
from factloom.operators import candidates as cd, chunks as ck, entities as en, evidence as ev, grounded as gr, relationships as rl
from factloom.operators.providers import (EmbeddingProvider, FactExtractionProvider, HashedEmbedding, OfflineReasoner, RelationshipReasoningProvider, TemplateExtraction,
                                          by_confidence, embed_texts, extract_facts, reason_pairs, validate_drafts)
from factloom.plans.read_api import pages
from factloom.session import Scratch
from factloom.tables import table


@dataclass(frozen=True)
class PipelineConfig:
    """What a run can be given in place of the defaults: providers, thresholds and sizes."""

    extraction: FactExtractionProvider = field(default_factory=TemplateExtraction)
    embedding: EmbeddingProvider = field(default_factory=lambda: HashedEmbedding(256))
    reasoning: RelationshipReasoningProvider = field(default_factory=OfflineReasoner)
    least_confidence: float = 0.65
    evidence_threshold: float = 0.92
    chunk_target: int = 1200
    chunk_overlap: int = 150
    concurrency: int | None = None  # calls of a provider at once


def value_type(value: Column) -> Column:
    """The type of a value nobody has typed: by its currency or percent sign."""
    return F.when(currency(value).isNotNull(), "MONEY").when(value.rlike("%|per ?cent"), "PERCENTAGE").otherwise("QUANTITY")


def process_documents(documents: DataFrame, entities: DataFrame, aliases: DataFrame, config: PipelineConfig = PipelineConfig()) -> dict[str, DataFrame]:
    """chunks, rejected, facts, resolved, vectors, relationships, issues and documents (counters and final status).

    documents: document_id, text, ingested_at. Texts without a paragraph give no chunk: their document fails. Statements
    repeated within a document (chunks overlap) are one fact, its id is their signature. Drafts whose quotation does
    not stand in the text are rejected. Every table the later stages read more than once is written once.
    """
    scratch = Scratch(documents.sparkSession, "pipeline")
    spread = lambda rows: rows.repartition(config.concurrency) if config.concurrency else rows
    chunks = scratch.keep(ck.chunks(pages(documents), config.chunk_target, config.chunk_overlap))
    drafted = scratch.keep(extract_facts(spread(chunks), config.extraction).distinct())
    valid, invalid = validate_drafts(drafted.where("error is null"))
    sure, low = by_confidence(valid, config.least_confidence)
    sure = sure.withColumn("claim_id", F.sha2(F.concat_ws("\x01", "document_id", "subject", "predicate", "value", F.coalesce("time", F.lit("")), "quote"), 256))
    texts = documents.select(F.col("document_id").alias("page_key"), "text")
    found = scratch.keep(ev.verify_claims(sure.select("claim_id", F.col("document_id").alias("page_key"), "quote"), texts, config.evidence_threshold)
                         .select("claim_id", "method", "score", "start_char", "end_char", "matched_text"))
    met = sure.join(found, "claim_id")
    place = F.struct(F.col("start_char"), F.col("end_char"), F.col("matched_text").alias("quote"))
    context = F.struct(F.col("time").alias("time_label"))
    grounded = met.where("start_char is not null").withColumns({"value_type": value_type(F.col("value")), "context": context, "evidence": F.array(place)})
    normal = gr.normalize_facts(grounded)
    first = normal.groupBy(F.col("fact_signature").alias("fact_id")).agg(F.min_by(F.struct(*[c for c in normal.columns if c != "fact_signature"]), "claim_id").alias("x")).select("fact_id", "x.*")
    none = F.lit(None).cast("string")
    label = F.struct(F.col("normalized_context.time.label").alias("time_label"), none.alias("geography"), none.alias("scope"), none.alias("basis"))
    times = documents.select("document_id", F.col("ingested_at").cast("timestamp").alias("created_at"))
    facts = scratch.keep(first.join(times, "document_id").select(
        "fact_id", "document_id", F.col("subject").alias("subject_raw"), F.lit("ORGANIZATION").alias("subject_type"), "subject_normalized", F.col("predicate").alias("predicate_raw"), "predicate_canonical",
        F.col("value").alias("value_raw"), "value_type", F.col("normalized_value.number").alias("normalized_number"), F.col("normalized_value.unit").alias("unit"), F.col("normalized_value.currency").alias("currency"),
        none.alias("qualifiers"), label.alias("normalized_context"), "confidence", "created_at", F.col("method").alias("verification_method"), "score"))
    resolved = scratch.keep(en.resolve(facts.withColumn("entity_id", none), entities, aliases))
    linked = scratch.keep(facts.join(resolved.select("fact_id", "entity_id"), "fact_id", "left"))
    compared = gr.comparison_texts(linked, entities)
    vectors = scratch.keep(embed_texts(spread(compared.where("error is null").select("fact_id", "comparison_text")), config.embedding).withColumn("created_at", F.lit(0).cast("timestamp")))
    near = cd.retrieve(linked, vectors.where("error is null"), config.embedding.dimensions)
    pairs = near.select(F.least("source_id", "candidate_id").alias("left_fact_id"), F.greatest("source_id", "candidate_id").alias("right_fact_id")).distinct()
    judged = scratch.keep(rl.decide(rl.paired(pairs, linked)).where("skipped is null"))
    asked = reason_pairs(judged.where("method = 'REASONER'"), config.reasoning, concurrency=config.concurrency)
    ruled = judged.where("method = 'RULE'").select("l_fact_id", "r_fact_id", "outcome", F.col("decided_confidence").alias("confidence"), "decisive", none.alias("model"), none.alias("error"))
    relationships = scratch.keep(ruled.unionByName(asked))

    def issue(name: str, stage: str, severity: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(name).alias("issue_type"), F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), "document_id")

    of = facts.select(F.col("fact_id").alias("l_fact_id"), "document_id")
    rejected = met.where("start_char is null").select("document_id", "subject", "predicate", "value", "quote", "method", "score")
    unsure = relationships.join(of, "l_fact_id")
    kinds = [issue("EMPTY_PAGE", "PARSING", "WARNING", documents.join(chunks.select("document_id"), "document_id", "left_anti")),
             issue("LOW_FACT_CONFIDENCE", "EXTRACTING", "INFO", low), issue("LLM_REQUEST_FAILURE", "EXTRACTING", "ERROR", drafted.where("error is not null")),
             issue("EVIDENCE_NOT_FOUND", "EVIDENCE", "WARNING", rejected), issue("NORMALIZATION_FAILURE", "NORMALIZING", "WARNING", invalid),
             issue("AMBIGUOUS_ENTITY", "ENTITY_RESOLUTION", "WARNING", facts.join(resolved, "fact_id", "left_anti")),
             issue("EMBEDDING_FAILURE", "EMBEDDING", "ERROR", vectors.where("error is not null").join(facts.select("fact_id", "document_id"), "fact_id")),
             issue("RELATIONSHIP_REASONING_FAILURE", "RELATIONSHIP_REASONING", "ERROR", unsure.where("error is not null")),
             issue("RELATIONSHIP_UNCERTAIN", "RELATIONSHIP_REASONING", "WARNING", unsure.where("confidence < 0.6"))]
    issues = kinds[0]
    for k in kinds[1:]:
        issues = issues.unionByName(k)
    issues = scratch.keep(issues)
    return {"chunks": chunks, "rejected": rejected, "facts": linked, "resolved": resolved, "vectors": vectors, "relationships": relationships, "issues": issues,
            "documents": run_counters(documents, chunks, drafted, linked, resolved, vectors, relationships, issues)}


def run_counters(documents: DataFrame, chunks: DataFrame, drafts: DataFrame, facts: DataFrame, resolved: DataFrame, vectors: DataFrame, relationships: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each document with what every stage came to, and its final status.

    FAILED without a chunk, COMPLETED without an issue, else COMPLETED_WITH_ISSUES. A relationship counts for
    both its documents.
    """
    of = facts.select("fact_id", "document_id")
    ends = relationships.select(F.posexplode(F.array("l_fact_id", "r_fact_id")).alias("side", "fact_id"), "outcome")
    matched = F.count_if(F.col("match_method") != "CREATED")
    parts = [
        chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("estimated_tokens").cast("bigint").alias("tokens")),
        drafts.groupBy("document_id").agg(F.count_if(F.col("error").isNull()).alias("drafts"), F.count_if(F.col("error").isNotNull()).alias("failed_chunks")),
        facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("verification_method") == "EXACT").alias("exact"), F.count_if(F.col("verification_method") == "FUZZY").alias("fuzzy")),
        resolved.join(of, "fact_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("resolved"), matched.alias("matched"), F.count_if(F.col("match_method") == "CREATED").alias("created")),
        vectors.join(of, "fact_id").groupBy("document_id").agg(F.count_if(F.col("error").isNull()).alias("embedded")),
        ends.join(of, "fact_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("relationships"), *[F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("CORROBORATES", "CONTRADICTS")]),
        issues.groupBy("document_id").agg(F.count(F.lit(1)).alias("issues")),
    ]
    out, names = documents.select("document_id"), []
    for p in parts:
        out = out.join(p, "document_id", "left")
        names += [c for c in p.columns if c != "document_id"]
    zero = F.lit(0).cast("bigint")
    filled = out.select("document_id", *[F.coalesce(c, zero).alias(c) for c in names])
    return filled.withColumn("status", F.when(F.col("chunks") == 0, "FAILED").when(F.col("issues") == 0, "COMPLETED").otherwise("COMPLETED_WITH_ISSUES"))


def document_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through all stages with the offline providers: its counters and final status."""
    docs = table(spark, sf_dir, "documents").select("document_id", "text", "ingested_at")
    return process_documents(docs, table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_aliases"))["documents"]


QUERIES = {"document_pipeline": document_pipeline}
ORACLE: dict[str, str] = {}
