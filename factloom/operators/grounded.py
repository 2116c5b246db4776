"""Facts in their normal form: context, qualifiers, evidence in order, and the signature of a statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.dates import exact_date, period
from factloom.functions.text import comparable, context_label, nfkc, predicate_name, trim_wide
from factloom.functions.values import normalize_value
from factloom.sources.ingest import latest_delivery

LABELS = ["geography", "scope", "segment", "basis"]


def normalize_context(context: Column, fields: list[str]) -> Column:
    """STRUCT<time, geography, scope, segment, basis, status_as_of> of a struct that may lack fields."""
    none = F.lit(None).cast("string")
    of = lambda name: context[name] if name in fields else none
    as_of = of("status_as_of")
    status = F.coalesce(F.date_format(exact_date(as_of), "yyyy-MM-dd"), context_label(as_of))
    return F.struct(period(of("time_label")).alias("time"), *[context_label(of(n)).alias(n) for n in LABELS], status.alias("status_as_of"))


def qualifier_maps(rows: DataFrame, column: str = "qualifiers", key: str = "fact_id") -> DataFrame:
    """(key, qualifiers): a MAP for each row's array of STRUCT<name, value>.

    Names come in compatibility form and trimmed; of entries with one name the last counts. Rows with no
    named entry have no row.
    """
    each = rows.select(key, F.posexplode(column).alias("i", "q")).where("q.name is not null").select(key, "i", trim_wide(nfkc(F.col("q.name"))).alias("name"), F.col("q.value").alias("value"))
    last = each.groupBy(key, "name").agg(F.max_by("value", "i").alias("value"))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("qualifiers"))


def ordered_evidence(evidence: DataFrame) -> DataFrame:
    """(fact_id, evidence): the last delivery of each evidence row, as a list in order of place and text."""
    last = latest_delivery(evidence, "evidence_id", ["ingested_at", "fact_id"])
    place = F.struct("page_number", "start_char", "end_char", "quote")
    return last.groupBy("fact_id").agg(F.sort_array(F.collect_list(place)).alias("evidence"))


def signature(document: Column, subject: Column, predicate: Column, value: Column, context: Column, evidence: Column) -> Column:
    """SHA-256 of the JSON of all that makes a statement, keys in order of the alphabet, nulls kept.

    Two statements with the same signature agree in document, subject, predicate, value, context and
    the places and texts of their evidence.
    """
    body = F.struct(context.alias("context"), document.alias("documentId"), F.coalesce(evidence, F.array()).alias("evidence"),
                    predicate.alias("predicate"), subject.alias("subject"), value.alias("value"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def stored_signatures(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(fact_id, document_id, signature) of stored facts with the evidence stored for them."""
    c, none = F.col("normalized_context"), F.lit(None).cast("string")
    number = F.col("normalized_number").cast("string")
    text = F.when(number.isNull(), normalize_value(F.col("value_raw"), F.col("value_type"))["text"])
    value = F.struct(F.col("currency").alias("currency"), number.alias("number"), text.alias("text"), F.col("unit").alias("unit"))
    context = F.struct(c["basis"].alias("basis"), c["geography"].alias("geography"), c["scope"].alias("scope"), c["time_label"].alias("time"))
    places = F.transform("evidence", lambda e: F.struct(e["end_char"].alias("endChar"), e["page_number"].alias("pageNumber"), e["quote"].alias("quote"), e["start_char"].alias("startChar")))
    empty = F.array().cast("array<struct<endChar:int,pageNumber:int,quote:string,startChar:int>>")
    known = facts.join(ordered_evidence(evidence), "fact_id", "left")
    return known.select("fact_id", "document_id", signature(F.col("document_id"), F.col("subject_normalized"), F.col("predicate_canonical"), value, context, F.coalesce(places, empty)).alias("signature"))


def normalize_facts(drafts: DataFrame) -> DataFrame:
    """Grounded drafts (document_id, subject, predicate, value, value_type, context struct, evidence list) in normal form.

    Adds subject_normalized, predicate_canonical, normalized_value, normalized_context and
    fact_signature. Drafts without a subject, predicate or value keep nulls there.
    """
    fields = drafts.schema["context"].dataType.fieldNames()
    subject, predicate = comparable(F.col("subject")), predicate_name(F.col("predicate"))
    value, context = normalize_value(F.col("value"), F.col("value_type")), normalize_context(F.col("context"), fields)
    return drafts.withColumns({"subject_normalized": subject, "predicate_canonical": predicate, "normalized_value": value, "normalized_context": context}).withColumn(
        "fact_signature", signature(F.col("document_id"), F.col("subject_normalized"), F.col("predicate_canonical"), F.col("normalized_value"), F.col("normalized_context"), F.sort_array("evidence")))


def evidence_lists(evidence: DataFrame) -> DataFrame:
    """(fact_id, n_evidence, evidence): the evidence of each fact by page, time and id, nested for a detail view."""
    last = latest_delivery(evidence, "evidence_id", ["ingested_at", "fact_id"])
    entry = F.struct("page_number", "created_at", "evidence_id", "quote", "verification_method", "verification_score")
    return last.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.sort_array(F.collect_list(entry)).alias("evidence"))


def linked_evidence(details: DataFrame, evidence_ids: DataFrame) -> DataFrame:
    """(evidence_id, fact_id, page_number): the entries of nested lists that links point to."""
    each = details.select("fact_id", F.explode("evidence").alias("e")).select("fact_id", "e.evidence_id", "e.page_number")
    return each.join(evidence_ids.select("evidence_id").distinct(), "evidence_id", "left_semi").select("evidence_id", "fact_id", "page_number")


#: Fixed value: the line every comparison text begins with.
TASK = "Task: identify facts that describe the same entity property for cross-document comparison."


def comparison_text(entity: Column, predicate: Column, value_type: Column, period_label: Column, scope: Column) -> Column:
    """Six lines without the value itself; null where entity or predicate is missing."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    or_none = lambda c: F.coalesce(filled(c), F.lit("unspecified"))
    lines = {"Entity": filled(entity), "Predicate": filled(predicate), "Value type": value_type, "Period": or_none(period_label), "Scope": or_none(scope)}
    text = F.concat_ws("\n", F.lit(TASK), *[F.concat(F.lit(f"{name}: "), c) for name, c in lines.items()])
    return F.when(lines["Entity"].isNotNull() & lines["Predicate"].isNotNull(), text)


def comparison_texts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(fact_id, comparison_text, error): facts that cannot be compared come with an error in place of the text."""
    c = F.col("normalized_context")
    named = facts.join(entities.select("entity_id", "canonical_name"), "entity_id", "left")
    entity = F.coalesce(F.nullif(F.trim("canonical_name"), F.lit("")), F.col("subject_normalized"))
    made = named.select("fact_id", comparison_text(entity, F.col("predicate_canonical"), F.col("value_type"), c["time_label"], c["scope"]).alias("comparison_text"))
    return made.withColumn("error", F.when(F.col("comparison_text").isNull(), "EMBEDDING_FAILURE: entity and predicate are needed"))
