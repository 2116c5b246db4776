"""Pairs of facts: canonical order, compatibility, rule corroboration, the offline decision ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.dates import period as period_of
from factloom.functions.text import predicates_compatible
from factloom.functions.values import TOLERANCE, normalize_value, relative_difference

GATE = 0.60


def canonical_pairs(relationships: DataFrame) -> DataFrame:
    """Each unordered pair once: left id before right id, the latest delivery of its row."""
    ends = relationships.where("left_fact_id is not null and right_fact_id is not null and left_fact_id <> right_fact_id")
    ordered = ends.select(F.least("left_fact_id", "right_fact_id").alias("left_fact_id"), F.greatest("left_fact_id", "right_fact_id").alias("right_fact_id"),
                          F.upper(F.trim(F.regexp_replace("relationship_type", r"\s", ""))).alias("relationship_type"), "confidence", "created_at", "ingested_at", "relationship_id")
    key = F.struct("ingested_at", "created_at", "relationship_id")
    return ordered.groupBy("left_fact_id", "right_fact_id").agg(
        F.max_by("relationship_type", key).alias("relationship_type"), F.max_by("confidence", key).alias("confidence"), F.max("relationship_id").alias("relationship_id"))


def fact_view(facts: DataFrame, side: str) -> DataFrame:
    """What the rules read of a fact, with every column prefixed by its side."""
    context = F.col("normalized_context")
    period = F.coalesce(context["time_label"], F.get_json_object("qualifiers", "$.reportingPeriod"), F.get_json_object("qualifiers", "$.reporting_period"),
                        F.get_json_object("qualifiers", "$.period"))
    columns = {"fact_id": F.col("fact_id"), "document_id": F.col("document_id"), "entity_id": F.col("entity_id"), "subject": F.col("subject_normalized"),
               "predicate": F.col("predicate_canonical"), "value_type": F.col("value_type"), "number": F.col("normalized_number").cast("double"), "unit": F.col("unit"),
               "text": normalize_value(F.col("value_raw"), F.col("value_type"))["text"],
               "currency": F.col("currency"), "kind": period_of(context["time_label"])["kind"], "period": period, "scope": context["scope"], "geography": context["geography"], "basis": context["basis"]}
    return facts.select(*[c.alias(f"{side}_{n}") for n, c in columns.items()])


def compatible(a: str = "l", b: str = "r") -> Column:
    x, y = (lambda n: F.col(f"{a}_{n}")), (lambda n: F.col(f"{b}_{n}"))
    same_entity = F.coalesce(x("entity_id") == y("entity_id"), F.lit(False)) | F.coalesce(x("subject") == y("subject"), F.lit(False))
    return same_entity & (x("value_type") == y("value_type")) & F.coalesce(predicates_compatible(x("predicate"), y("predicate")), F.lit(False))


def equal_values(a: str = "l", b: str = "r") -> Column:
    """Numbers within tolerance or equal texts; null where the facts state no values of one sort."""
    x, y = (lambda n: F.col(f"{a}_{n}")), (lambda n: F.col(f"{b}_{n}"))
    return F.when(x("number").isNotNull() & y("number").isNotNull(), relative_difference(x("number"), y("number")) <= TOLERANCE).otherwise(x("text") == y("text"))


def corroborated(a: str = "l", b: str = "r") -> Column:
    """The rule: one entity, type, predicate concept, kind and label of period, and scope; equal values, numbers in one unit and currency."""
    x, y = (lambda n: F.col(f"{a}_{n}")), (lambda n: F.col(f"{b}_{n}"))
    alike = [x(n).eqNullSafe(y(n)) for n in ("kind", "period", "scope")]
    measured = (x("currency").eqNullSafe(y("currency")) & x("unit").eqNullSafe(y("unit"))) | x("number").isNull() | y("number").isNull()
    return compatible(a, b) & alike[0] & alike[1] & alike[2] & measured & F.coalesce(equal_values(a, b), F.lit(False))


def _differ(name: str, a: str, b: str) -> Column:
    x, y = F.col(f"{a}_{name}"), F.col(f"{b}_{name}")
    return F.coalesce(x != y, F.lit(False))


def decide(pairs: DataFrame, a: str = "l", b: str = "r") -> DataFrame:
    """Adds outcome, confidence, decisive and method: the ladder with the offline reasoner at its end.

    Same document and incompatible pairs are skipped; the rule comes before the reasoner; what the
    reasoner says below the confidence gate becomes UNCERTAIN.
    """
    x, y = (lambda n: F.col(f"{a}_{n}")), (lambda n: F.col(f"{b}_{n}"))
    equal = equal_values(a, b)
    missing = equal.isNull()
    context = _differ("scope", a, b) | _differ("geography", a, b) | _differ("basis", a, b)
    skipped = F.when(x("document_id") == y("document_id"), "SAME_DOCUMENT").when(~compatible(a, b), "INCOMPATIBLE")
    rule = corroborated(a, b)
    said = (F.when(_differ("currency", a, b), "UNCERTAIN").when(_differ("period", a, b), "RECONCILABLE").when(context, "RECONCILABLE")
            .when(missing, "UNCERTAIN").when(equal, "CORROBORATES").otherwise("CONTRADICTS"))
    sure = (F.when(_differ("currency", a, b), 0.65).when(_differ("period", a, b), 0.95).when(context, 0.85).when(missing, 0.50).when(equal, 0.80).otherwise(0.95))
    decisive = (F.when(_differ("currency", a, b), "currency").when(_differ("period", a, b), "period").when(_differ("scope", a, b), "scope")
                .when(_differ("geography", a, b), "geography").when(_differ("basis", a, b), "basis").otherwise("value"))
    gated = F.when(sure < GATE, "UNCERTAIN").otherwise(said)
    return (pairs.withColumn("skipped", skipped)
            .withColumn("outcome", F.when(F.col("skipped").isNotNull(), F.lit(None).cast("string")).when(rule, "CORROBORATES").otherwise(gated))
            .withColumn("decided_confidence", F.when(F.col("skipped").isNotNull(), F.lit(None).cast("double")).when(rule, 1.0).otherwise(sure))
            .withColumn("decisive", F.when(F.col("skipped").isNull() & ~rule, decisive))
            .withColumn("method", F.when(F.col("skipped").isNull(), F.when(rule, "RULE").otherwise("REASONER"))))


def context_rows(pairs: DataFrame, a: str = "l", b: str = "r") -> DataFrame:
    """One row for each compared dimension: same, explains the difference, or conflicts."""
    def said(side: str, column: str) -> Column:
        if column == "number":  # the value, as far as it is known
            return F.coalesce(F.col(f"{side}_number").cast("decimal(38,6)").cast("string"), F.col(f"{side}_text"))
        return F.col(f"{side}_{column}")

    def entry(name: str, column: str) -> Column:
        x, y = said(a, column), said(b, column)
        effect = F.when(x.eqNullSafe(y), "SAME").when(F.lit(name) == "value", "CONFLICTS").otherwise("EXPLAINS_DIFFERENCE")
        return F.struct(F.lit(name).alias("dimension"), x.alias("fact_a"), y.alias("fact_b"), effect.alias("effect"))

    names = {"time": "period", "scope": "scope", "currency": "currency", "value": "number"}
    return pairs.select(f"{a}_fact_id", f"{b}_fact_id", F.explode(F.array(*[entry(n, c) for n, c in names.items()])).alias("x")).select(f"{a}_fact_id", f"{b}_fact_id", "x.*")


def paired(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    left, right = fact_view(facts, "l"), fact_view(facts, "r")
    return pairs.join(left, pairs["left_fact_id"] == left["l_fact_id"]).join(right, F.col("right_fact_id") == right["r_fact_id"])
