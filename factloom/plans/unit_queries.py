"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.units import infer_units, unify_units
from factloom.session import Scratch
from factloom.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts whose number and unit are stated, in the common unit of their kind.

    Facts whose unit nobody states are no cases of this query; the mixtures give theirs in p1_inferred.
    """
    amounts = unify_units(table(spark, sf_dir, "facts"), table(spark, sf_dir, "unit_factors"))
    return amounts.where("status = 'stated'").select("fact_id", "common_unit", "common_amount")


def grouped_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with the catalog's predicate of their fact, null where it has none: a bounded number of groups. Parsed once."""
    facts = table(spark, sf_dir, "facts")
    amounts = unify_units(facts, table(spark, sf_dir, "unit_factors"))
    catalog = F.broadcast(table(spark, sf_dir, "predicate_catalog").select(F.col("predicate").alias("predicate_canonical")).limit(1000))
    known = facts.select("fact_id", "predicate_canonical").join(catalog, "predicate_canonical", "left_semi")
    return Scratch(spark, "p1").keep(amounts.join(known, "fact_id", "left"))


def p1_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts whose unit nobody states: unit by posterior, uncertainty flagged."""
    return infer_units(grouped_amounts(spark, sf_dir), table(spark, sf_dir, "unit_factors"), group="predicate_canonical")


QUERIES = {"p1_found": p1_found, "p1_inferred": p1_inferred}
ORACLE: dict[str, str] = {}
