"""Queries of problems 2 to 10, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.components import fact_groups

    return fact_groups(table(spark, sf_dir, "fact_relationships"), table(spark, sf_dir, "facts")).select("fact_id", "group_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.visual_forms import look_alike_pairs

    return look_alike_pairs(table(spark, sf_dir, "evidence"), table(spark, sf_dir, "facts"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.rp_forest import similar_pairs

    return similar_pairs(table(spark, sf_dir, "fact_embeddings"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.name_variants import resolve_names

    found = resolve_names(table(spark, sf_dir, "facts"), table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_aliases"), table(spark, sf_dir, "documents"))
    return found.select("fact_id", "entity_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.canonical_values import map_predicates

    return map_predicates(table(spark, sf_dir, "facts"), table(spark, sf_dir, "predicate_catalog")).select("fact_id", "predicate")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.multiset_dedup import copies

    return copies(table(spark, sf_dir, "facts"))


def p7_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.multiset_dedup import statements

    return statements(table(spark, sf_dir, "facts"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.containers import fill

    return fill(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.contamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.reading_level import reading_levels

    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p8_containers": p8_containers, "p9_found": p9_found, "p10_found": p10_found,
    "p7_found": p7_found, "p7_statements": p7_statements,
}
# White space, letter case and punctuation do not count; of values, what bears on the amount stays. "§" marks a comma that
# groups thousands: a group of three digits ends the number, groups of two or three may stand before it.
_PLAIN = r"regexp_replace(lower({0}), '[\s\p{{Z}}\p{{P}}]+', '', 'g')"
_BLANKLESS = r"regexp_replace(lower({0}), '[\s\p{{Z}}]+', '', 'g')"


def _fold_value(text: str) -> str:
    blankless = _BLANKLESS.format(text)
    s = blankless
    for _ in range(2):
        s = rf"regexp_replace({s}, '(\d),(\d{{3}})(\D|$)', '\1§\2\3', 'g')"
    for _ in range(6):
        s = rf"regexp_replace({s}, '(\d),(\d{{2,3}})§', '\1§\2§', 'g')"
    s = f"replace({s}, '§', '')"
    for _ in range(2):  # neighbours share a digit
        s = rf"regexp_replace(regexp_replace({s}, '(\d)\.(\d)', '\1¦\2', 'g'), '(\d),(\d)', '\1¬\2', 'g')"
    s = rf"regexp_replace(replace(replace({s}, '%', '¤'), '‰', '¢'), '\p{{P}}+', '', 'g')"
    return rf"(regexp_extract({blankless}, '^[(\-−–]') || {s})"


_FOLDED = rf"""f AS (SELECT fact_id, document_id, coalesce({_PLAIN.format('subject_raw')}, '~') AS s, coalesce({_PLAIN.format('predicate_raw')}, '~') AS p, coalesce({_fold_value('value_raw')}, '~') AS v,
CASE WHEN qualifiers IS NULL THEN '~' WHEN NOT json_valid(qualifiers) THEN {_fold_value('qualifiers')} ELSE (SELECT coalesce(string_agg(k || '=' || coalesce({_fold_value('w')}, '~'), '|' ORDER BY k), '')
 FROM (SELECT {_PLAIN.format('key')} AS k, json_extract_string(qualifiers, '$."' || key || '"') AS w FROM (SELECT unnest(json_keys(qualifiers)) AS key))) END AS q
FROM facts WHERE document_id IS NOT NULL AND fact_id IS NOT NULL)"""

ORACLE: dict[str, str] = {
    "p2_found": r"""WITH RECURSIVE e AS (SELECT DISTINCT left_fact_id AS a, right_fact_id AS b FROM fact_relationships WHERE upper(regexp_replace(relationship_type, '^\s+|\s+$', '', 'g')) = 'CORROBORATES'
 AND left_fact_id <> right_fact_id AND left_fact_id IN (SELECT fact_id FROM facts) AND right_fact_id IN (SELECT fact_id FROM facts)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS v, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v)
SELECT v AS fact_id, min(m) AS group_id FROM r GROUP BY 1""",
    "p7_found": f"""WITH {_FOLDED}, g AS (SELECT fact_id, min(fact_id) OVER (PARTITION BY document_id, s, p, v, q) AS first_fact_id FROM f)
SELECT DISTINCT first_fact_id, fact_id AS copy_fact_id FROM g WHERE fact_id <> first_fact_id""",
}
