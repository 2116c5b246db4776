"""Named SQL functions for queries written as text: name similarity, vector distance, vector size."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "word_trigrams(t STRING) RETURNS ARRAY<STRING>": r"""array_distinct(flatten(transform(filter(split(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' '), ' '), w -> w <> ''),
w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))""",
    "similarity(a STRING, b STRING) RETURNS DOUBLE": """coalesce(try_divide(size(array_intersect(word_trigrams(a), word_trigrams(b))), size(array_union(word_trigrams(a), word_trigrams(b)))), 0)""",
    "dot_product(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)",
    "cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "1 - try_divide(dot_product(a, b), sqrt(dot_product(a, a)) * sqrt(dot_product(b, b)))",
    "vector_dims(a ARRAY<FLOAT>) RETURNS INT": "size(a)",
}


def register_functions(spark: SparkSession) -> None:
    """Temporary functions of the session, made of built-in expressions only: the optimizer sees through them."""
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
