from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, text as tx, values as vs
from factloom.operators.hints import numeric_hints


def apply(spark, values, f, schema="a string"):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in rows.coalesce(1).select(f).collect()]


def test_values(spark):
    cases = [("$1.2M", "MONEY", 1200000, "USD", "USD"), ("USD 1,200,000", "MONEY", 1200000, "USD", "USD"), ("₹10 crore", "MONEY", 100000000, "INR", "INR"), ("15%", "PERCENTAGE", 15, "percent", None),
             ("1.5x", "NUMBER", 1.5, "ratio_x", None), ("(1,234)", "NUMBER", -1234, None, None), ("₹127Cr", "MONEY", 1270000000, "INR", "INR"), ("1,23,456", "NUMBER", 1, None, None)]
    got = apply(spark, [c[:2] for c in cases], vs.normalize_value(F.col("a"), F.col("b")), "a string, b string")
    for case, v in zip(cases, got):
        assert (float(v["number"]), v["unit"], v["currency"]) == case[2:], case


def test_dates_and_periods(spark):
    assert [str(x) if x else None for x in apply(spark, ["31 March 2025", "March 31, 2025", "2025-03-31", "31 February 2025", None], dates.exact_date(F.col("a")))] == ["2025-03-31"] * 3 + [None] * 2
    periods = {"FY25": ("FISCAL_YEAR", "FY2025"), "FY2025": ("FISCAL_YEAR", "FY2025"), "Q1 FY2025": ("QUARTER", "Q1 FY2025"), "Q1 2025": ("QUARTER", "Q1 FY2025"), "H1 FY2025": ("HALF_YEAR", "H1 FY2025"), "2024": ("CALENDAR_YEAR", "2024"),
               "march 2025": ("MONTH", "March 2025"), "FY 2024-25": ("UNKNOWN", "FY 2024-25"), "as of 31 March 2025": ("AS_OF", "2025-03-31"), "31 March 2025": ("EXACT_DATE", "2025-03-31"), "": ("UNKNOWN", None)}
    got = apply(spark, list(periods), dates.period(F.col("a")))
    assert {k: (v["kind"], v["label"]) for k, v in zip(periods, got)} == periods


def test_names_and_predicates(spark):
    names = ["  Acme   Technologies Pvt. Ltd. ", "Acme Technologies Private Limited", "ACME TECHNOLOGIES, INC.", "Acme Technologies LLC", "Acme Technologies Corp.", "Acme Technologies Co."]
    assert set(apply(spark, names, tx.entity_name(F.col("a"), F.lit("ORGANIZATION")))) == {"acme technologies"}
    assert apply(spark, ["John Co."], tx.entity_name(F.col("a"), F.lit("PERSON"))) == ["john co"]
    assert apply(spark, ["Company Limited", "costco"], tx.entity_name(F.col("a"), F.lit("ORGANIZATION"))) == ["", "costco"]
    assert apply(spark, ["ANNUAL--Revenue", "pin codes served", "countries and territories served"], tx.predicate_name(F.col("a"))) == ["annual_revenue", "postal_code_reach", "countries_served"]
    pairs = [("ebitda_profit_fy24", "ebitda", True), ("annual_revenue", "revenue", True), ("adjusted_ebitda", "ebitda", False), ("revenue", "employee_count", False)]
    assert apply(spark, [p[:2] for p in pairs], tx.predicates_compatible(F.col("a"), F.col("b")), "a string, b string") == [p[2] for p in pairs]


def test_trigram_measures(spark):
    pairs = [("word", "two words"), ("acme", "acme"), ("", ""), ("globex technologies", "globex technologie")]
    got = apply(spark, pairs, tx.set_similarity(tx.word_trigrams(F.col("a")), tx.word_trigrams(F.col("b"))), "a string, b string")
    assert got[0] == pytest.approx(4 / 11) and got[1] == 1 and got[2] == 0 and got[3] > 0.85
    d = apply(spark, pairs, tx.dice(F.col("a"), F.col("b")), "a string, b string")
    assert all(0 <= x <= 1 for x in d) and d[1] == 1


def test_numeric_hints():
    text = ("Revenue was $1.2 million and USD 4.5B. Indian revenue reached ₹12 crore. Margin was 44%, improving 320 basis points at 1.6x leverage. "
            "On 31 March 2025 the company employed 4,300 employees.")
    kinds = [h[3] for h in numeric_hints(text)]
    assert kinds == ["MONEY", "MONEY", "MONEY", "PERCENTAGE", "BASIS_POINTS", "MULTIPLE", "DATE", "QUANTITY"]
    assert all(text[a:b] == raw for a, b, raw, _, _ in numeric_hints(text))
