from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators.units import hide_units, infer_units, unify_units

FACTORS = [("money", "USD", "USD", 1.0), ("money", "EUR", "USD", 1.0842), ("money", "INR", "USD", 0.0119), ("money", "JPY", "USD", 0.0066), ("money", "CHF", "USD", 1.1305), ("money", "GBP", "USD", 1.2614),
           ("money", "CAD", "USD", 0.7312), ("pct", "percent", "basis_point", 100.0), ("pct", "basis_point", "basis_point", 1.0), ("pct", "fraction", "basis_point", 10000.0), ("pct", "permille", "basis_point", 10.0),
           ("mass", "kg", "kg", 1.0), ("mass", "tonne", "kg", 1000.0), ("mass", "pound", "kg", 0.45359237), ("length", "m", "m", 1.0), ("length", "km", "m", 1000.0), ("volume", "us_gallon", "litre", 3.785411784),
           ("time", "hour", "hour", 1.0), ("time", "day", "hour", 24.0), ("area", "m2", "m2", 1.0), ("count", "one", "one", 1.0), ("count", "dozen", "one", 12.0)]

CASES = [  # value, type, unit, currency, expected (unit, amount) or None
    ("$1.2M", "MONEY", None, None, ("USD", 1200000)), ("USD 1,200,000", "MONEY", None, None, ("USD", 1200000)), ("($399.3m)", "MONEY", None, "USD", ("USD", -399300000)),
    ("-182,1 Mio. USD", "MONEY", None, "USD", ("USD", -182100000)), ("5,482 mio USD", "MONEY", None, None, ("USD", 5482000000)), ("12,96 millions CHF", "MONEY", None, None, ("USD", 14651280)),
    ("US$1,527 mio.", "MONEY", None, None, ("USD", 1527000000)), ("half a million US dollars", "MONEY", None, None, ("USD", 500000)), ("seventy-five thousand dollars", "MONEY", None, None, ("USD", 75000)),
    ("Rs 43,59,57,000", "MONEY", None, None, ("USD", 5187888)), ("₹10 crore", "MONEY", None, None, ("USD", 1190000)), ("1,519", "MONEY", "mn", "EUR", ("USD", 1646899800)), ("863.5", "MONEY", "'000 of dollars", None, ("USD", 863500)),
    ("C$32.92m.", "MONEY", None, "CAD", ("USD", 24071104)), ("approx. ¥15.56mn", "MONEY", None, None, ("USD", 102696)), ("5,482", "MONEY", "k", None, None), ("27,363 thousand pounds", "MONEY", None, None, ("USD", 34515688)),
    ("15%", "PERCENTAGE", None, None, ("basis_point", 1500)), ("0.0455", "PERCENTAGE", "decimal fraction", None, ("basis_point", 455)), ("22.2 per mille", "PERCENTAGE", None, None, ("basis_point", 222)),
    ("4.81", "PERCENTAGE", None, None, None), ("157", "PERCENTAGE", "bp", None, ("basis_point", 157)), ("10,382 metric tons", "QUANTITY", None, None, ("kg", 10382000)), ("3,120 pounds", "QUANTITY", None, None, ("kg", 1415)),
    ("3,065,431 m", "QUANTITY", None, None, ("m", 3065431)), ("2,411 gal (US)", "QUANTITY", None, None, ("litre", 9127)), ("0.033k", "QUANTITY", None, None, ("one", 33)), ("25 dozen", "QUANTITY", None, None, ("one", 300)),
    ("0.091 thousand in total", "QUANTITY", None, None, ("one", 91)), ("38 units", "QUANTITY", "persons", None, ("one", 38)), ("2,717", "QUANTITY", None, None, ("one", 2717)), ("2,221", "QUANTITY", "?", None, None),
    ("several hundred", "QUANTITY", None, None, None), ("-", "QUANTITY", None, None, None), ("n/a", "QUANTITY", None, None, None), ("20,817 sq. m", "QUANTITY", None, None, ("m2", 20817)), ("4.084", "QUANTITY", "'000", None, ("one", 4084)),
    ("9 days 20 hours", "DURATION", None, None, ("hour", 236)), ("15d 19h", "DURATION", None, None, ("hour", 379)), ("68.5", "DURATION", "d", None, ("hour", 1644)), ("", "MONEY", "USD", None, None), (None, "MONEY", None, "USD", None),
    ("5 kg", None, None, None, None),
]


@pytest.fixture(scope="module")
def factors(spark):
    return spark.createDataFrame(FACTORS, "unit_kind string, unit_code string, common_unit string, factor double").cache()


def rows(spark, cases):
    return spark.createDataFrame([(f"f{i:03d}", v, t, u, c, "x") for i, (v, t, u, c, *_) in enumerate(cases)],
                                 "fact_id string, value_raw string, value_type string, unit string, currency string, amount string")


def test_stated_amounts(spark, factors):
    got = {r["fact_id"]: r for r in unify_units(rows(spark, CASES), factors).collect()}
    assert len(got) == len(CASES)
    for i, (value, kind, unit, currency, want) in enumerate(CASES):
        r = got[f"f{i:03d}"]
        have = (r["common_unit"], r["common_amount"]) if r["status"] == "stated" else None
        assert have == want, (value, kind, unit, currency, have, want)


def test_repeated_rows_and_empty_table(spark, factors):
    twice = rows(spark, CASES[:2]).unionByName(rows(spark, CASES[:2]))
    assert unify_units(twice, factors).count() == 4
    assert unify_units(rows(spark, CASES[:1]).limit(0), factors).count() == 0


def test_missing_units_get_the_likeliest_one(spark, factors):
    """Amounts near 300 basis points: bare 3.1 is percent, bare 290 basis points; one far off is uncertain or flagged."""
    stated = [(f"{2.5 + i % 20 / 10:.1f}%", "PERCENTAGE", None, None) for i in range(200)] + [(f"{250 + i}", "PERCENTAGE", "bp", None) for i in range(100)]
    bare = [("3.1", "PERCENTAGE", None, None), ("290", "PERCENTAGE", None, None), ("0.031", "PERCENTAGE", None, None), ("0", "PERCENTAGE", None, None)]
    amounts = unify_units(rows(spark, stated + bare), factors)
    got = {r["number"]: r for r in infer_units(amounts, factors).collect()}
    assert got[3.1]["unit_code"] == "percent" and got[3.1]["common_amount"] == 310 and got[3.1]["certain"]
    assert got[290.0]["unit_code"] == "basis_point" and got[290.0]["certain"]
    assert got[0.031]["unit_code"] == "fraction"
    assert not got[0.0]["certain"]


def test_nothing_to_learn_from(spark, factors):
    got = infer_units(unify_units(rows(spark, [("5", "MONEY", None, None)]), factors), factors).collect()
    assert [(r["unit_code"], r["certain"]) for r in got] == [(None, False)]


def test_one_mixture_over_all_kinds(spark, factors):
    """Masses near 5 tonnes and lengths near 40 m, two thirds masses: what is bare is told by kind and unit, and as surely as it is right."""
    import random

    rng = random.Random(3)
    cases = []
    for i in range(900):
        grams = 10 ** rng.gauss(3.7, 0.15)
        cases.append((f"{grams:.0f} kg" if i % 2 else f"{grams / 1000:.2f} t", "QUANTITY", None, None) if i % 3 else (f"{10 ** rng.gauss(1.6, 0.1):.1f} m", "QUANTITY", None, None))
    cases += [("0 kg", "QUANTITY", None, None), ("0", "QUANTITY", "?", None)]
    amounts = unify_units(rows(spark, cases), factors)
    hidden = hide_units(amounts, 3)
    truth = {r["fact_id"]: r["true_code"] for r in hidden.where("true_code is not null").collect()}
    got = {r["fact_id"]: r for r in infer_units(hidden, factors).collect()}
    right = {i: got[i]["unit_code"] == c for i, c in truth.items()}
    sure = [right[i] for i in truth if got[i]["certain"]]
    assert sum(right.values()) / len(right) > 0.97 and len(sure) > 0.8 * len(right) and sum(sure) / len(sure) > 0.97
    zero = got[f"f{len(cases) - 1:03d}"]
    assert zero["unit_code"] in ("kg", "tonne") and not zero["certain"] and zero["common_amount"] == 0


def test_groups_with_enough_amounts_have_mixtures_of_their_own(spark, factors):
    cases = [("3.1%", "PERCENTAGE", None, None)] * 60 + [("250 bp", "PERCENTAGE", None, None)] * 60 + [("240", "PERCENTAGE", None, None)] * 2
    amounts = unify_units(rows(spark, cases), factors).withColumn("g", F.when(F.col("unit_code") == "percent", "a").otherwise("b"))
    bare = amounts.where("status = 'unit_missing'").withColumn("g", F.when(F.col("fact_id") == "f120", "b").otherwise("few"))
    got = {r["fact_id"]: r["unit_code"] for r in infer_units(amounts.where("status = 'stated'").unionByName(bare), factors, group="g").collect()}
    assert got["f120"] == "basis_point" and got["f121"] is not None
