"""Quantities recorded in different units: one common unit for each kind (problem 1).

``stated_amounts`` reads number, scale and unit out of value_raw, unit and currency with
Catalyst expressions only; ``infer_units`` assigns units where none is stated, by mixtures on the
logarithmic scale whose components are offset by the known conversion factors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from factloom.functions import quantities as Q

NUMBER = r"\d(?:[\d.,]*\d)?"


def _number(text: Column, comma_notation: Column) -> Column:
    """The number a digit string stands for, as DECIMAL(38,12).

    A comma before exactly three digits groups thousands (Indian groups of two before it too)
    unless the notation writes the decimal point as a comma; any other comma is a decimal point.
    """
    grouped = text.rlike(r"^\d{1,3}(?:,\d{2,3})*,\d{3}(?:\.\d+)?$") & ~(comma_notation & text.rlike(r"^\d{1,3},\d{3}$"))
    continental = text.rlike(r"^\d{1,3}(?:\.\d{3})+,\d+$") | text.rlike(r"^\d{1,3}(?:\.\d{3}){2,}$")
    plain = (F.when(grouped, F.replace(text, F.lit(","), F.lit("")))
             .when(continental, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
             .otherwise(F.replace(text, F.lit(","), F.lit("."))))
    return plain.try_cast(T.DecimalType(38, 12))


def _scale_of(words: Column, money: Column) -> Column:
    table, extra = Q.literal_map(Q.SCALES), Q.literal_map(Q.MONEY_SCALES)
    words = F.when(F.col("value_type") == "PERCENTAGE", F.array().cast("array<string>")).otherwise(words)
    first = F.filter(words, lambda w: F.map_contains_key(table, w) | (money & F.map_contains_key(extra, w)))
    word = F.try_element_at(first, F.lit(1))
    return F.coalesce(F.try_element_at(table, word), F.when(money, F.try_element_at(extra, word)))


def _phrase(words: Column, money: Column) -> Column:
    """What is left beside the words of scale and fillers: the spelling of the unit."""
    scales = F.array(*[F.lit(w) for w in Q.SCALES])
    fillers = F.array(F.lit("in"), F.lit("of"), F.lit(""))
    kept = F.filter(words, lambda w: ~F.array_contains(scales, w) & ~F.array_contains(fillers, w)
                    & ~(money & w.isin(list(Q.MONEY_SCALES))))
    return F.array_join(F.when(F.col("value_type") == "PERCENTAGE", words).otherwise(kept), " ")


def _words(text: Column) -> Column:
    """Words of a unit text; symbols of currency stand apart, dots after scale words go."""
    apart = F.regexp_replace(text, r"(us\$|ca\$|au\$|c\$|a\$|[$€£¥₹%‰])", " $1 ")
    dotless = F.regexp_replace(apart, r"(?<=\p{L})\.(?=\s|$)", "")
    return F.split(F.trim(F.regexp_replace(dotless, r"\s+", " ")), " ")


def unit_aliases(spark: SparkSession) -> DataFrame:
    """Spelling table: (alias_type, spelling) -> unit code; a fixed table of about 150 rows."""
    rows = [(vt, s.replace("sq. ", "sq ").rstrip(".") if s not in ("$",) else s, code)
            for vt, codes in Q.UNIT_SPELLINGS.items() for code, names in codes.items() for s in names]
    return spark.createDataFrame(sorted(set(rows)), "alias_type string, spelling string, code string")


def parse_values(facts: DataFrame) -> DataFrame:
    """Adds __num (signed, scaled), __value_unit, __unit_unit, __currency, __unknown, __plain.

    value_raw, unit or currency may be null or empty; such parts state nothing. Dashes, n/a and
    vague words ("several hundred") state no number.
    """
    money = F.col("value_type") == "MONEY"
    v0 = Q.squash(F.col("value_raw"))
    v1 = F.regexp_replace(v0, r"^(?:approx(?:imately)?\.?|about|nearly|around|roughly|circa|c\.|ca\.|~)\s*", "")
    v = F.regexp_replace(v1, r"\.$", "")
    digits = F.regexp_extract(v, NUMBER, 0)
    has_digits = F.length(digits) > 0
    negative = v.rlike(r"^\(.*\)$") | v.rlike(r"^\s*[-−–]\s*[^\s]")
    bare = F.regexp_replace(F.regexp_replace(v, r"^[-−–]\s*", ""), r"^\((.*)\)$", "$1")
    # "Mio." within the text is the continental abbreviation; at its end the dot may close a sentence.
    comma = v.rlike(r"(?<!\p{L})(?:tsd|mrd|mille|milliards?)(?!\p{L})|(?<!\p{L})mio\.\s*\p{L}")
    spelled_words = "|".join(sorted(Q.NUMBER_WORDS, key=len, reverse=True))
    spelled = F.regexp_extract(bare, rf"^({spelled_words})(?:[- ](one|two|three|four|five|six|seven|eight|nine))?(?=\s)", 1)
    spelled_unit = F.regexp_extract(bare, rf"^({spelled_words})(?:[- ](one|two|three|four|five|six|seven|eight|nine))?(?=\s)", 2)
    numbers = Q.literal_map({k: float(x) for k, x in Q.NUMBER_WORDS.items()})
    has_spelled = ~has_digits & (F.length(spelled) > 0)
    spelled_value = F.try_element_at(numbers, spelled) + F.coalesce(F.try_element_at(numbers, spelled_unit), F.lit(0.0))
    pair = r"^(\d[\d.,]*)\s*(?:d|days?)\s+(\d[\d.,]*)\s*(?:h|hrs?|hours?)$"
    is_pair = (F.col("value_type") == "DURATION") & bare.rlike(pair)
    number_rest = F.when(has_digits, F.regexp_replace(bare, NUMBER, " ")).otherwise(
        F.regexp_replace(bare, rf"^({spelled_words})(?:[- ](one|two|three|four|five|six|seven|eight|nine))?(?=\s)", " "))
    value_words = _words(number_rest)
    unit_text = Q.squash(F.col("unit"))
    unit_words = _words(unit_text)
    none = F.lit(False)
    staged = (facts
              .withColumn("__money", F.coalesce(money, none))
              .withColumn("__digits", digits).withColumn("__comma", F.coalesce(comma, none))
              .withColumn("__neg", F.coalesce(negative, none))
              .withColumn("__spelled", F.when(has_spelled, spelled_value))
              .withColumn("__is_pair", F.coalesce(is_pair, none)).withColumn("__bare", bare)
              .withColumn("__vw", value_words).withColumn("__uw", unit_words)
              .withColumn("__unknown", F.coalesce(unit_text.isin(Q.UNKNOWN_UNITS), none))
              .withColumn("__unit_given", F.coalesce(F.length(unit_text) > 0, none))
              .withColumn("__currency", F.array_join(_words(Q.squash(F.col("currency"))), " ")))
    one = F.lit(1.0)
    scale = F.coalesce(_scale_of(F.col("__vw"), F.col("__money")), _scale_of(F.col("__uw"), F.col("__money")), one)
    number = F.coalesce(_number(F.col("__digits"), F.col("__comma")), F.col("__spelled").cast(T.DecimalType(38, 12)))
    days = _number(F.regexp_extract("__bare", pair, 1), none)
    hours = _number(F.regexp_extract("__bare", pair, 2), none)
    sign = F.when(F.col("__neg"), F.lit(-1)).otherwise(F.lit(1))
    return (staged
            .withColumn("__num", F.when(F.col("__is_pair"), (days * 24 + hours).cast(T.DecimalType(38, 12))).otherwise(number) * sign)
            .withColumn("__scale", F.when(F.col("__is_pair"), one).otherwise(scale))
            .withColumn("__value_unit", F.when(F.col("__is_pair"), F.lit("h")).otherwise(_phrase(F.col("__vw"), F.col("__money"))))
            .withColumn("__unit_unit", _phrase(F.col("__uw"), F.col("__money"))))


def unify_units(facts: DataFrame, factors: DataFrame, id_col: str = "fact_id") -> DataFrame:
    """Every fact with a number: amount in the common unit where number and unit are stated.

    Returns id, value_type, unit_kind, unit_code, common_unit, amount (DOUBLE, in common units),
    common_amount (BIGINT, half away from zero), status: ``stated``; ``unit_missing`` (a number
    whose unit nobody states or which is said to be unknown); ``no_number``. Null or unknown
    value_type gives ``unit_missing`` or ``no_number``. Repeated rows each come out; other columns
    of the input are ignored. An empty input gives an empty result.
    """
    spark = facts.sparkSession
    base = facts.select(F.col(id_col).alias("fact_id"), "value_raw", "value_type", "unit", "currency")
    parsed = parse_values(base)
    # Of the three texts, the first one that spells a unit counts: value, unit, currency.
    aliases = unit_aliases(spark)
    codes = aliases.join(F.broadcast(factors.select(F.col("unit_code").alias("code"), "unit_kind", "common_unit",
                                                    F.col("factor").cast("double").alias("factor"))), "code")

    def lookup(prefix: str) -> DataFrame:
        return F.broadcast(codes.select(F.col("alias_type").alias("value_type"), F.col("spelling").alias(f"__{prefix}"),
                                        F.struct("code", "unit_kind", "common_unit", "factor").alias(f"__{prefix}_hit")))

    out = parsed
    for prefix in ("value_unit", "unit_unit", "currency"):
        out = out.join(lookup(prefix), ["value_type", f"__{prefix}"], "left")
    one = F.broadcast(factors.where(F.col("unit_code") == "one").limit(1).select(
        F.lit("QUANTITY").alias("value_type"), F.struct(F.col("unit_code").alias("code"), "unit_kind", "common_unit", F.col("factor").cast("double").alias("factor")).alias("__one")))
    out = out.join(one, "value_type", "left")
    plain_count = ((F.col("value_type") == "QUANTITY") & (F.coalesce(F.col("__value_unit"), F.lit("")) == "")
                   & (F.coalesce(F.col("__unit_unit"), F.lit("")) == ""))
    strange = (F.coalesce(F.col("__value_unit"), F.lit("")) != "") & F.col("__value_unit_hit").isNull()
    hit = F.when(F.col("__unknown") | strange, F.lit(None)).otherwise(F.coalesce(
        F.col("__value_unit_hit"), F.col("__unit_unit_hit"),
        F.when(F.col("__money"), F.col("__currency_hit")), F.when(plain_count, F.col("__one"))))
    out = out.withColumn("__hit", hit)
    factor = F.col("__hit.factor")
    # Decimal arithmetic on the number, double on the factor; a nudge below the 12th place keeps exact halves exact.
    exact = F.col("__num").cast("double") * F.col("__scale") * factor
    amount = F.when(F.col("__num").isNotNull(), exact)
    nudged = F.abs(amount) * (1 + 1e-13)
    rounded = (F.signum(amount) * F.floor(nudged + 0.5)).cast("bigint")
    status = (F.when(F.col("__num").isNull(), "no_number").when(F.col("__hit").isNull(), "unit_missing").otherwise("stated"))
    return out.select(
        "fact_id", "value_type", F.col("__hit.unit_kind").alias("unit_kind"), F.col("__hit.code").alias("unit_code"),
        F.col("__hit.common_unit").alias("common_unit"), amount.alias("amount"), rounded.alias("common_amount"),
        (F.col("__num").cast("double") * F.col("__scale")).alias("number"), status.alias("status"))


# --- units that nobody states -------------------------------------------------------------------

BIN = 0.05  # width of a bin of log10
LOW, HIGH = -12.0, 38.0  # all that DECIMAL(38,12) can hold
BINS = int(round((HIGH - LOW) / BIN))
ZERO = -1  # the bin of zero, which has no logarithm
ENOUGH = 50  # stated amounts a group needs for a mixture of its own
CENTRES = LOW + (np.arange(BINS) + 0.5) * BIN


def _bin(c: Column) -> Column:
    return F.when(c == 0, ZERO).otherwise(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.log10(F.abs(c)) - LOW) / BIN).cast("int"))))


def fit_density(histogram: np.ndarray, components: int = 4, rounds: int = 60):
    """Log density of log10 amounts: a Gaussian mixture fitted to a histogram by EM, its means from the quantiles."""
    w = histogram + 1e-9
    mean = np.average(CENTRES, weights=w)
    mu = np.interp((np.arange(components) + 0.5) / components, np.cumsum(w) / w.sum(), CENTRES)
    sd = np.full(components, max(0.3, math.sqrt(np.average((CENTRES - mean) ** 2, weights=w)) / 2))
    pi = np.full(components, 1 / components)
    for _ in range(rounds):
        d = np.log(pi) - np.log(sd) - (CENTRES[:, None] - mu) ** 2 / (2 * sd**2)
        r = np.exp(d - d.max(1, keepdims=True))
        r = r / r.sum(1, keepdims=True) * w[:, None]
        n = r.sum(0) + 1e-9
        pi, mu = n / n.sum(), (r * CENTRES[:, None]).sum(0) / n
        sd = np.sqrt((r * (CENTRES[:, None] - mu) ** 2).sum(0) / n + 0.02)

    def density(y: np.ndarray) -> np.ndarray:
        d = np.log(pi) - np.log(sd * math.sqrt(2 * math.pi)) - (y[..., None] - mu) ** 2 / (2 * sd**2)
        m = d.max(-1)
        return m + np.log(np.exp(d - m[..., None]).sum(-1))

    return density


def fit_weights(like: np.ndarray, missing: np.ndarray, prior: np.ndarray, strength: float = 5.0, rounds: int = 60) -> np.ndarray:
    """Weights of all components of one mixture, of whatever kind, for a histogram of bare numbers."""
    weights = prior.copy()
    for _ in range(rounds):
        post = posterior(like, weights)
        weights = (post * missing[:, None]).sum(0) + prior * strength
        weights /= weights.sum()
    return weights


def posterior(like: np.ndarray, weights: np.ndarray) -> np.ndarray:
    d = np.log(weights + 1e-12) + like
    d = np.exp(d - d.max(1, keepdims=True))
    return d / d.sum(1, keepdims=True)


def _mixture(seen: dict[str, np.ndarray], units: dict[str, float], gap: np.ndarray, zeros: float, kinds: dict[str, dict]) -> list[tuple[int, str, float]]:
    """(bin, unit, posterior): one mixture over the units of all kinds seen; zeros go by its weights."""
    codes = [c for c, k in kinds.items() if k["unit_kind"] in seen]
    like = np.empty((BINS, len(codes)))
    for kind, histogram in seen.items():
        density = fit_density(histogram)
        for j, c in enumerate(codes):
            if kinds[c]["unit_kind"] == kind:  # a bare number x means the amount x times the factor
                like[:, j] = density(CENTRES + math.log10(kinds[c]["factor"]))
    prior = np.array([units.get(c, 0.0) + 0.5 for c in codes])
    weights = fit_weights(like, gap, prior / prior.sum())
    post = posterior(like, weights)
    best, likeliest = post.argmax(1), int(weights.argmax())
    return [(i, codes[j], float(post[i, j])) for i, j in enumerate(best)] + [(ZERO, codes[likeliest], float(weights[likeliest]))]


def infer_units(amounts: DataFrame, factors: DataFrame, sure: float = 0.9, group: str | None = None) -> DataFrame:
    """Units by posterior for the facts of ``unify_units`` whose status is unit_missing.

    Bare numbers of one value type (and one ``group``, a column with a bounded number of values, where
    ENOUGH amounts are stated) follow one mixture. Its components are all units of all kinds stated
    there: the density of a kind's amounts, shifted by the unit's factor; weights are fitted
    jointly. The unit of the highest posterior is assigned; ``certain`` is false below ``sure``. Zero has no
    logarithm: such rows get the likeliest unit by weight and certain = false. Without any stated
    amount of the value type nothing is assigned (unit null). Only histograms reach the driver.
    """
    spark = amounts.sparkSession
    kinds = {r["unit_code"]: r.asDict() for r in factors.select("unit_kind", "unit_code", "common_unit", "factor").collect()}
    grouped = amounts.withColumn("grp", F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit(""))
    usable = grouped.where(F.col("number").isNotNull())
    none = F.lit(None).cast("string")
    stated = usable.where((F.col("status") == "stated") & (F.col("amount") != 0)).groupBy("value_type", "grp", "unit_kind", "unit_code", _bin(F.col("amount")).alias("bin")).count()
    missing = usable.where(F.col("status") == "unit_missing").groupBy("value_type", "grp", none.alias("unit_kind"), none.alias("unit_code"), _bin(F.col("number")).alias("bin")).count()
    seen: dict[tuple, dict[str, np.ndarray]] = {}
    units: dict[tuple, dict[str, float]] = {}
    gaps: dict[tuple, np.ndarray] = {}
    for r in stated.unionByName(missing).collect():  # at most (kinds + 1) x groups x BINS rows
        for key in {(r["value_type"], r["grp"]), (r["value_type"], "")}:
            if r["unit_kind"] is None:
                gaps.setdefault(key, np.zeros(BINS + 1))[r["bin"]] += r["count"]  # the last one is ZERO
            else:
                seen.setdefault(key, {}).setdefault(r["unit_kind"], np.zeros(BINS))[r["bin"]] += r["count"]
                own = units.setdefault(key, {})
                own[r["unit_code"]] = own.get(r["unit_code"], 0.0) + r["count"]
    rows = []
    for key, gap in gaps.items():
        if key in seen and (key[1] == "" or sum(units[key].values()) >= ENOUGH):
            for i, code, p in _mixture(seen[key], units[key], gap[:BINS], gap[ZERO], kinds):
                k = kinds[code]
                rows.append((*key, i, k["unit_kind"], code, k["common_unit"], float(k["factor"]), p))
    shape = "value_type string, grp string, bin int, unit_kind string, unit_code string, common_unit string, factor double, posterior double"
    table = spark.createDataFrame(rows, shape)
    hit = F.struct("unit_kind", "unit_code", "common_unit", "factor", "posterior")
    fine = table.select("value_type", "grp", "bin", hit.alias("fine"))
    coarse = table.where("grp = ''").select("value_type", "bin", hit.alias("coarse"))
    lost = grouped.where(F.col("status") == "unit_missing").select("fact_id", "value_type", "grp", "number", _bin(F.col("number")).alias("bin"))
    told = lost.join(F.broadcast(fine), ["value_type", "grp", "bin"], "left").join(F.broadcast(coarse), ["value_type", "bin"], "left").withColumn("x", F.coalesce("fine", "coarse"))
    return told.select(
        "fact_id", "value_type", "number", F.col("x.unit_kind").alias("unit_kind"), F.col("x.unit_code").alias("unit_code"), F.col("x.common_unit").alias("common_unit"),
        F.round(F.col("number") * F.col("x.factor")).cast("bigint").alias("common_amount"), F.col("x.posterior").alias("posterior"),
        F.coalesce((F.col("x.posterior") >= sure) & (F.col("number") != 0), F.lit(False)).alias("certain"))


def hide_units(amounts: DataFrame, one_in: int = 4) -> DataFrame:
    """Stated amounts as if one in so many had no unit: what ``infer_units`` is measured by. Adds ``true_code``."""
    hidden = (F.col("status") == "stated") & (F.pmod(F.xxhash64("fact_id", F.lit(5)), F.lit(one_in)) == 0)
    drop = lambda c: F.when(~hidden, F.col(c)).alias(c)
    blank = {"unit_kind", "unit_code", "common_unit", "amount", "common_amount"}
    kept = [drop(c) if c in blank else F.col(c) for c in amounts.columns if c != "status"]
    return amounts.select(*kept, F.when(hidden, "unit_missing").otherwise(F.col("status")).alias("status"), F.when(hidden, F.col("unit_code")).alias("true_code"))
