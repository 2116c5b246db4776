"""Fixed vocabularies and column expressions for amounts written by people."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings of units, by the code of unit_factors they stand for.
UNIT_SPELLINGS: dict[str, dict[str, list[str]]] = {
    "PERCENTAGE": {
        "percent": ["%", "percent", "per cent", "pct", "percentage"],
        "basis_point": ["bp", "bps", "basis point", "basis points"],
        "fraction": ["fraction", "decimal fraction"],
        "permille": ["‰", "per mille", "permille", "per mil"],
    },
    "DURATION": {
        "hour": ["h", "hr", "hrs", "hour", "hours"],
        "minute": ["min", "mins", "minute", "minutes"],
        "day": ["d", "day", "days"],
        "week": ["wk", "wks", "week", "weeks"],
        "month": ["mth", "mths", "month", "months"],
        "year": ["yr", "yrs", "year", "years"],
    },
    "QUANTITY": {
        "kg": ["kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes"],
        "g": ["g", "gm", "gms", "gram", "grams", "gramme", "grammes"],
        "tonne": ["t", "mt", "tonne", "tonnes", "metric ton", "metric tons"],
        "pound": ["lb", "lbs", "pound", "pounds"],
        "short_ton": ["short ton", "short tons", "us ton", "us tons"],
        "kWh": ["kwh", "kilowatt-hour", "kilowatt-hours", "kilowatt hour", "kilowatt hours"],
        "MWh": ["mwh", "megawatt-hour", "megawatt-hours", "megawatt hour", "megawatt hours"],
        "GWh": ["gwh", "gigawatt-hour", "gigawatt-hours", "gigawatt hour", "gigawatt hours"],
        "MJ": ["mj", "megajoule", "megajoules"],
        "GJ": ["gj", "gigajoule", "gigajoules"],
        "m": ["m", "meter", "meters", "metre", "metres"],
        "km": ["km", "kms", "kilometer", "kilometers", "kilometre", "kilometres"],
        "mile": ["mi", "mile", "miles"],
        "foot": ["ft", "foot", "feet"],
        "m2": ["m²", "m2", "sqm", "sq m", "sq. m", "square meter", "square meters", "square metre", "square metres"],
        "hectare": ["ha", "hectare", "hectares"],
        "acre": ["ac", "acre", "acres"],
        "sq_ft": ["ft²", "ft2", "sqft", "sq ft", "sq. ft", "square foot", "square feet"],
        "km2": ["km²", "km2", "sqkm", "sq km", "sq. km", "square kilometer", "square kilometers", "square kilometre", "square kilometres"],
        "litre": ["l", "liter", "liters", "litre", "litres"],
        "m3": ["m³", "m3", "cbm", "cubic meter", "cubic meters", "cubic metre", "cubic metres"],
        "us_gallon": ["gal (us)", "us gallon", "us gallons", "us gal"],
        "barrel": ["bbl", "bbls", "barrel", "barrels"],
        "one": ["count", "nos.", "nos", "no.", "persons", "person", "units", "unit", "in total", "total", "items", "pieces"],
        "dozen": ["dozen", "dozens"],
    },
    "MONEY": {
        "USD": ["usd", "us$", "$", "us dollar", "us dollars", "dollar", "dollars"],
        "EUR": ["eur", "€", "euro", "euros"],
        "GBP": ["gbp", "£", "pound", "pounds", "pound sterling", "pounds sterling"],
        "INR": ["inr", "₹", "rs", "rs.", "rupee", "rupees", "indian rupee", "indian rupees"],
        "JPY": ["jpy", "¥", "yen", "japanese yen"],
        "CHF": ["chf", "fr", "fr.", "sfr", "swiss franc", "swiss francs"],
        "CAD": ["cad", "c$", "ca$", "canadian dollar", "canadian dollars"],
        "AUD": ["aud", "a$", "au$", "australian dollar", "australian dollars"],
    },
}

# Words of scale. The second table holds those that name a unit in other value types.
SCALES: dict[str, float] = {
    "hundred": 1e2, "thousand": 1e3, "thousands": 1e3, "k": 1e3, "'000": 1e3, "000s": 1e3, "tsd": 1e3, "mille": 1e3,
    "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "mio": 1e6, "mln": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "mrd": 1e9, "milliard": 1e9, "milliards": 1e9,
    "trillion": 1e12, "trillions": 1e12, "tn": 1e12,
}
MONEY_SCALES: dict[str, float] = {"m": 1e6, "b": 1e9}

# Numbers in words.
NUMBER_WORDS: dict[str, float] = {
    "half a": 0.5, "half": 0.5, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90,
}

# Units that say that the unit is unknown.
UNKNOWN_UNITS = ["?", "n/s", "n/a", "na", "unspecified", "unknown", "not specified", "not stated", "-"]

SPACES = r"[\s\p{Z}\x{200B}\x{FEFF}]+"


def literal_map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def squash(c: Column) -> Column:
    """Lower case, one ordinary space between words, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(c, SPACES, " ")))

