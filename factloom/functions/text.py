"""Column expressions on text: normal forms, trigram measures, token estimates."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: White space in the wide sense; trim and \s alone do not cover all of it.
WIDE = r"[\s\p{Z}\x{FEFF}]+"
EDGE = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"

# Legal suffixes of organisation names, in the order in which they are tried.
ORGANIZATION_SUFFIXES = ["private limited", "pvt limited", "pvt ltd", "public limited", "incorporated", "corporation",
                         "company", "limited", "llc", "corp", "ltd", "inc", "co"]
# Spellings of predicates that stand for another.
PREDICATE_ALIASES = {
    "countries_and_territories_served": "countries_served",
    "country_and_territory_reach": "countries_served",
    "pin_code_reach": "postal_code_reach",
    "pin_codes_served": "postal_code_reach",
    "pincode_reach": "postal_code_reach",
    "postal_codes_served": "postal_code_reach",
}
# Words of a predicate that do not change its concept.
CONCEPT_MODIFIERS = ["annual", "quarterly", "reported", "profit", "loss", "positive", "negative"]


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """Compatibility composition. Texts in ASCII are their own form and reach Python as nulls."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def trim_wide(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(trim_wide(c), WIDE, " ")


def comparable(c: Column) -> Column:
    """Subjects, texts and labels as they are compared: compatibility form, collapsed, lower case."""
    return F.lower(collapse(nfkc(c)))


def display_name(c: Column) -> Column:
    """Names as they are shown: compatibility form, collapsed, letter case kept."""
    return collapse(nfkc(c))


def context_label(c: Column) -> Column:
    """comparable, but null where nothing is left."""
    return F.nullif(comparable(c), F.lit(""))


def entity_name(c: Column, entity_type: Column) -> Column:
    """Entity names as they are matched; legal suffixes go from organisations (or where no type is given)."""
    clean = F.trim(F.regexp_replace(comparable(c), r"[^\p{L}\p{N}]+", " "))
    suffix = rf"(?:(?:^| )(?:{'|'.join(ORGANIZATION_SUFFIXES)}))+$"
    return F.when(F.coalesce(entity_type, F.lit("ORGANIZATION")) == "ORGANIZATION", F.regexp_replace(clean, suffix, "")).otherwise(clean)


def predicate_name(c: Column) -> Column:
    """snake_case with the known aliases resolved."""
    snake = F.regexp_replace(F.regexp_replace(comparable(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    pairs = [F.lit(x) for kv in PREDICATE_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), snake), snake)


def predicate_concept(c: Column) -> Column:
    """The predicate without modifiers, fiscal years, quarters and years."""
    modifier = rf"^(?:{'|'.join(CONCEPT_MODIFIERS)}|fy\d{{2}}(?:\d{{2}})?|q[1-4]|\d{{4}})$"
    return F.array_join(F.filter(F.split(c, "_"), lambda t: ~t.rlike(modifier) & (t != "")), "_")


def predicates_compatible(a: Column, b: Column) -> Column:
    x, y = predicate_concept(a), predicate_concept(b)
    return (a == b) | ((x != "") & (x == y))


def estimated_tokens(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(c) / 4).cast("int"))).cast("int")


def blocks(c: Column) -> Column:
    """Paragraphs: split at blank lines, collapsed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: collapse(p)), lambda p: p != "")


def grams(text: Column, n: int = 3) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))


def name_words(c: Column) -> Column:
    """The words of a name in lower case, blanks between them."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")


def word_trigrams(c: Column) -> Column:
    """Set of trigrams over the words of a name; each word padded with two blanks before and one after."""
    words = F.filter(F.split(name_words(c), " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: grams(F.concat(F.lit("  "), w, F.lit(" "))))))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 if there are none."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def dice_grams(c: Column) -> Column:
    """Multiset of trigrams of a whole text padded with two blanks at both ends."""
    clean = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}$€£₹%]+", " "))
    return grams(F.concat(F.lit("  "), clean, F.lit("  ")))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, g: acc + F.least(
        F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g))))


def dice(a: Column, b: Column) -> Column:
    x, y = dice_grams(a), dice_grams(b)
    return 2 * multiset_overlap(x, y) / (F.size(x) + F.size(y))


def contains_folded(c: Column, needle: str) -> Column:
    """Case-insensitive containment; wildcards in the needle mean themselves."""
    return F.contains(F.lower(c), F.lit(needle.lower()))
