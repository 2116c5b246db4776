"""Numeric hints of a text: prioritized patterns, hits that overlap an earlier pattern's are dropped."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DIGITS, DECIMALS = r"\d[\d,]*", r"(?:\.\d+)?"
NAMES = sorted({*calendar.month_name[1:], *calendar.month_abbr[1:], "Sept"}, key=len, reverse=True)
# Kinds of hints in order of priority, each with what stands before the digits, the digits, and what stands after.
KINDS = [
    ("MONEY", r"(?:[$€£₹]|\b(?:USD|EUR|GBP|INR))\s?", DIGITS + DECIMALS, r"(?:\s?(?:thousand|million|billion|crore|lakh|[KMB]))?"),
    ("DATE", r"\b", r"\d{1,2}", rf"\s+(?:{'|'.join(NAMES)})\s+\d{{4}}\b"),
    ("PERCENTAGE", r"\b", DIGITS + DECIMALS, r"\s?%"),
    ("BASIS_POINTS", r"\b", DIGITS + DECIMALS, r"\s+basis points?\b"),
    ("MULTIPLE", r"\b", r"\d+" + DECIMALS, r"x\b"),
    ("QUANTITY", r"\b", DIGITS, r"\s+employees?\b"),
    ("YEAR", r"\b", r"(?:19|20)\d{2}", r"\b"),
]
PATTERNS = [(kind, re.compile(before + digits + after, re.I | re.A)) for kind, before, digits, after in KINDS]
AROUND = 80


def numeric_hints(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, raw, type, surrounding text), in order of start."""
    taken = bytearray(len(text))
    hits = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span()
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                hits.append((a, b, kind))
    return [(a, b, text[a:b], kind, " ".join(text[max(0, a - AROUND):b + AROUND].split())) for a, b, kind in sorted(hits)]


def hints(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each hint of each text; null texts have none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for hit in numeric_hints(text):
                    at.append(i)
                    rows.append(hit)
            cols = list(zip(*rows)) if rows else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.string()) for c in cols[2:]]],
                names=[key, "start_char", "end_char", "raw", "type_hint", "surrounding_text"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.where(F.col("text").isNotNull()).select(key, "text").mapInArrow(
        scan, f"{key} {kind}, start_char int, end_char int, raw string, type_hint string, surrounding_text string")
