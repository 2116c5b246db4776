"""Forms for display, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Statuses after which nothing more happens to a document, and job states that count as running.
TERMINAL = ["COMPLETED", "COMPLETED_WITH_ISSUES", "FAILED"]
ACTIVE = ["active", "waiting", "delayed", "prioritized", "waiting-children"]


def humanize(c: Column) -> Column:
    """snake_case or UPPER_CASE as words with a capital at the beginning."""
    words = F.lower(F.trim(F.regexp_replace(c, r"[_\s]+", " ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def confidence(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def terminal(c: Column) -> Column:
    return c.isin(TERMINAL)


def active(c: Column) -> Column:
    return c.isin(ACTIVE)


def context_entries(c: Column) -> Column:
    """Entries of a map that have something to show."""
    return F.map_filter(c, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def box_percent(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Box on a page (origin at the bottom) in percent of a view whose origin is at the top."""
    part = lambda a, b: F.round(100 * F.try_divide(a, b), 4)
    return F.struct(part(x, page_width).alias("left"), part(page_height - y - height, page_height).alias("top"), part(width, page_width).alias("width"), part(height, page_height).alias("height"))
