"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: At most this many keys can be hot, whatever the data: each holds over 1/HOT_SHARE of the rows.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, unique: DataFrame, keys: list[str], count: str, total: int,
             floor: int = 100_000, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a side that has one row for each key and the key's row count.

    Keys with more than max(floor, total / HOT_SHARE) rows are joined by broadcast: there are
    fewer than HOT_SHARE of them by arithmetic, so the broadcast side is bounded and no task
    receives a hot key whole. All other keys meet in an ordinary shuffle join, where no key holds
    more than the limit. No row is dropped or capped. ``how``: inner or left_semi.
    """
    limit = max(floor, total // HOT_SHARE)
    hot = unique.where(F.col(count) > limit)
    if total <= limit:
        return rows.join(unique, keys, how)
    heavy = rows.join(F.broadcast(hot), keys, how)
    flags = hot.select(*keys)
    cold_rows = rows.join(F.broadcast(flags), keys, "left_anti")
    cold = cold_rows.join(unique.where(F.col(count) <= limit), keys, how)
    return heavy.unionByName(cold)
