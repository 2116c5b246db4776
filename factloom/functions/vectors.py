"""Vector columns: validity and cosine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def valid_vector(c: Column, dims: int) -> Column:
    """Right length and finite; array_max and array_min run in generated code, NaN is the greatest."""
    top, low, bound = F.array_max(c), F.array_min(c), F.lit(float("inf"))
    return F.coalesce(c.isNotNull() & (F.size(c) == dims) & (F.size(F.array_compact(c)) == dims)
                      & ~F.isnan(top) & (top.cast("double") < bound) & (low.cast("double") > -bound), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable_vector(c: Column) -> Column:
    """Finite numbers of any count, not all of them zero."""
    top, low = F.array_max(c), F.array_min(c)
    infinite = F.lit(float("inf"))
    ok = (F.size(c) > 0) & (F.size(F.array_compact(c)) == F.size(c)) & ~F.isnan(top) & (top < infinite) & (low > -infinite) & ((top != 0) | (low != 0))
    return F.coalesce(ok, F.lit(False))
