"""Null-safe numeric helpers, rule chains and rounding, all as native columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interp(x: str | Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear curve through ``knots``, flat beyond both ends, NULL stays NULL."""
    x = col(x)
    chain = F.when(x.isNull(), F.lit(None).cast("double"))
    chain = chain.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        slope = (y1 - y0) / (x1 - x0)
        chain = chain.when(x <= x1, F.lit(slope) * (x - x0) + F.lit(float(y0)))
    return chain.otherwise(F.lit(float(knots[-1][1])))


def clamp(c: str | Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Clip into [lo, hi]; NULL stays NULL although ``least`` would skip it."""
    c = col(c)
    return F.when(c.isNull(), None).otherwise(F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def min_null(a: str | Column, b: str | Column) -> Column:
    """Smaller of two values, NULL as soon as one side is NULL."""
    a, b = col(a), col(b)
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.least(a, b))


def no_nan(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.isnan(c), None).otherwise(c)


def even_round(c: str | Column, digits: int = 0) -> Column:
    """Round half to even on the binary value, as numeric tables do."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale


def half_up(c: str | Column) -> Column:
    """Whole-number rounding with halves going up."""
    return F.floor(col(c) + 0.5).cast("double")


def weighted_present_mean(parts: Sequence[tuple[Column, float | Column]]) -> Column:
    """Mean of the parts that are present, weights renormalised over those parts."""
    pairs = [(v, w if isinstance(w, Column) else F.lit(float(w))) for v, w in parts]
    num = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in pairs])
    den = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in pairs])
    return F.when(den > 0, F.try_divide(num, den))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Aggregate: weighted mean that gives NULL values no weight."""
    v, w = col(value), col(weight)
    den = F.sum(F.when(v.isNotNull(), w))
    return F.when(den > 0, F.try_divide(F.sum(v * w), den))


def first_label(rules: Sequence[tuple[Column, str]], default: str = "ok") -> Column:
    """First rule that holds names the row."""
    chain = None
    for cond, label in rules:
        chain = F.when(cond, label) if chain is None else chain.when(cond, label)
    return chain.otherwise(default) if chain is not None else F.lit(default)


def composite_flag(*flags: str | Column, good: str = "ok") -> Column:
    """First flag that is not the good one, in the order given."""
    return F.coalesce(*[F.nullif(col(f), F.lit(good)) for f in flags], F.lit(good))


def blank(c: str | Column) -> Column:
    """Missing or only spaces."""
    c = col(c)
    return c.isNull() | (F.trim(c) == "")
