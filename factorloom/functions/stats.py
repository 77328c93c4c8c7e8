"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half to even on the scaled double."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def steady(x: Column) -> Column:
    """Rounded at 1e-9, so that a sum does not depend on the order of its parts."""
    return rounded(x, 9)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def average_rank_pct(value: Column, by: Sequence[str | Column]) -> Column:
    """Rank with ties at their mean, over the number of values, times 100; rows must hold no null values."""
    over = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    rank = F.rank().over(over.orderBy(value)) + (ties - 1) / 2
    return rank / F.count(F.lit(1)).over(over) * 100


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: over rows with a value, null without weight."""
    w = F.sum(F.when(value.isNotNull(), weight))
    return F.when(w > 0, F.sum(value * weight) / w)


def quantile(x: Column, q: float) -> Column:
    """Aggregate: exact, linear between neighbours."""
    return F.percentile(x, F.lit(q))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
