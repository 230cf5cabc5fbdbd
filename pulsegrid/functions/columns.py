"""Column expressions that several operators share. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmin_between(values: Column, start: Column, end: Column) -> Column:
    """First place of the least value in [start, end) after clamping to the array; ``start`` (clamped) if that is empty."""
    size = F.size(values)
    lo = F.least(F.greatest(start, F.lit(0)), size)
    n = F.greatest(F.least(end, size) - lo, F.lit(0))
    part = F.slice(values, lo + 1, n)
    return F.when(n <= 0, lo).otherwise(lo + F.array_position(part, F.array_min(part)).cast("int") - 1)


def between(values: Column, first: Column, last: Column) -> Column:
    """The values at first..last, both included."""
    return F.slice(values, first + 1, F.greatest(last - first + 1, F.lit(0)))


def steps(values: Column) -> Column:
    """Differences of neighbours."""
    return F.transform(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda v, i: F.get(values, i + 1) - v)


def usable(value: Column) -> Column:
    """The value as double, or null where it is missing, NaN or infinite."""
    d = value.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def percent_variation(mean: Column, spread: Column) -> Column:
    return F.when(mean != 0, 100.0 * spread / mean)


def clamp(value: Column, low, high) -> Column:
    """The value within [low, high]; null stays null, which least and greatest would skip."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, as an aggregate; null without spread in one of them, where the built-in one fails."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def slope(b: Column, a: Column) -> Column:
    """Of the regression of b on a, as an aggregate; null without spread in a."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.var_pop(a), F.lit(0.0)))
