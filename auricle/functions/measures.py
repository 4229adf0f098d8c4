"""Column expressions of measurements. Unknown is NULL in and NULL out; silence is minus infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS_INFINITY = float("-inf")


def finite(x: Column) -> Column:
    """x where it is a finite number, else NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def decibels(x: Column, factor: float = 20.0) -> Column:
    """factor * log10(x); zero and less give minus infinity, NULL stays NULL."""
    return F.when(x > 0, factor * F.log10(x)).when(x.isNotNull(), F.lit(MINUS_INFINITY))


def loudness(power: Column) -> Column:
    """LUFS of a weighted mean-square power."""
    return F.when(power > 0, -0.691 + 10 * F.log10(power)).when(power.isNotNull(), F.lit(MINUS_INFINITY))


def half_up(x: Column) -> Column:
    """Rounds half towards plus infinity."""
    return F.floor(x + 0.5)


def nearest_rank(values: Column, p: float) -> Column:
    """The element at rank floor((n - 1) * p + 0.5) of an array, once sorted; NULL for an empty one."""
    return F.get(F.array_sort(values), half_up((F.size(values) - 1) * p).cast("int"))


def upper_median(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def all_known(flag: Column) -> Column:
    """AND over a group that is unknown as soon as one member is."""
    return F.when(F.count("*") > F.count(flag), F.lit(None).cast("boolean")).otherwise(F.bool_and(flag))
