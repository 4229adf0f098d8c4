"""Places of all rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A table of so many rows (a few numbers and a short text each) is sent to all executors; a longer one is joined by a shuffle.
SMALL_ROWS = 100_000
#: Bits of monotonically_increasing_id that count the rows of a partition.
IN_PART = 33


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has few rows. df should be stored: it is counted."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equal columns, null equal to null."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """df with `name`, each row's place from 0 in the order of its group. `order` begins with the groups' columns and should tell all rows apart,
    so that no partition outgrows the others.

    Rows are range-partitioned and sorted once; a row's place is its place in its partition plus the number of its group's rows in the partitions
    before, which is one small row for each partition and group."""
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    own = common.stored(own, "ordered").withColumn("__part", F.shiftright("__at", IN_PART))
    runs = own.groupBy("__part", *groups).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # a group has as many rows here as Spark has partitions at most, so their running sum fits a task
    w = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = common.stored(runs.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n"), "places")
    joined = own.join(small(before), same(own, before, ["__part", *groups]))
    return joined.select(*(own[c] for c in df.columns), (own["__at"] - before["__first"] + before["__before"]).alias(name))
