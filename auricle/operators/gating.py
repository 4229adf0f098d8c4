"""Loudness of blocks: 100 ms sub-blocks, momentary and short-term windows, gated means, range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions.measures import loudness
from auricle.operators import series

MOMENTARY, SHORT_TERM = 4, 30
ABSOLUTE_GATE, RELATIVE_GATE, RANGE_GATE = -70.0, -10.0, -20.0


def channel_weight(name: Column, low_frequency: list[str], surround: list[str]) -> Column:
    """0 for low-frequency channels, 1.41 for surround ones, else 1."""
    return F.when(name.isin(*low_frequency), 0.0).when(name.isin(*surround), 1.41).otherwise(1.0)


def sub_blocks(framed: DataFrame, keys: list[str], frames: int, value: str = "x") -> DataFrame:
    """Sum of (weighted) squares of each full sub-block of `frames` frames; a partial tail is dropped."""
    block = F.floor(F.col("frame") / frames).alias("block")
    out = framed.groupBy(*keys, block).agg(F.sum(F.col("weight") * F.col(value) * F.col(value) if "weight" in framed.columns else F.col(value) * F.col(value)).alias("power"), F.count("*").alias("n"))
    return out.where(F.col("n") == frames).drop("n")


def rolling(blocks: DataFrame, keys: list[str], size: int, frames: int) -> DataFrame:
    """Mean power of every `size` neighbouring sub-blocks."""
    w = Window.partitionBy(*keys).orderBy("block")
    over = w.rowsBetween(-(size - 1), 0)
    out = blocks.select(*keys, "block", (F.sum("power").over(over) / (size * frames)).alias("power"), F.row_number().over(w).alias("rn"))
    return out.where(F.col("rn") >= size).drop("rn")


def _gated(blocks: DataFrame, keys: list[str], relative: float) -> DataFrame:
    """Blocks above the absolute gate and above the gate relative to the mean of those, with that gate."""
    own = blocks.withColumn("lufs", loudness(F.col("power"))).where(F.col("lufs") > ABSOLUTE_GATE)
    mean = F.avg("power").over(Window.partitionBy(*keys))
    return own.withColumn("gate", loudness(mean) + relative).where(F.col("lufs") > F.col("gate"))


def integrated(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Two-stage gated loudness; streams without a block above the gates have NULL."""
    total = blocks.groupBy(*keys).agg(F.count("*").alias("blocks_total"))
    used = _gated(blocks, keys, RELATIVE_GATE).groupBy(*keys).agg(loudness(F.avg("power")).alias("integrated"), F.count("*").alias("blocks_used"), F.max("gate").alias("gate"))
    return total.join(used, keys, "left").withColumn("blocks_used", F.coalesce("blocks_used", F.lit(0).cast("long")))


def loudness_range(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """95th less 10th percentile (nearest rank) of the gated short-term blocks; fewer than two have none."""
    found = series.order_statistics(_gated(blocks, keys, RANGE_GATE), keys, "lufs", high=series.nearest_place(0.95), low=series.nearest_place(0.10))
    return found.where("n >= 2").select(*keys, F.col("n").alias("blocks"), (F.col("high") - F.col("low")).alias("range_lu"))
