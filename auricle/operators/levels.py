"""Level statistics of sample streams: peak, RMS, offset, silence, full-scale runs, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions.measures import all_known, decibels, finite


def framed(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds frame, the sample's number in its stream from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return samples.withColumn("frame", (F.row_number().over(w) - 1).cast("long"))


def channel_levels(samples: DataFrame, keys: list[str], value: str = "x", full_scale: float = 1.0) -> DataFrame:
    """Per stream, over its finite samples: counts, peak, rms, offset and their decibels. All of it combines before the shuffle."""
    x = finite(F.col(value))
    out = samples.groupBy(*keys).agg(
        F.count("*").alias("frames"),
        F.count(x).alias("finite_frames"),
        (F.count("*") - F.count(x)).alias("non_finite"),
        F.max(F.abs(x)).alias("peak"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.avg(x).alias("dc_offset"),
        F.count_if(F.abs(x) >= full_scale).alias("full_scale_frames"),
        F.bool_and(x == 0).alias("digital_silence"),
    )
    return out.withColumns({"peak_dbfs": decibels(F.col("peak")), "rms_dbfs": decibels(F.col("rms"))})


def overall(levels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Levels of files from those of their channels: the largest peak, and the root of the mean square over channels, each counted once."""
    return levels.groupBy(*(keys or [])).agg(
        F.count("*").alias("channels"),
        F.max("peak").alias("peak"),
        F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"),
        F.sum("non_finite").alias("non_finite"),
        all_known(F.col("digital_silence")).alias("digital_silence"),
    )


def peak_position(framed_samples: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """The earliest frame at the largest magnitude."""
    x = F.abs(finite(F.col(value)))
    return framed_samples.where(x.isNotNull()).groupBy(*keys).agg(F.max(x).alias("peak"), F.max_by("frame", F.struct(x, -F.col("frame"))).alias("peak_frame"))


def longest_runs(samples: DataFrame, keys: list[str], order: list[str], value: str = "x", full_scale: float = 1.0) -> DataFrame:
    """The longest run of neighbouring samples at or above full scale; a sample that is not finite ends a run.

    One sort: the number of quiet samples before a loud one names its run."""
    loud = F.coalesce(F.abs(finite(F.col(value))) >= full_scale, F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = samples.withColumn("loud", loud).withColumn("run", F.sum((~F.col("loud")).cast("long")).over(w))
    lengths = runs.groupBy(*keys, "run").agg(F.count_if("loud").alias("n"))
    return lengths.groupBy(*keys).agg(F.max("n").alias("longest_run"))


def probed(framed_samples: DataFrame, keys: list[str], probes: int, limit: int) -> DataFrame:
    """The samples of evenly spaced probes of each stream of over `limit` frames; shorter streams whole."""
    per = limit // probes
    n = F.count("*").over(Window.partitionBy(*keys))
    stride = F.floor((F.col("n") - per) / (probes - 1))
    probe = F.least(F.floor(F.col("frame") / stride), F.lit(probes - 1))
    inside = F.col("frame") - F.least(probe * stride, F.col("n") - per) < per
    return framed_samples.withColumn("n", n).where((F.col("n") <= limit) | inside).drop("n")


def flag(condition: Column) -> Column:
    """A condition as 0 or 1, unknown as 0."""
    return F.coalesce(condition.cast("long"), F.lit(0).cast("long"))
