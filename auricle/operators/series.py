"""Operators on ordered series: smoothing, whitening, change, windows, correlation, spectra."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smooth(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds smooth: a quarter, a half and a quarter of three neighbours, zeros beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("smooth", 0.25 * F.lag(value, 1, 0.0).over(w) + 0.5 * F.col(value) + 0.25 * F.lead(value, 1, 0.0).over(w))


def rectify(df: DataFrame, keys: list[str], order: list[str], value: str, reach: int) -> DataFrame:
    """Adds rectified: what lies above the mean of the neighbours within reach."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn("rectified", F.greatest(F.lit(0.0), F.col(value) - F.avg(value).over(w)))


def rectify_by(df: DataFrame, keys: list[str], at: str, value: str, reach: Column) -> DataFrame:
    """As rectify, with a reach (below 1,000) that may differ by key: places are stretched so that the same range of numbers is the reach of each."""
    span = 1_000_000
    w = Window.partitionBy(*keys).orderBy(F.col(at).cast("long") * F.floor(F.lit(span) / reach).cast("long")).rangeBetween(-span, span)
    return df.withColumn("rectified", F.greatest(F.lit(0.0), F.col(value) - F.avg(value).over(w)))


def runs(df: DataFrame, keys: list[str], at: str, label: str, **figures: Column) -> DataFrame:
    """keys, label, from, to and n of each run of neighbouring rows with the same label, with any aggregates asked for; rows without a label are in no run and bridge nothing."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = ~F.coalesce(F.col(label) == F.lag(label).over(w), F.lit(False))
    rows = df.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.where(F.col(label).isNotNull()).groupBy(*keys, "__run", label)
    return out.agg(F.min(at).alias("from"), F.max(at).alias("to"), F.count("*").alias("n"), *(x.alias(name) for name, x in figures.items())).drop("__run")


def unit_deviation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds scaled: the value over its population deviation; a constant series stays."""
    sd = F.stddev_pop(value).over(Window.partitionBy(*keys))
    return df.withColumn("scaled", F.when(sd > 0, F.col(value) / sd).otherwise(F.col(value)))


def sliding(df: DataFrame, at: str, size: int, hop: int) -> DataFrame:
    """A row for each window (numbered from 0, starting every hop) that holds the row."""
    last = F.floor(F.col(at) / hop)
    first = F.greatest(F.lit(0), F.floor((F.col(at) - size) / hop) + 1)
    return df.withColumn("window", F.explode(F.sequence(first, last)))


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows above the one before and not below the one after, with the refined place and height of a parabola through the three."""
    w = Window.partitionBy(*keys).orderBy(order)
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    near = df.withColumns({"before": a, "after": c}).where((b > F.col("before")) & (b >= F.col("after")))
    bend = F.col("before") - 2 * b + F.col("after")
    shift = F.when(bend != 0, 0.5 * (F.col("before") - F.col("after")) / bend).otherwise(0.0)
    return near.withColumn("shift", F.when(F.abs(shift) <= 1, shift).otherwise(0.0)).drop("before", "after")


def centred(values: Column) -> Column:
    """An array less its mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.transform(values, lambda x: x - mean)


def autocorrelation(values: Column, lag: Column | int) -> Column:
    """Mean product of an array's values `lag` apart, over its mean square."""
    n = F.size(values)
    lag = lag if isinstance(lag, Column) else F.lit(lag)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ahead, behind = F.slice(values, lag + 1, F.greatest(n - lag, F.lit(0))), F.slice(values, 1, F.greatest(n - lag, F.lit(0)))
    zero = dot(values, values) / n
    return F.when((n > lag) & (zero > 0), dot(ahead, behind) / (n - lag) / zero)


def _rows(values: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A batch of arrays as the rows of a matrix, short ones filled with zeros, and their lengths; NULL is an empty one."""
    length = np.nan_to_num(np.array(pc.list_value_length(values).to_numpy(zero_copy_only=False), float)).astype(int)
    width = size or max(1, int(length.max(initial=0)))
    out = np.zeros((len(length), width))
    inside = np.arange(width) < length[:, None]
    if size:
        kept = np.concatenate([np.arange(min(n, size)) + at for n, at in zip(length, np.cumsum(length) - length)] or [np.zeros(0, int)]).astype(int)
        out[inside] = values.flatten().to_numpy(zero_copy_only=False)[kept]
    else:
        out[inside] = values.flatten().to_numpy(zero_copy_only=False)
    return out, length


def _arrays(rows: np.ndarray, length: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[np.arange(rows.shape[1]) < length[:, None]]))


def autocorrelations(values: Column, low: int, high: int) -> Column:
    """autocorrelation() of arrays less their means at all lags from low to high, as an array: all arrays of a batch take each lag together."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        rows, length = _rows(v)
        inside = np.arange(rows.shape[1]) < length[:, None]
        rows = np.where(inside, rows - (rows.sum(axis=1) / np.maximum(length, 1))[:, None], 0.0)
        zero = (rows * rows).sum(axis=1) / np.maximum(length, 1)
        out = []
        for lag in range(low, high + 1):
            left = length - lag
            dot = (rows[:, : max(0, rows.shape[1] - lag)] * rows[:, lag:]).sum(axis=1)
            out.append(np.divide(dot, left * zero, out=np.full(len(rows), np.nan), where=(left > 0) & (zero > 0)))
        table = np.array(out).T
        return pa.array([[None if np.isnan(x) else x for x in row] for row in table.tolist()], pa.list_(pa.float64()))

    return run(values)


def magnitudes(values: Column, size: int) -> Column:
    """Magnitudes of all size // 2 + 1 bins of the Hann-windowed Fourier transform of an array's first `size` samples (zeros beyond its end)."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        rows, length = _rows(v, size)
        return _arrays(np.abs(np.fft.rfft(rows * hann, axis=1)), np.full(len(length), size // 2 + 1))

    return run(values)


def biquad(values: Column, *stages: tuple[float, float, float, float, float]) -> Column:
    """Direct form I filters (b0, b1, b2, a1, a2) over an array, one after the other; all arrays of a batch take each step together."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        x, length = _rows(v)
        for b0, b1, b2, a1, a2 in stages:
            y = np.zeros_like(x)
            for i in range(x.shape[1]):
                y[:, i] = b0 * x[:, i]
                if i > 0:
                    y[:, i] += b1 * x[:, i - 1] - a1 * y[:, i - 1]
                if i > 1:
                    y[:, i] += b2 * x[:, i - 2] - a2 * y[:, i - 2]
            x = y
        return _arrays(x, length)

    return run(values)


def order_statistics(df: DataFrame, keys: list[str], value: str, **places: Callable[[Column], Column]) -> DataFrame:
    """n and, for each name, the value at a place (from 1, a function of n) of each group's sorted values; NULLs do not count.

    Equal values are counted before anything is sorted, and no group is gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__times"))
    w = Window.partitionBy(*keys)
    upto = F.sum("__times").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumns({"__upto": upto, "__n": F.sum("__times").over(w)})
    return placed.groupBy(*keys).agg(F.first("__n").alias("n"), *(F.min(F.when(F.col("__upto") >= at(F.col("__n")), F.col(value))).alias(name) for name, at in places.items()))


def upper_middle(n: Column) -> Column:
    """The place of the upper median."""
    return F.floor(n / 2) + 1


def nearest_place(p: float) -> Callable[[Column], Column]:
    """The place of a percentile by the nearest rank."""
    return lambda n: F.floor((n - 1) * p + 0.5) + 1


def k_weighting(rate: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Coefficients (b0, b1, b2, a1, a2) of the two stages of BS.1770 K-weighting at any sample rate, by the bilinear transform."""
    # Centre frequencies, gain and Q of the two stages, and the exponent of the band gain.
    shelf_hz, gain_db, shelf_q, band = 1681.9744509555319, 3.999843853973347, 0.7071752369554193, 0.4996667741545416
    pass_hz, pass_q = 38.13547087602444, 0.5003270373238773
    t, high = math.tan(math.pi * shelf_hz / rate), 10 ** (gain_db / 20)
    mid, norm = high**band, 1 + t / shelf_q + t * t
    shelf = ((high + mid * t / shelf_q + t * t) / norm, 2 * (t * t - high) / norm, (high - mid * t / shelf_q + t * t) / norm, 2 * (t * t - 1) / norm, (1 - t / shelf_q + t * t) / norm)
    t = math.tan(math.pi * pass_hz / rate)
    norm = 1 + t / pass_q + t * t
    return shelf, (1.0, -2.0, 1.0, 2 * (t * t - 1) / norm, (1 - t / pass_q + t * t) / norm)
