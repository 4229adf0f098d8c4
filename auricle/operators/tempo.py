"""Tempo from onsets: windows of a stream are read by autocorrelation, and their readings are weighed against each other.

A window is at most as long as asked for, so what is gathered into one array is bounded; reading it needs no state and no other window.
The overall figures come from aggregations of the windows' rows. Where the evidence is weak, no tempo is established and the reason says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.operators import series

# Beats a minute that are looked for, the prior's centre and width in octaves, and limits of correlation and agreement.
MIN_BPM, MAX_BPM = 40, 220
CENTRE_BPM, OCTAVES = 120.0, 0.9
ESTABLISH, WANDERS = 0.20, 0.5
HIGH, MEDIUM = (0.25, 0.85), (0.20, 0.6)
TOLERANCE, RELIABLE = 0.10, 0.25
HALF_TIME, DOUBLE_TIME = 140, 80


def onsets(levels: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, order and onset: how much a value rises above the one before (the first rises by nothing), smoothed over three neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    rise = F.greatest(F.lit(0.0), F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))
    out = series.smooth(levels.withColumn("__rise", rise), keys, [order], "__rise")
    return out.select(*keys, order, F.col("smooth").alias("onset"))


def lags_of(n: int, fps: float) -> np.ndarray:
    """The lags that are tried in n onsets; none where they are too few."""
    low, high = max(2, int(np.floor(60 * fps / MAX_BPM))), min(n - 2, int(np.ceil(60 * fps / MIN_BPM)))
    return np.arange(low, high + 1) if high > low + 2 else np.zeros(0, int)


def _read(x: np.ndarray, fps: float) -> tuple[float, float, float] | None:
    """(beats a minute, correlation, resolution) of one window; None without a pulse."""
    lags, x = lags_of(len(x), fps), x - x.mean()
    energy = float(x @ x)
    if not len(lags) or energy <= 0:
        return None
    return chosen(lags, np.array([x[:-lag] @ x[lag:] / (len(x) - lag) for lag in lags.tolist()]) / (energy / len(x)), fps)


def chosen(lags: np.ndarray, acf: np.ndarray, fps: float) -> tuple[float, float, float] | None:
    """The reading of an autocorrelation: the best lag, with half of what is at twice the lag, by the prior, refined between its neighbours."""
    low, high = int(lags[0]), int(lags[-1])
    twice = np.where(2 * lags <= high, acf[np.minimum(2 * lags, high) - low], 0.0)
    score = (acf + 0.5 * twice) * np.exp(-0.5 * (np.log2(60 * fps / lags / CENTRE_BPM) / OCTAVES) ** 2)
    best = int(np.argmax(np.round(score, 12)))
    if score[best] <= 0:
        return None
    at = float(lags[best])
    if 0 < best < len(lags) - 1 and (bend := acf[best - 1] - 2 * acf[best] + acf[best + 1]) != 0:
        shift = 0.5 * (acf[best - 1] - acf[best + 1]) / bend
        at += shift if abs(shift) <= 1 else 0.0
    return 60 * fps / at, float(acf[best]), 60 * fps / lags[best] - 60 * fps / (lags[best] + 1)


FOUND = "bpm double, correlation double, resolution double"


def _found(rows: list[tuple[float, float, float] | None]) -> pa.Array:
    fields = ["bpm", "correlation", "resolution"]
    return pa.StructArray.from_arrays([pa.array([None if f is None else f[i] for f in rows], pa.float64()) for i in range(3)], names=fields, mask=pa.array([f is None for f in rows], pa.bool_()))


def estimate(values: Column, fps: float | Column) -> Column:
    """bpm, correlation and resolution of arrays of onsets, so many a second; NULL where no pulse was found."""

    @F.arrow_udf(FOUND)
    def run(v: pa.Array, rate: pa.Array) -> pa.Array:
        return _found([None if x is None else _read(np.array(x, float), r) for x, r in zip(v.to_pylist(), rate.to_pylist())])

    return run(values, fps if isinstance(fps, Column) else F.lit(float(fps)))


def whole(signal: DataFrame, keys: list[str], at: str, chunk: int) -> DataFrame:
    """keys, n, bpm, correlation and resolution of whole signals (with fps among the keys), however long: products of onsets a lag apart are summed by chunks, each of which
    has the longest lag's onsets behind it; what meets for a signal is one number a lag."""
    w = Window.partitionBy(*keys)
    rows = signal.withColumns({"__n": F.count("*").over(w), "__x": F.col("onset") - F.avg("onset").over(w)})
    longest = int(np.ceil(60 * 1000 / MIN_BPM))  # of a thousand onsets a second, more than any signal has
    behind = F.least(F.lit(longest), F.ceil(60 * F.col("fps") / MIN_BPM))
    cut = series.sliding(rows.withColumn("__size", chunk + behind), at, F.col("__size"), chunk)
    cut = cut.groupBy(*keys, "window", "__n").agg(F.array_sort(F.collect_list(F.struct(at, "__x"))).alias("v"))

    @F.arrow_udf("array<double>")
    def products(v: pa.Array, n: pa.Array, fps: pa.Array) -> pa.Array:
        """The energy, then a sum for each lag."""
        out = []
        for x, total, rate in zip(v.to_pylist(), n.to_pylist(), fps.to_pylist()):
            x = np.array(x, float)
            own = x[:chunk]
            out.append([float(own @ own), *(float(own[: max(0, len(x) - lag)] @ x[lag : lag + chunk]) for lag in lags_of(total, rate).tolist())])
        return pa.array(out, pa.list_(pa.float64()))

    sums = cut.select(*keys, "__n", F.posexplode(products(F.transform("v", lambda x: x["__x"]), "__n", F.col("fps"))).alias("i", "s")).groupBy(*keys, "__n", "i").agg(F.sum("s").alias("s"))
    sums = sums.groupBy(*keys, "__n").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v"))

    @F.arrow_udf(FOUND)
    def read(v: pa.Array, n: pa.Array, fps: pa.Array) -> pa.Array:
        out = []
        for x, total, rate in zip(v.to_pylist(), n.to_pylist(), fps.to_pylist()):
            lags, (energy, *s) = lags_of(total, rate), x
            out.append(chosen(lags, np.array(s) / (total - lags) / (energy / total), rate) if len(lags) and energy > 0 else None)
        return _found(out)

    out = sums.select(*keys, F.col("__n").alias("n"), read(F.transform("v", lambda x: x["s"]), "__n", F.col("fps")).alias("r"))
    return out.select(*keys, "n", "r.bpm", "r.correlation", "r.resolution")


def windows(signal: DataFrame, keys: list[str], at: str, fps: float | Column, size: int | Column, hop: int | Column) -> DataFrame:
    """keys, window, bpm, correlation and resolution of every full window of `size` onsets, one every `hop`; bpm is NULL without a pulse. Figures that are columns are of the keys."""
    cut = series.sliding(signal, at, size, hop).groupBy(*keys, "window").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(at, "onset"))).alias("v")).where(F.col("n") == size)
    read = cut.select(*keys, "window", estimate(F.transform("v", lambda x: x["onset"]), fps).alias("r"))
    return read.select(*keys, F.col("window").cast("long").alias("window"), "r.bpm", "r.correlation", "r.resolution")


def folded(bpm: Column, reference: Column) -> Column:
    """The tempo, its half or its double (within the limits), whichever is nearest the reference in octaves; the first of equals."""
    far = lambda m: F.when((m == 1) | (bpm * m).between(MIN_BPM, MAX_BPM), F.struct(F.abs(F.log2(bpm * m / reference)).alias("far"), F.lit({1: 0, 0.5: 1, 2: 2}[m]).alias("i"), (bpm * m).alias("bpm")))
    return F.array_min(F.filter(F.array(*(far(m) if m != 1 else F.struct(F.abs(F.log2(bpm / reference)).alias("far"), F.lit(0).alias("i"), (bpm * 1.0).alias("bpm")) for m in (1, 0.5, 2))), lambda x: x.isNotNull()))["bpm"]


def placed(found: DataFrame, keys: list[str]) -> DataFrame:
    """The windows that have a tempo, folded towards the middle one: keys, window, bpm, correlation, and whether a pulse was found and the window is reliable."""
    own = found.where("bpm IS NOT NULL")
    near = own.join(series.order_statistics(own, keys, "bpm", reference=series.upper_middle).drop("n"), keys).withColumn("bpm", folded(F.col("bpm"), F.col("reference")))
    pulse = F.col("correlation") >= ESTABLISH
    return near.select(*keys, "window", "bpm", "correlation", pulse.alias("pulse"), (pulse & (F.abs(F.col("bpm") - F.col("reference")) / F.col("reference") < RELIABLE)).alias("reliable"))


def established(found: DataFrame, overall: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The tempo of whole signals: overall is whole(), found their windows(), with fps among the keys. bpm is the windows' middle where three of them or more speak for it, else that of the whole; correlation and agreement
    come from the windows where there are any. Below `least` seconds nothing is established."""
    near = shared.stored(placed(found, keys), "placed-windows")
    middle = lambda value, name: series.order_statistics(near if value == "bpm" else found.where("correlation IS NOT NULL"), keys, value, **{name: series.upper_middle}).drop("n")
    near = near.join(middle("bpm", "centre"), keys)
    far = F.abs(F.col("bpm") - F.col("centre")) / F.col("centre")
    sums = near.groupBy(*keys, "centre").agg(
        F.count("*").alias("placed"), F.avg((far <= TOLERANCE).cast("int")).alias("agreement"),
        *(f(F.when(F.col(c), F.col("bpm"))).alias(f"{name}_{c}") for c in ("pulse", "reliable") for name, f in (("n", F.count), ("low", F.min), ("high", F.max))),
    )
    whole_ = overall.select(*keys, "n", F.col("bpm").alias("o_bpm"), F.col("correlation").alias("o_correlation"), F.col("resolution"))
    out = whole_.join(sums, keys, "left").join(middle("correlation", "w_correlation"), keys, "left")
    c = F.col
    seconds = c("n") / c("fps")
    correlation, agreement, centre = F.coalesce("w_correlation", "o_correlation"), F.coalesce("agreement", F.lit(0.0)), F.coalesce("centre", "o_bpm")
    fit = F.coalesce((seconds >= least) & c("o_bpm").isNotNull() & (correlation >= ESTABLISH), F.lit(False))
    wanders = agreement < WANDERS
    pick = lambda name: F.when(wanders, c(f"{name}_pulse")).otherwise(c(f"{name}_reliable"))
    many = F.coalesce(pick("n") >= 3, F.lit(False))
    moves = many & (pick("high") - pick("low") > F.greatest(2 * c("resolution"), F.lit(1.5)))
    bpm = F.when(many, centre).otherwise(c("o_bpm"))
    grade = F.when(wanders, "low").when((correlation >= HIGH[0]) & (agreement >= HIGH[1]), "high").when((correlation >= MEDIUM[0]) & (agreement >= MEDIUM[1]), "medium").otherwise("low")
    reason = F.when(seconds < least, "too short").when(c("o_bpm").isNull(), "no repeating pulse").when(~fit, "not regular enough")
    feel = F.when(bpm >= HALF_TIME, bpm / 2).when((bpm <= DOUBLE_TIME) & (bpm * 2 <= MAX_BPM), bpm * 2)
    return out.select(
        *keys, fit.alias("established"), F.when(fit, bpm).alias("bpm"), F.when(seconds >= least, correlation).alias("correlation"), F.when(fit, agreement).alias("agreement"), F.when(fit, grade).alias("confidence"), F.when(fit, wanders).alias("wanders"),
        F.when(fit, ~wanders & ~moves).alias("steady"), F.when(fit & moves, pick("low")).alias("least"), F.when(fit & moves, pick("high")).alias("greatest"), F.when(fit, feel).alias("feel"), F.coalesce("placed", F.lit(0).cast("long")).alias("placed"), reason.alias("reason"),
    )


def readings(found: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key: windows, placed ones, bpm (the middle one), correlation, agreement, established, wanders, confidence, steady, least and greatest tempo of
    reliable windows, the other way of counting, and why no tempo is established."""
    placed = found.where("bpm IS NOT NULL")
    middle = lambda df, value, name: series.order_statistics(df, keys, value, **{name: series.upper_middle}).drop("n")
    near = placed.join(middle(placed, "bpm", "reference"), keys).withColumn("bpm", folded(F.col("bpm"), F.col("reference")))
    near = near.join(middle(near, "bpm", "centre"), keys)
    pulse = F.col("correlation") >= ESTABLISH
    reliable = pulse & (F.abs(F.col("bpm") - F.col("reference")) / F.col("reference") < RELIABLE)
    sums = near.groupBy(*keys, "centre").agg(
        F.count("*").alias("placed"),
        (F.count_if(F.abs(F.col("bpm") - F.col("centre")) / F.col("centre") <= TOLERANCE) / F.count("*")).alias("agreement"),
        F.count_if(reliable).alias("n_reliable"), F.count_if(pulse).alias("n_pulse"),
        F.min(F.when(reliable, F.col("bpm"))).alias("low_reliable"), F.max(F.when(reliable, F.col("bpm"))).alias("high_reliable"),
        F.min(F.when(pulse, F.col("bpm"))).alias("low_pulse"), F.max(F.when(pulse, F.col("bpm"))).alias("high_pulse"),
        F.min("resolution").alias("resolution"),
    )
    out = found.groupBy(*keys).agg(F.count("*").alias("windows")).join(sums, keys, "left").join(middle(placed, "correlation", "correlation"), keys, "left")
    established = F.coalesce(F.col("correlation") >= ESTABLISH, F.lit(False))
    wanders = F.col("agreement") < WANDERS
    pick = lambda name: F.when(wanders, F.col(f"{name}_pulse")).otherwise(F.col(f"{name}_reliable"))
    floor = F.greatest(2 * F.col("resolution"), F.lit(1.5))
    spread = F.when(pick("n") >= 3, pick("high") - pick("low"))
    c = F.col
    grade = F.when(wanders, "low").when((c("correlation") >= HIGH[0]) & (c("agreement") >= HIGH[1]), "high").when((c("correlation") >= MEDIUM[0]) & (c("agreement") >= MEDIUM[1]), "medium").otherwise("low")
    return out.select(
        *keys, "windows", F.coalesce("placed", F.lit(0).cast("long")).alias("placed"), c("centre").alias("bpm"), "correlation", "agreement", established.alias("established"),
        F.when(established, wanders).alias("wanders"), F.when(established, grade).alias("confidence"), F.when(established, ~wanders & ~F.coalesce(spread > floor, F.lit(False))).alias("steady"),
        F.when(established & (spread > floor), pick("low")).alias("least"), F.when(established & (spread > floor), pick("high")).alias("greatest"),
        F.when(established & (c("centre") >= HALF_TIME), c("centre") / 2).when(established & (c("centre") <= DOUBLE_TIME) & (c("centre") * 2 <= MAX_BPM), c("centre") * 2).alias("feel"),
        F.when(established, F.lit(None)).when(c("placed").isNull(), "no repeating pulse").otherwise("not regular enough").alias("reason"),
    )
