"""Measures of decoded audio, block by block: loudness and true peak, the same whatever the blocks.

A block is filtered as if silence came before it. The filter is linear, so what came before only adds its ringing: the state in which a block finds the filter times
the filter's own response. A block therefore gives the state it ends in, and for each sub-block the sum of squares, the products of its output with
the responses, and the responses' own products. States are composed along a file by a scan over one small row a block; sums of squares follow as
quadratic forms. Samples are read once, by as many tasks as there are blocks.

The interpolator needs its last taps only: a block gives its inner peak and its samples at both edges, and edges of neighbours are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.functions.measures import decibels, loudness
from auricle.operators import gating, series
from auricle.sources import containers, samples

#: Samples that are filtered in lock-step with others.
CHUNK = 128
# Taps of a phase and shape of the interpolator's window; phases by sample rate (below the rate, so many).
TAPS, BETA = 12, 9.0
PHASES = ((96_000, 8), (192_000, 4), (None, 2))
SUB_SECONDS = 0.1
EXCEEDS = 1.0005

PIECE = "struct<sub:bigint,n:bigint,own:double,cross:array<double>,ring:array<double>>"
ANALYSED = f"report_id string, channel int, block long, whole boolean, last boolean, sample_rate long, n long, finite boolean, state array<double>, pieces array<{PIECE}>, inner double, sample double, head array<double>, tail array<double>"
#: Pairs of the four numbers of a state.
PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


@cache
def k_filter(rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """K-weighting as one linear system: a state s and a sample x give the output c s + d x and the state A s + b x."""
    (b0, b1, b2, a1, a2), (d0, d1, d2, c1, c2) = series.k_weighting(rate)

    def step(s: np.ndarray, x: float) -> tuple[np.ndarray, float]:
        y = b0 * x + s[0]
        z = d0 * y + s[2]
        return np.array([b1 * x - a1 * y + s[1], b2 * x - a2 * y, d1 * y - c1 * z + s[3], d2 * y - c2 * z]), z

    units = [step(e, 0.0) for e in np.eye(4)]
    b, d = step(np.zeros(4), 1.0)
    return np.array([u[0] for u in units]).T, b, np.array([u[1] for u in units]), d


@cache
def responses(rate: float, n: int) -> np.ndarray:
    """(n, 4): the output at each time that each number of the state gives by itself."""
    a, _, c, _ = k_filter(rate)
    out, row, have = np.zeros((n, 4)), c[None], 1
    step = a
    while have < n:  # doubles what is known
        row = np.vstack([row, row @ step])
        step, have = step @ step, 2 * have
    out[:] = row[:n]
    return out


def filtered(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's output, and the state it ends in, when it begins in silence."""
    a, b, c, d = k_filter(rate)
    rows, n = x.shape
    full = n // CHUNK
    y = np.empty_like(x)
    state = np.zeros((rows, 4))

    def run(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, s = np.empty_like(part), np.zeros((len(part), 4))
        for t in range(part.shape[1]):
            v = part[:, t]
            out[:, t] = s @ c + d * v
            s = s @ a.T + v[:, None] * b
        return out, s

    if full:
        out, ends = run(x[:, : full * CHUNK].reshape(rows * full, CHUNK))
        over, ends = np.linalg.matrix_power(a, CHUNK).T, ends.reshape(rows, full, 4)
        starts = np.empty((rows, full, 4))
        for k in range(full):
            starts[:, k] = state
            state = state @ over + ends[:, k]
        y[:, : full * CHUNK] = (out + starts.reshape(-1, 4) @ responses(rate, CHUNK).T).reshape(rows, -1)
    if n > full * CHUNK:
        out, end = run(x[:, full * CHUNK :])
        left = n - full * CHUNK
        y[:, full * CHUNK :] = out + state @ responses(rate, CHUNK)[:left].T
        state = state @ np.linalg.matrix_power(a, left).T + end
    return y, state


def phases_of(rate: int) -> int:
    """How many points between two samples the true peak looks at."""
    return next(n for below, n in PHASES if below is None or rate < below)


@cache
def interpolator(factor: int) -> np.ndarray:
    """(factor, TAPS): a windowed sinc by phase, newest sample first, each phase of unit gain for a constant."""
    n = factor * TAPS
    raw = np.sinc((np.arange(n) - (n - 1) / 2) / factor) * np.kaiser(n, BETA)
    rows = raw.reshape(TAPS, factor).T
    return rows / rows.sum(axis=1, keepdims=True)


def between(x: np.ndarray, rate: int) -> float:
    """The largest magnitude between the samples that have TAPS - 1 others before them; 0 if there are none."""
    if len(x) < TAPS:
        return 0.0
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    return float(np.abs(windows @ interpolator(phases_of(rate))[:, ::-1].T).max())


def sub_frames(rate: int) -> int:
    return max(1, int(np.floor(rate * SUB_SECONDS + 0.5)))


def _analysed_block(row: dict) -> Iterator[tuple]:
    x, rate, first = samples.decoded(row)[:, row["lead"] : row["lead"] + row["own"]], row["sample_rate"], row["first"]
    good = np.isfinite(x)
    clean, n = np.where(good, x, 0.0), x.shape[1]
    sub = sub_frames(rate)
    y, ends = filtered(clean, rate)
    ring = responses(rate, n)
    numbers = np.arange(first // sub, (first + n - 1) // sub + 1)
    edges = np.maximum(numbers * sub - first, 0)
    counts = np.diff(np.append(edges, n))
    products = np.add.reduceat(np.stack([ring[:, i] * ring[:, j] for i, j in PAIRS], axis=1), edges, axis=0)
    for channel, own in enumerate(y):
        power = np.add.reduceat(own * own, edges)
        cross = np.add.reduceat(own[:, None] * ring, edges, axis=0)
        pieces = [{"sub": int(s), "n": int(k), "own": float(p), "cross": q.tolist(), "ring": r.tolist()} for s, k, p, q, r in zip(numbers, counts, power, cross, products)]
        v = clean[channel]
        yield row["report_id"], channel, row["block"], row["whole"], row["last"], rate, n, bool(good[channel].all()), ends[channel].tolist(), pieces, between(v, rate), float(np.abs(v).max()), v[: TAPS - 1].tolist(), v[-(TAPS - 1) :].tolist()


def analysed(blocks: DataFrame) -> DataFrame:
    """What each block of each channel gives to loudness and true peak, in one pass over the samples; kept in the shared folder, so that all that reads it has that pass once."""
    piece = pa.struct([("sub", pa.int64()), ("n", pa.int64()), ("own", pa.float64()), ("cross", pa.list_(pa.float64())), ("ring", pa.list_(pa.float64()))])
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(piece), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = ["report_id", "channel", "block", "whole", "last", "sample_rate", "n", "finite", "state", "pieces", "inner", "sample", "head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from containers.together((x for row in samples.rows(batches) for x in _analysed_block(row)), kinds, names)

    return shared.stored(blocks.mapInArrow(run, ANALYSED), "analysed")


def _scan(rate: Column, ns: Column, states: Column) -> Column:
    """The states in which the blocks of a channel, in order, find the filter; many channels share a batch."""

    @F.arrow_udf("array<array<double>>")
    def run(rates: pa.Array, ns: pa.Array, states: pa.Array) -> pa.Array:
        found, powers = [], {}
        for hz, sizes, own in zip(rates.to_pylist(), ns.to_pylist(), states.to_pylist()):
            state, out = np.zeros(4), [[0.0] * 4]
            for n, ends in zip(sizes[:-1], own[:-1]):
                if (hz, n) not in powers:
                    powers[hz, n] = np.linalg.matrix_power(k_filter(hz)[0], n)
                state = powers[hz, n] @ state + np.array(ends)
                out.append(state.tolist())
            found.append(out)
        return pa.array(found, pa.list_(pa.list_(pa.float64())))

    return run(rate, ns, states)


def weight(name: Column) -> Column:
    """What a channel's power counts: nothing for low-frequency effects, more for those behind the listener, 1 where names are unknown."""
    return gating.channel_weight(F.coalesce(name, F.lit("")), ["LFE"], ["BL", "BR", "SL", "SR"])


def sub_blocks(found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """report_id, block (the number of a full sub-block), power (weighted, of all channels) and frames of each sub-block. found: rows of analysed();
    names: report_id and channel_names, an array or NULL, where layouts are known."""
    lists = found.where("whole").groupBy("report_id", "channel").agg(F.first("sample_rate").alias("sample_rate"), F.array_sort(F.collect_list(F.struct("block", "n", "state"))).alias("v"))
    each = lambda name: F.transform("v", lambda x: x[name])
    scanned = lists.select("report_id", "channel", F.explode(F.arrays_zip(each("block").alias("block"), _scan(F.col("sample_rate"), each("n"), each("state")).alias("found"))).alias("x"))
    states = scanned.select("report_id", "channel", "x.block", "x.found")
    rows = found.where("whole").select("report_id", "channel", "block", "sample_rate", F.explode("pieces").alias("p")).join(states, ["report_id", "channel", "block"])
    s, p = F.col("found"), F.col("p")
    power = p["own"]
    for i in range(4):
        power = power + 2 * s[i] * p["cross"][i]
    for k, (i, j) in enumerate(PAIRS):
        power = power + (1 if i == j else 2) * s[i] * s[j] * p["ring"][k]
    rows = rows.select("report_id", "channel", "sample_rate", p["sub"].alias("sub"), p["n"].alias("n"), power.alias("power"))
    if names is not None:
        rows = rows.join(names.select("report_id", "channel_names"), "report_id", "left").withColumn("power", F.col("power") * weight(F.get("channel_names", F.col("channel"))))
    frames = F.greatest(F.lit(1), F.floor(F.col("sample_rate") * SUB_SECONDS + 0.5))
    sums = rows.groupBy("report_id", F.col("sub").alias("block"), frames.alias("frames")).agg(F.sum("power").alias("power"), F.sum("n").alias("n"), F.max("channel").alias("top"))
    return sums.where(F.col("n") == F.col("frames") * (F.col("top") + 1)).select("report_id", "block", F.greatest("power", F.lit(0.0)).alias("power"), "frames")


def loudness_of(found: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """For each file: seconds, integrated, gated_blocks, total_blocks, range, momentary_max and short_term_max, and reasons where integrated or range is not established.
    Files that were read in probes, or that hold samples that are no numbers, have none of these, and reasons."""
    keys = ["report_id"]
    subs = shared.stored(sub_blocks(found, names), "sub-blocks")
    momentary = gating.rolling(subs, keys, gating.MOMENTARY, F.col("frames"))
    short = gating.rolling(subs, keys, gating.SHORT_TERM, F.col("frames"))
    whole = gating.integrated(momentary, keys).select("report_id", "integrated", F.col("blocks_used").alias("gated_blocks"), F.col("blocks_total").alias("total_blocks"))
    spread = gating.loudness_range(short, keys).select("report_id", F.col("range_lu").alias("range"))
    top = lambda df, name: df.groupBy("report_id").agg(F.max(loudness(F.col("power"))).alias(name), F.count("*").alias(f"{name}_n"))
    own = found.groupBy("report_id").agg(F.min("whole").alias("whole"), F.min("finite").alias("finite"), (F.sum(F.when(F.col("channel") == 0, F.col("n"))) / F.first("sample_rate")).alias("seconds"))
    out = own.join(whole, keys, "left").join(spread, keys, "left").join(top(momentary, "momentary_max"), keys, "left").join(top(short, "short_term_max"), keys, "left")
    fit = F.col("whole") & F.col("finite")
    unfit = F.when(~F.col("whole"), "read in probes, not whole").when(~F.col("finite"), "samples that are no numbers")
    reason = F.coalesce(unfit, F.when(F.col("total_blocks").isNull(), "shorter than a block of 400 ms").when(F.col("integrated").isNull(), "every block lies below the gate"))
    range_reason = F.coalesce(unfit, F.when(F.coalesce("short_term_max_n", F.lit(0)) < 2, "too few blocks of three seconds").when(F.col("range").isNull(), "too few blocks above the gate"))
    kept = [F.when(fit, F.col(c)).alias(c) for c in ("integrated", "gated_blocks", "total_blocks", "range", "momentary_max", "short_term_max")]
    return out.select("report_id", "seconds", *kept, reason.alias("integrated_reason"), range_reason.alias("range_reason"))


def true_peaks(found: DataFrame) -> DataFrame:
    """For each channel of each file: sample_peak, true_peak (at least the sample peak) and oversampling. NULL where blocks are missing between those that were read."""
    w = Window.partitionBy("report_id", "channel").orderBy("block")

    @F.arrow_udf("double")
    def at_edges(before: pa.Array, head: pa.Array, tail: pa.Array, last: pa.Array, rate: pa.Array) -> pa.Array:
        """Between the samples at a block's beginning, which need those before it, and, in the last block, those that leave the interpolator when zeros follow."""
        out, rest = [], np.zeros(TAPS)
        for b, h, t, end, hz in zip(*(x.to_pylist() for x in (before, head, tail, last, rate))):
            b = np.concatenate([np.zeros(TAPS - 1), b or []])[-(TAPS - 1) :]
            peak = between(np.concatenate([b, h]), hz)
            if end:
                peak = max(peak, between(np.concatenate([np.concatenate([b, t])[-(TAPS - 1) :], rest]), hz))
            out.append(peak)
        return pa.array(out, pa.float64())

    # a block has TAPS - 1 samples at least, but for the last one
    edges = found.where("whole").select("report_id", "channel", "block", "last", "sample_rate", "inner", "sample", "head", "tail", F.lag("tail").over(w).alias("before"))
    peaks = edges.withColumn("edge", at_edges("before", "head", "tail", "last", "sample_rate"))
    per = peaks.groupBy("report_id", "channel").agg(F.max(F.greatest("inner", "edge", "sample")).alias("true_peak"))
    own = found.groupBy("report_id", "channel").agg(F.max("sample").alias("sample_peak"), F.min("finite").alias("finite"), F.first("sample_rate").alias("sample_rate"))
    factor = F.lit(PHASES[-1][1])
    for below, n in PHASES[-2::-1]:
        factor = F.when(F.col("sample_rate") < below, n).otherwise(factor)
    out = own.join(per, ["report_id", "channel"], "left")
    return out.select("report_id", "channel", "sample_peak", F.when(F.col("finite"), F.col("true_peak")).alias("true_peak"), factor.alias("oversampling"))


def true_peak_of(found: DataFrame) -> DataFrame:
    """For each file: true_peak_dbtp, sample_peak_dbfs, and whether the former exceeds the latter by more than arithmetic."""
    per = true_peaks(found).groupBy("report_id").agg(F.when(F.count("true_peak") == F.count("*"), F.max("true_peak")).alias("t"), F.max("sample_peak").alias("s"), F.first("oversampling").alias("oversampling"))
    return per.select("report_id", decibels(F.col("t")).alias("true_peak_dbtp"), decibels(F.col("s")).alias("sample_peak_dbfs"), (F.col("t") > F.col("s") * EXCEEDS).alias("exceeds"), "oversampling")
