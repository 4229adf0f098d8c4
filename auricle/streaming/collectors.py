"""Collectors that ride a stream of samples. Running levels are abandoned with a reason once order is broken. Rings of samples come out as overlapping
frames (for onsets and chroma, whose spectra need no state), and weighted energy as sub-blocks (for loudness, whose gates need none)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "frames long, finite long, peak double, squares double, last timestamp, reason string"
LEVELS = "stream long, frames long, non_finite long, peak double, rms double, reason string"


def _collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds a micro-batch to a stream's sums. A sample older than those of an earlier batch abandons the figures that need all in order."""
    frames, finite, peak, squares, last, reason = state.get if state.exists else (0, 0, None, 0.0, None, None)
    newest = last
    for b in batches:
        x = b["x"].to_numpy(float)
        good = x[np.isfinite(x)]
        frames, finite, squares = frames + len(x), finite + len(good), squares + float((good * good).sum())
        if len(good):
            peak = max(peak if peak is not None else 0.0, float(np.abs(good).max()))
        if last is not None and reason is None and b["ts"].min() < last:
            reason = "samples out of order"
        newest = b["ts"].max() if newest is None else max(newest, b["ts"].max())
    state.update((frames, finite, peak, squares, newest, reason))
    known = reason is None and finite > 0
    yield pd.DataFrame({"stream": [key[0]], "frames": [frames], "non_finite": [frames - finite], "peak": [peak if known else None], "rms": [math.sqrt(squares / finite) if known else None], "reason": [reason]})


def levels(samples: DataFrame) -> DataFrame:
    """Running levels (LEVELS) of a streaming DataFrame (stream, ts, x): a row for each stream that a micro-batch touched."""
    rows = samples.select(F.col("stream").cast("long").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("x").cast("double").alias("x"))
    return rows.groupBy("stream").applyInPandasWithState(_collect, LEVELS, STATE, "update", GroupStateTimeout.NoTimeout)


def _in_order(batches: Iterator[pd.DataFrame], last: int | None) -> tuple[np.ndarray, int | None, bool]:
    """A micro-batch's samples by their numbers, the last number, and whether none came before those of an earlier batch, or is missing."""
    rows = pd.concat(list(batches)).sort_values("n")
    n = rows["n"].to_numpy()
    sound = (last is None or n[0] == last + 1) and bool((np.diff(n) == 1).all())
    return rows["x"].to_numpy(float), int(n[-1]), sound


FRAMES = "stream long, nth long, v array<double>"


def frames(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """Frames (FRAMES) of `size` samples, one every `hop`, of a streaming DataFrame (stream, n, x), n counting from 0. The state is what later frames still need, less
    than `size` samples. A stream whose samples are not in order gives no more frames."""

    def ring(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, nth, last, sound = state.get if state.exists else ([], 0, None, True)
        x, last, now = _in_order(batches, last)
        sound = sound and now
        out: list[tuple] = []
        if sound:
            x = np.concatenate([np.array(held, float), x])
            count = max(0, (len(x) - size) // hop + 1)
            out = [(key[0], nth + i, x[i * hop : i * hop + size].tolist()) for i in range(count)]
            held, nth = x[count * hop :].tolist(), nth + count
        state.update((held if sound else [], nth, last, sound))
        yield pd.DataFrame(out, columns=["stream", "nth", "v"])

    rows = samples.select(F.col("stream").cast("long").alias("stream"), F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"))
    return rows.groupBy("stream").applyInPandasWithState(ring, FRAMES, "held array<double>, nth long, last long, sound boolean", "append", GroupStateTimeout.NoTimeout)


SUB_BLOCKS = "stream long, block long, power double"


def sub_blocks(samples: DataFrame, size: int, stages: list[tuple[float, float, float, float, float]]) -> DataFrame:
    """Sums of squares (SUB_BLOCKS) of each `size` samples behind filters (b0, b1, b2, a1, a2), of a streaming DataFrame (stream, n, x). The state is two inputs and
    outputs of each filter and the open block. A stream whose samples are not in order gives no more blocks."""

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, power, filled, block, last, sound = state.get if state.exists else ([0.0] * 4 * len(stages), 0.0, 0, 0, None, True)
        x, last, now = _in_order(batches, last)
        sound, memory, out = sound and now, list(memory), []
        for v in x.tolist() if sound else []:
            for s, (b0, b1, b2, a1, a2) in enumerate(stages):
                x1, x2, y1, y2 = memory[4 * s : 4 * s + 4]
                y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
                memory[4 * s : 4 * s + 4] = [v, x1, y, y1]
                v = y
            power, filled = power + v * v, filled + 1
            if filled == size:
                out.append((key[0], block, power))
                power, filled, block = 0.0, 0, block + 1
        state.update((memory, power, filled, block, last, sound))
        yield pd.DataFrame(out, columns=["stream", "block", "power"])

    rows = samples.select(F.col("stream").cast("long").alias("stream"), F.col("n").cast("long").alias("n"), F.col("x").cast("double").alias("x"))
    return rows.groupBy("stream").applyInPandasWithState(collect, SUB_BLOCKS, "memory array<double>, power double, filled long, block long, last long, sound boolean", "append", GroupStateTimeout.NoTimeout)


def collect_to(running: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a streaming DataFrame over what there is and writes each micro-batch's rows below the path, each batch in its own folder, so a
    batch that is run again replaces its rows."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    running.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
