"""Decoded audio in blocks of frames: from contents in a table, or from ranges of files that no task reads whole.

A block is a row (report_id, block, first, own, whole, raw and how to decode it). Blocks of a file are numbered from 0; `whole` says that they are all of its
frames in order, which everything that goes on from block to block needs. A block has `own` frames from `first` on; where frames that reach over its ends are asked for,
raw has `lead` frames before them and some after. Files over CEILING bytes of audio are read in PROBES evenly spaced
probes alone, and then `whole` is false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.sources import containers, ranges

# Bytes of audio that are read whole at most, and probes beyond.
CEILING, PROBES = 128 << 20, 64
#: Frames of a block, and bytes of a probe.
FRAMES, PROBE_BYTES = 1 << 16, 2 << 20
#: Blocks of all files whose places are sent to every task, so that contents stay where they are; with more, contents are shuffled to their places.
SENT = 50_000

FORMAT = ["kind", "sample_rate", "channels", "bit_depth", "is_float", "little"]
BLOCKS = "report_id string, block long, first long, own long, lead long, whole boolean, last boolean, raw binary, kind string, sample_rate long, channels long, bit_depth long, is_float boolean, little boolean"


def decodable(described: DataFrame) -> DataFrame:
    """The files whose samples can be decoded, with width (bytes of a frame) and total (frames that are there and stated)."""
    ok = "codec = 'pcm' AND data_offset IS NOT NULL AND channels > 0 AND data_bytes > 0 AND sample_rate > 0 AND (is_float AND bit_depth IN (32, 64) OR NOT is_float AND bit_depth IN (8, 16, 24, 32))"
    width = (F.floor(F.col("bit_depth") / 8) * F.col("channels")).cast("long")
    there = F.floor(F.col("data_bytes") / F.col("width"))
    described = described.withColumn("is_float", F.coalesce("is_float", F.lit(False)))
    return described.where(ok).withColumn("width", width).withColumn("total", F.least(there, F.coalesce("frames", there)).cast("long")).where("total > 0")


def plan(described: DataFrame, frames: int = FRAMES, ceiling: int = CEILING, before: Column | int = 0, after: int = 0, probes: int = PROBES, probe_bytes: int = PROBE_BYTES) -> DataFrame:
    """A row (report_id, block, first, own, lead, whole, last, offset, size and the format) for each range of a file to read: all blocks of frames, with so many frames before and after
    as there are, or evenly spaced probes of whole frames of a file over the ceiling."""
    if frames < 16:
        raise ValueError("a block has 16 frames at least")
    d = decodable(described)
    small = F.col("total") * F.col("width") <= ceiling
    per = F.greatest(F.lit(1), F.least(F.floor(F.col("total") / probes), F.floor(F.lit(probe_bytes) / F.col("width"))))
    n = F.when(small, F.ceil(F.col("total") / frames)).otherwise(probes)
    d = d.withColumns({"whole": small, "__per": F.when(small, F.lit(frames)).otherwise(per), "__n": n}).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    first = F.when(F.col("whole"), F.col("block") * frames).otherwise(F.floor(F.col("block") * (F.col("total") - F.col("__per")) / (probes - 1)))
    d = d.withColumn("first", first.cast("long"))
    d = d.withColumn("own", F.least(F.col("__per"), F.col("total") - F.col("first")).cast("long"))
    before, after = (F.when(F.col("whole"), x).otherwise(0) for x in (before if isinstance(before, Column) else F.lit(before), F.lit(after)))
    d = d.withColumn("lead", F.least(before, F.col("first")).cast("long"))
    size = (F.least(F.col("first") + F.col("own") + after, F.col("total")) - F.col("first") + F.col("lead")) * F.col("width")
    at = F.col("data_offset") + (F.col("first") - F.col("lead")) * F.col("width")
    return d.select("report_id", "block", "first", "own", "lead", "whole", (F.col("block") == F.col("__n") - 1).alias("last"), at.cast("long").alias("offset"), size.cast("long").alias("size"), *FORMAT)


def from_ranges(described: DataFrame, frames: int = FRAMES, ceiling: int = CEILING, **halo: Column | int) -> DataFrame:
    """Blocks read from the files that report_id names, each range by itself: no content is shuffled, and no task holds more than a range."""
    return ranges.read(plan(described, frames, ceiling, **halo).repartition("report_id", "block")).withColumnRenamed("content", "raw").select(*(x.split()[0] for x in BLOCKS.split(", ")))


def from_contents(found: DataFrame, described: DataFrame, frames: int = FRAMES, ceiling: int = CEILING, **halo: Column | int) -> DataFrame:
    """Blocks of files whose contents are in a table (report_id, content). A content meets its format, one row a file, and is cut where it stands; it moves only where there are more than SENT blocks."""
    asked = plan(described, frames, ceiling, **halo)
    each = asked.groupBy("report_id").agg(F.collect_list(F.struct("block", "first", "own", "lead", "whole", "last", "offset", "size")).alias("ranges"), *(F.first(c).alias(c) for c in FORMAT))
    each = shared.stored(each, "ranges")
    many = each.agg(F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()[0]
    each = F.broadcast(each) if many <= SENT else each
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ((row["report_id"], *(x[c] for c in ("block", "first", "own", "lead", "whole", "last")), row["content"][x["offset"] : x["offset"] + x["size"]], *(row[c] for c in FORMAT)) for row in rows(batches) for x in row["ranges"])
        yield from containers.together(out, kinds, names)

    return found.select("report_id", "content").join(each, "report_id").mapInArrow(cut, BLOCKS)


def decoded(row: dict) -> np.ndarray:
    """A block's samples, (channels, frames), in [-1, 1]."""
    x = containers.decode(row["raw"], row["bit_depth"], row["is_float"], row["little"], row["kind"] == "wav")
    return x.reshape(-1, row["channels"]).T


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one at a time, so that no more than one is unpacked."""
    for b in containers.single(batches):
        yield b.to_pylist()[0]


def channel_names(described: DataFrame) -> Column:
    """Names of the channels by count, where the layout is the usual one; NULL for others (all weigh alike then)."""
    usual = {1: ["FC"], 2: ["FL", "FR"], 6: ["FL", "FR", "FC", "LFE", "BL", "BR"], 8: ["FL", "FR", "FC", "LFE", "BL", "BR", "SL", "SR"]}
    out = F.lit(None).cast("array<string>")
    for n, names in usual.items():
        out = F.when(described["channels"] == n, F.array(*map(F.lit, names))).otherwise(out)
    return out
