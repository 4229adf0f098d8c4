"""MPEG audio by ranges: every plausible header of a range is a candidate, and each possible way into a range is followed to the way out, before anyone knows
which of them the file takes. Ranges are parsed by different tasks; what a range says is a few rows, which are put together in order.

Where no header stands where the last frame ends, the walk goes on at the next header that fits the first one's rate and layer, within RESYNC bytes: a resync.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auricle.sources import containers, ranges

#: Bytes of a range; bytes in which the walk looks for the next header, and the longest frame there is.
RANGE, RESYNC, LONGEST = 1 << 20, 1 << 16, 3000
FIRST = "report_id string, first long, end long, sample_rate long, channels long, samples long, kilobits long, vbr string, vbr_frames long, vbr_bytes long, encoder string, delay long, padding long, peak double"
WAY = "struct<entry:bigint,exit:bigint,frames:bigint,samples:bigint,bytes:bigint,kilobits:bigint,least:bigint,most:bigint,resyncs:bigint,cut:boolean,like:boolean>"


def _first(report_id: str, content: bytes) -> tuple | None:
    """Where the frames of a file begin and end, and what its first frame says of all of them."""
    chunks = list(containers.walk_head(content))
    if not chunks:
        return None
    at, end, own = chunks[0]
    kind = frames = size = encoder = delay = padding = peak = None
    side = 4 + (32 if own[3] == 1152 and own[2] == 2 else 9 if own[3] == 576 and own[2] == 1 else 17)
    head = bytes(content[at : at + min(own[0], 2048)])
    big = lambda p, n: int.from_bytes(head[p : p + n], "big")
    if head[36:40] == b"VBRI":
        kind, size, frames = "VBRI", big(46, 4), big(50, 4)
    elif head[side : side + 4] in (b"Xing", b"Info"):
        kind, flags, p = head[side : side + 4].decode(), big(side + 4, 4), side + 8
        if flags & 1:
            frames, p = big(p, 4), p + 4
        if flags & 2:
            size, p = big(p, 4), p + 4
        p += (100 if flags & 4 else 0) + (4 if flags & 8 else 0)
        name = head[p : p + 9].decode("latin-1").strip("\0 ")
        if p + 36 <= len(head) and name[:4] in ("LAME", "Lavc", "Lavf"):
            encoder, gap = name, big(p + 21, 3)
            delay, padding, peak = gap >> 12, gap & 0xFFF, big(p + 11, 4) / (1 << 23) or None
    return report_id, at, end, own[1], own[2], own[3], own[4], kind, frames, size, encoder, delay, padding, peak


def first_frames(found: DataFrame) -> DataFrame:
    """A row for each MPEG file (report_id, content), or listed file (report_id, length), in which two frames agree."""
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    whole = "content" in found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in containers.single(batches):
            path = b.column("report_id")[0].as_py()
            content = b.column("content")[0].as_py() if whole else ranges.opened(path, b.column("length")[0].as_py())
            row = _first(path, content) if content is not None and containers.sniffed(content) == "mp3" else None
            yield pa.RecordBatch.from_arrays([pa.array([v] if row else [], k) for v, k in zip(row or [None] * len(kinds), kinds)], [x.split()[0] for x in FIRST.split(", ")])

    return found.mapInArrow(run, FIRST)


def ways(raw: bytes, offset: int, first: int, stop: int, end: int, rate: int, samples: int) -> list[tuple]:
    """Ways through the range from offset to stop of a file whose frames go from first to end; raw has the range's bytes and four more. For each candidate that a frame or a resync of the range before may lead
    to: (entry, exit, frames, samples, bytes, kilobits, least and most kilobits, resyncs, whether the last frame is cut, whether the entry is like the first frame)."""
    data = np.frombuffer(raw, np.uint8)
    places = np.flatnonzero((data[:-1] == 255) & (data[1:] & 0xE0 == 0xE0)) + offset
    heads = {int(p): h for p in places[places >= first].tolist() if p < stop and p + 4 <= end and (h := containers.mpeg_header(bytes(raw[p - offset : p - offset + 4])))}
    order = sorted(heads)
    like = np.array([p for p in order if heads[p][1] == rate and heads[p][3] == samples], np.int64)
    out: dict[int, tuple] = {}

    def after(p: int) -> tuple[int | None, int]:
        """The candidate at which the walk goes on from p, if it is in the range, and how many resyncs that takes."""
        if p in heads:
            return p, 0
        k = int(np.searchsorted(like, p + 1))
        if k < len(like) and like[k] < p + RESYNC:
            return int(like[k]), 1
        return None, 0

    for p in reversed(order):
        size, _, _, n, kilobits = heads[p]
        if p + size > end:
            out[p] = (p, end, 0, 0, 0, 0, None, None, 0, True)
            continue
        onward, resyncs = after(p + size) if p + size < stop else (None, 0)
        if onward is None:
            rest = (p + size, 0, 0, 0, 0, None, None, 0, False)
        else:
            rest = out[onward][1:]
        low, high = (min(x for x in (kilobits, rest[5]) if x is not None), max(x for x in (kilobits, rest[6]) if x is not None))
        out[p] = (p, rest[0], 1 + rest[1], n + rest[2], size + rest[3], kilobits + rest[4], low, high, resyncs + rest[7], rest[8])
    # a frame of the range before leads in within LONGEST bytes, a resync to the next candidate that is like the first frame
    reach = max(offset, first) + LONGEST
    beyond = like[np.searchsorted(like, reach) :][:1].tolist()
    fits = set(like.tolist())
    return [(*out[p], p in fits) for p in [*(p for p in order if p < reach), *beyond]]


def parsed(asked: DataFrame) -> DataFrame:
    """asked: (report_id, offset, stop, first, end, sample_rate, samples, content: the range's bytes and the four that follow). The ways through each range."""
    names = ["entry", "exit", "frames", "samples", "bytes", "kilobits", "least", "most", "resyncs", "cut", "like"]
    way = pa.struct([(n, pa.bool_() if n in ("cut", "like") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in containers.single(batches):
            r = b.to_pylist()[0]
            found = ways(r["content"], r["offset"], r["first"], r["stop"], r["end"], r["sample_rate"], r["samples"])
            rows = [dict(zip(names, x)) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r["report_id"]]), pa.array([r["offset"]], pa.int64()), pa.array([rows], pa.list_(way))], ["report_id", "offset", "ways"])

    return asked.mapInArrow(run, f"report_id string, offset long, ways array<{WAY}>")


WALK = "frames bigint, samples bigint, bytes bigint, kilobits bigint, least bigint, most bigint, resyncs bigint, cut boolean"


def _together(ranges_: list[dict], at: int) -> dict:
    """A file's ranges in order, entered at its first frame."""
    total = {"frames": 0, "samples": 0, "bytes": 0, "kilobits": 0, "least": None, "most": None, "resyncs": 0, "cut": False}
    for part in ranges_:
        entries = {w["entry"]: w for w in part["ways"]}
        if at not in entries:
            onward = next((e for e in sorted(entries) if e > at and entries[e]["like"]), None)
            if at >= part["stop"] or onward is None or onward >= at + RESYNC:
                continue  # the range has no frame of its own here
            at = onward
            total["resyncs"] += 1
        way = entries[at]
        for name in ("frames", "samples", "bytes", "kilobits", "resyncs"):
            total[name] += way[name]
        for name, pick in (("least", min), ("most", max)):
            known = [x for x in (total[name], way[name]) if x is not None]
            total[name] = pick(known) if known else None
        total["cut"] |= way["cut"]
        at = way["exit"]
    return total


def walks(found: DataFrame, size: int = RANGE) -> DataFrame:
    """For each MPEG file: what first_frames says, and frames, samples, bytes, resyncs, constant (one bit rate in all frames), mean_kilobits, cut (the last frame is not all there) and seconds
    from all of its frames. Files are walked by ranges of `size` bytes, of contents or by path."""
    firsts = first_frames(found)
    numbers = F.sequence(F.floor(F.col("first") / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long"))
    per = firsts.withColumn("offset", F.explode(numbers)).withColumn("offset", F.col("offset") * size)
    per = per.withColumn("stop", F.least(F.col("offset") + size, F.col("end"))).withColumn("size", F.least(F.col("stop") + 4, F.col("end")) - F.col("offset"))
    asked = per.select("report_id", "offset", "stop", "size", "first", "end", "sample_rate", "samples")
    if "content" in found.columns:
        each = asked.groupBy("report_id").agg(F.collect_list(F.struct("offset", "stop", "size", "first", "end", "sample_rate", "samples")).alias("x"))
        names = ["report_id", "offset", "stop", "size", "first", "end", "sample_rate", "samples", "content"]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in containers.single(batches):
                r = b.to_pylist()[0]
                for x in r["x"]:
                    values = [r["report_id"], *x.values(), r["content"][x["offset"] : x["offset"] + x["size"]]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if n == "report_id" else pa.binary() if n == "content" else pa.int64()) for v, n in zip(values, names)], names)

        asked = found.select("report_id", "content").join(each, "report_id").mapInArrow(cut, "report_id string, offset long, stop long, size long, first long, end long, sample_rate long, samples long, content binary")
    else:
        asked = ranges.read(asked.repartition("report_id", "offset"))
    parts = parsed(asked).withColumn("stop", F.col("offset") + size)

    @F.arrow_udf(WALK)
    def joined(x: pa.Array, first: pa.Array) -> pa.Array:
        rows = [_together(r, at) for r, at in zip(x.to_pylist(), first.to_pylist())]
        return pa.array(rows, pa.struct([(n, pa.bool_() if n == "cut" else pa.int64()) for n in ("frames", "samples", "bytes", "kilobits", "least", "most", "resyncs", "cut")]))

    groups = parts.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("offset", "stop", "ways"))).alias("x"))
    walked = firsts.withColumnRenamed("samples", "frame_samples").join(groups, "report_id").withColumn("w", joined("x", "first"))
    w = F.col("w")
    return walked.select(
        "report_id", "sample_rate", "channels", "vbr", "vbr_frames", "encoder", "delay", "padding", "peak", *(w[n].alias(n) for n in ("frames", "samples", "bytes", "resyncs", "cut")),
        ((w["frames"] > 1) & (w["least"] == w["most"])).alias("constant"), F.try_divide(w["kilobits"].cast("double"), w["frames"]).alias("mean_kilobits"), (w["samples"] / F.col("sample_rate")).alias("seconds"),
    )
