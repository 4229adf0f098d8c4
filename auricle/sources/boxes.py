"""What the boxes of MP4 audio say: nested descriptors of the decoder, run-length tables of times, gapless figures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auricle.functions import display
from auricle.sources import containers, tags

# Kinds of audio object, sample rates by index, and descriptors of elementary streams.
PROFILES = {1: "Main", 2: "LC", 3: "SSR", 4: "LTP", 5: "SBR", 6: "Scalable", 23: "LD", 29: "PS", 39: "ELD", 42: "USAC"}
RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]
STREAM, DECODER, SPECIFIC = 3, 4, 5
#: Bytes of a decoder's box, and entries of a table of times, that are read at most.
BOX_BYTES, ENTRIES = 1 << 16, 1 << 20
DETAILS = "report_id string, object_type long, max_bitrate long, avg_bitrate long, profile string, config_rate long, config_channels long, sbr boolean, times array<struct<count:bigint,delta:bigint>>"


def descriptors(body: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, bytes of its own) of all descriptors, those within others after them. A length is in seven bits of each of up to four bytes; one that goes beyond the end ends the list."""
    at = 0
    while at + 2 <= len(body):
        tag, size, at = body[at], 0, at + 1
        for _ in range(4):
            if at >= len(body):
                return
            size, more, at = size << 7 | body[at] & 127, body[at] & 128, at + 1
            if not more:
                break
        if at + size > len(body):
            return
        own = body[at : at + size]
        yield tag, own
        if tag == STREAM and len(own) >= 3:
            inner = 3 + (2 if own[2] & 128 else 0)
            inner += 1 + own[inner] if own[2] & 64 and inner < len(own) else 0
            yield from descriptors(own[inner + (2 if own[2] & 32 else 0) :])
        elif tag == DECODER:
            yield from descriptors(own[13:])
        at += size


def audio_config(own: bytes) -> tuple[int, int | None, int, bool]:
    """(kind of object, rate, channels, whether the rate is that of a band that is rebuilt) from a decoder's own description."""
    bits, at = int.from_bytes(own, "big"), 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        left = len(own) * 8 - at
        return bits >> left & (1 << n) - 1 if left >= 0 else 0

    def rate() -> int | None:
        i = take(4)
        return take(24) if i == 15 else RATES[i] if i < len(RATES) else None

    kind = take(5)
    kind = 32 + take(6) if kind == 31 else kind
    hz, channels = rate(), take(4)
    if kind in (5, 29):
        return kind, rate() or hz, channels, True
    return kind, hz, channels, False


def _details(path: str, content: bytes) -> tuple:
    chunks = [c for c in containers.tracked(content, "mp4") if c[-1]]
    out: list = [None] * 7
    times = []
    for name, at, _, there, *_ in chunks:
        if name == b"stsd":
            body = bytes(content[at : at + min(there, BOX_BYTES)])
            mark = body.find(b"esds", 16)
            if mark > 0:
                size = int.from_bytes(body[mark - 4 : mark], "big")
                for tag, own in descriptors(body[mark + 8 : mark - 4 + size]):
                    if tag == DECODER and len(own) >= 13:
                        out[0], out[1], out[2] = own[0], int.from_bytes(own[5:9], "big"), int.from_bytes(own[9:13], "big")
                    if tag == SPECIFIC and own:
                        kind, out[4], out[5], out[6] = audio_config(own)
                        out[3] = PROFILES.get(kind, f"object type {kind}")
        elif name == b"stts":
            n = min(int.from_bytes(content[at + 4 : at + 8], "big"), (there - 8) // 8, ENTRIES)
            body = bytes(content[at + 8 : at + 8 + 8 * n])
            times += [{"count": int.from_bytes(body[i : i + 4], "big"), "delta": int.from_bytes(body[i + 4 : i + 8], "big")} for i in range(0, 8 * n, 8)]
    return path, *out, times


def details(found: DataFrame) -> DataFrame:
    """For each MP4 file (report_id, content): the decoder of its first audio track (kind of object, greatest and mean bit rate, profile, rate, channels, sbr), packets and units of time by its table of times,
    and delay, padding and samples of its gapless comment."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("count", pa.int64()), ("delta", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in containers.single(batches):
            path, content = b.column("report_id")[0].as_py(), b.column("content")[0].as_py()
            row = _details(path, content) if content is not None and containers.sniffed(content) == "mp4" else None
            yield pa.RecordBatch.from_arrays([pa.array([v] if row else [], k) for v, k in zip(row or [None] * len(kinds), kinds)], [x.split()[0] for x in DETAILS.split(", ")])

    out = found.select("report_id", "content").mapInArrow(run, DETAILS)
    total = lambda f: F.when(F.size("times") > 0, F.aggregate("times", F.lit(0).cast("long"), f))
    out = out.withColumns({"packets": total(lambda s, x: s + x["count"]), "units": total(lambda s, x: s + x["count"] * x["delta"])}).drop("times")
    comment = tags.tags(found).where("scheme = 'itunes' AND key = 'iTunSMPB'").groupBy("report_id").agg(F.first("value").alias("gap"))
    gap = display.gapless(F.col("gap"))
    return out.join(comment, "report_id", "left").withColumns({"delay": gap["delay"], "padding": gap["padding"], "true_samples": gap["samples"]}).drop("gap")
