"""Queries over compressed files that are made from the events: decoded, measured, and held against what they state of themselves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.plans import audio, streams
from auricle.sources import containers, decoders

c = F.col
#: Samples of a frame, and the parameter of its code.
FRAME, K = 576, 9


def _frame(number: int, x: np.ndarray) -> bytes:
    """A frame of one channel of 16 bits: a constant where all samples are equal, else differences in a Rice code."""
    head = bytes([0xFF, 0xF8, 7 << 4, 4 << 1, number]) + (len(x) - 1).to_bytes(2, "big")
    head += bytes([decoders.crc8(head)])
    first = np.unpackbits(np.array([int(x[0]) & 0xFFFF], ">u2").view(np.uint8))
    if (x == x[0]).all():
        bits = np.concatenate([np.zeros(8, np.uint8), first])
    else:
        d = np.diff(x)
        u = d << 1 ^ d >> 63
        size = (u >> K) + 1 + K
        one = np.cumsum(size) - K - 1
        body = np.zeros(size.sum(), np.uint8)
        body[one] = 1
        for i in range(K):
            body[one + 1 + i] = u >> K - 1 - i & 1
        kind = np.unpackbits(np.array([9 << 1], np.uint8))
        code = np.array([0] * 6 + [K >> 3 & 1, K >> 2 & 1, K >> 1 & 1, K & 1], np.uint8)
        bits = np.concatenate([kind, first, code, body])
    raw = head + np.packbits(bits).tobytes()
    return raw + decoders.crc16(raw).to_bytes(2, "big")


def _coded(x: np.ndarray, stream: int) -> bytes:
    """A file of these samples. Every fifth stream states a wrong checksum of its samples, every seventh is damaged in its last frame, every eleventh states none."""
    digest = hashlib.md5(decoders.packed(x, 16)).digest() if stream % 5 else b"\1" * 16
    info = FRAME.to_bytes(2, "big") * 2 + bytes(6) + (audio.RATE << 44 | 15 << 36 | len(x)).to_bytes(8, "big") + (digest if stream % 11 else bytes(16))
    out = bytearray(b"fLaC\x80\0\0\x22" + info + b"".join(_frame(i, x[at : at + FRAME]) for i, at in enumerate(range(0, len(x), FRAME))))
    if stream % 7 == 0:
        out[-1] ^= 1
    return bytes(out)


def files(spark, sf_dir):
    """A FLAC file for each FILE_FRAMES frames of each stream."""
    s = streams.framed(spark, sf_dir).withColumn("q", F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(c("x") * 40000 + 0.5))).cast("long"))
    lists = s.groupBy("stream", F.floor(c("frame") / audio.FILE_FRAMES).alias("part")).agg(F.array_sort(F.collect_list(F.struct("frame", "q"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in containers.single(batches):
            r = b.to_pylist()[0]
            yield pa.RecordBatch.from_arrays([pa.array([r["report_id"]]), pa.array([_coded(np.array(r["v"], np.int64), r["stream"])], pa.binary())], ["report_id", "content"])

    return lists.select(F.concat_ws("-", "stream", "part").alias("report_id"), c("stream").cast("long").alias("stream"), F.transform("v", lambda x: x["q"]).alias("v")).mapInArrow(run, "report_id string, content binary")


def decoded_levels(spark, sf_dir):
    """What each file's decoder told, and the levels of what it decoded."""
    found = shared.stored(files(spark, sf_dir), "coded")
    contents, plain, told = decoders.opened(found, containers.formats(containers.chunks(found)))
    levels = containers.channel_levels(contents, plain).select("report_id", "frames", F.round("peak", 6).alias("peak"), "peak_frame", F.round("rms", 6).alias("rms"), F.round("dc_offset", 6).alias("dc_offset"), "longest_run", "digital_silence")
    return told.select("report_id", "decoder", "reason", "md5_holds").join(levels, "report_id", "left")


QUERIES = {"decoded_levels": decoded_levels}
ORACLE = {
    "decoded_levels": f"""{audio._Q}, z AS (SELECT m.*, split_part(report_id, '-', 1)::BIGINT AS stream FROM m), w AS (SELECT report_id, min(frame) FILTER (abs(y) = peak) AS peak_frame FROM q JOIN m USING (report_id) GROUP BY 1)
      SELECT z.report_id, 'flac' AS decoder, CASE WHEN stream % 7 = 0 THEN 'It could not be decoded: a frame''s checksum does not hold.' END AS reason, CASE WHEN stream % 7 > 0 AND stream % 11 > 0 THEN stream % 5 > 0 END AS md5_holds,
        CASE WHEN stream % 7 > 0 THEN n END AS frames, CASE WHEN stream % 7 > 0 THEN round(peak, 6) END AS peak, CASE WHEN stream % 7 > 0 THEN peak_frame END AS peak_frame, CASE WHEN stream % 7 > 0 THEN round(rms, 6) END AS rms,
        CASE WHEN stream % 7 > 0 THEN round(dc, 6) END AS dc_offset, CASE WHEN stream % 7 > 0 THEN coalesce(longest_run, 0) END AS longest_run, CASE WHEN stream % 7 > 0 THEN silent END AS digital_silence FROM z LEFT JOIN lr USING (report_id) LEFT JOIN w USING (report_id)""",
}
