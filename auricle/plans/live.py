"""Queries that run as streams over the events' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.operators import gating
from auricle.plans import streams
from auricle.streaming import collectors


def streamed_levels(spark, sf_dir):
    """Levels of each stream, collected by a stateful stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    samples = events.select(F.col("user_id").alias("stream"), "ts", (F.col("value") / streams.SCALE - 1).alias("x"))
    folder = shared.folder(spark, "live")
    collectors.collect_to(collectors.levels(samples), f"{folder}/levels", f"{folder}/state")
    rows = spark.read.schema(f"{collectors.LEVELS}, batch int").parquet(f"{folder}/levels")
    last = rows.groupBy("stream").agg(F.max_by(F.struct("frames", "non_finite", "peak", "rms", "reason"), "batch").alias("r")).select("stream", "r.*")
    return streams.rounded(last, 6, "peak", "rms")


def _numbered(spark, sf_dir):
    """The events' samples, numbered along their stream and written as parts of files that a stream reads one after the other, oldest first."""
    folder = shared.folder(spark, "live")
    rows = streams.framed(spark, sf_dir).select("stream", F.col("frame").alias("n"), "x")
    for part in range(3):  # as they would come: a third of each stream's first hundred samples at a time
        rows.where((F.least(F.floor(F.col("n") / 30), F.lit(2)) == part)).coalesce(1).write.mode("append").parquet(f"{folder}/samples")
    return folder, spark.readStream.schema("stream long, n long, x double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/samples")


def _collected(spark, folder, running, schema):
    collectors.collect_to(running, f"{folder}/out", f"{folder}/state", "append")
    return spark.read.schema(schema).parquet(f"{folder}/out")


def streamed_frames(spark, sf_dir):
    """Overlapping frames from a ring of samples, and their energy."""
    folder, samples = _numbered(spark, sf_dir)
    rows = _collected(spark, folder, collectors.frames(samples, 12, 6), collectors.FRAMES)
    power = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("stream", "nth", F.round(F.sqrt(power / 12), 6).alias("rms"))


def streamed_loudness(spark, sf_dir):
    """Sub-blocks collected from a stream, then gated as a batch."""
    folder, samples = _numbered(spark, sf_dir)
    blocks = _collected(spark, folder, collectors.sub_blocks(samples, streams.FRAMES, []), collectors.SUB_BLOCKS)
    out = gating.integrated(gating.rolling(blocks, ["stream"], gating.MOMENTARY, streams.FRAMES), ["stream"])
    return streams.rounded(out, 6, "integrated", "gate")


QUERIES = {f.__name__: f for f in (streamed_levels, streamed_frames, streamed_loudness)}
ORACLE = {
    "streamed_frames": f"WITH {streams.S_SQL}, w AS (SELECT *, unnest(generate_series(greatest(0, floor((frame - 12) / 6.0)::BIGINT + 1), frame // 6)) AS nth FROM s) SELECT stream, nth, round(sqrt(avg(x * x)), 6) AS rms FROM w GROUP BY stream, nth HAVING count(*) = 12",
    "streamed_loudness": streams.ORACLE["integrated_gated"],
    "streamed_levels": f"WITH {streams.S_SQL} SELECT stream, count(*) AS frames, 0 AS non_finite, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, NULL::VARCHAR AS reason FROM s GROUP BY stream",
}
