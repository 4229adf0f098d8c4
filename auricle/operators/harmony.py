"""Pitch classes and keys from spectra: chroma, note collections, centres, alternatives, strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Steps of the major scale, (degree, mode, prior) of the centres of a note collection, names of notes, limits of confidence
# and ambiguity, and weights of a centre's evidence.
SCALE_STEPS = [0, 2, 4, 5, 7, 9, 11]
MODES = [(0, "major", 1.00), (9, "minor", 0.96), (7, "Mixolydian", 0.53), (2, "Dorian", 0.51)]
NAMES = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
ESTABLISH, MEDIUM, HIGH = 0.65, 0.69, 0.75
AMBIGUOUS = 0.15
OVERALL, BASS, END = 0.25, 0.45, 0.30


def pitch_class(hz: Column) -> Column:
    """0 (C) to 11 of a frequency, with A4 at 440 Hz."""
    return F.pmod(F.floor(69 + 12 * F.log2(hz / 440.0) + 0.5), F.lit(12)).cast("int")


def shares(chroma: DataFrame, keys: list[str]) -> DataFrame:
    """Pools chroma rows (keys, pc, magnitude) into shares of the total; a silent pool has none."""
    pooled = chroma.groupBy(*keys, "pc").agg(F.sum("magnitude").alias("m"))
    total = F.sum("m").over(Window.partitionBy(*keys))
    return pooled.withColumn("share", F.when(total > 0, F.col("m") / total)).drop("m")


def collections(pooled: DataFrame, keys: list[str]) -> DataFrame:
    """The seven-note collection that holds most of the pool (lowest root on ties): root and concentration."""
    roots = F.explode(F.array(*(F.pmod(F.col("pc") - step + 12, F.lit(12)) for step in SCALE_STEPS))).alias("root")
    scored = pooled.select(*keys, "share", roots).groupBy(*keys, "root").agg(F.round(F.sum("share"), 9).alias("score"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("root", "score"), F.struct("score", -F.col("root"))).alias("b"))
    return best.select(*keys, F.col("b.root").cast("long").alias("root"), F.col("b.score").alias("concentration"))


def centres(pooled: DataFrame, bass: DataFrame, ending: DataFrame, collection: DataFrame, keys: list[str]) -> DataFrame:
    """The four centres of a collection: score of overall, bass and ending share times the mode's prior, rank, and closeness to the first."""
    modes = F.explode(F.array(*(F.struct(F.lit(d).alias("degree"), F.lit(m).alias("mode"), F.lit(p).alias("prior"), F.lit(i).alias("mode_ord")) for i, (d, m, p) in enumerate(MODES)))).alias("x")
    out = collection.select(*keys, "root", "concentration", modes).select(*keys, "concentration", "x.*", F.pmod(F.col("root") + F.col("x.degree"), F.lit(12)).cast("int").alias("pc"))
    out = out.join(pooled.select(*keys, "pc", "share"), [*keys, "pc"], "left").join(bass.select(*keys, "pc", F.col("share").alias("bass")), [*keys, "pc"], "left")
    out = out.join(ending.select(*keys, "pc", F.col("share").alias("ending")), [*keys, "pc"], "left")
    score = (OVERALL * F.coalesce("share", F.lit(0.0)) + BASS * F.coalesce("bass", F.lit(0.0)) + END * F.coalesce("ending", F.lit(0.0))) * F.col("prior")
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "mode_ord")
    out = out.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(w).cast("long"))
    top = F.first("score").over(w)
    return out.withColumn("closeness", F.when(top > 0, F.col("score") / top)).select(*keys, "rank", "mode", F.col("pc").cast("long").alias("pc"), "score", "closeness", "concentration")


def confidence(concentration: Column, alternatives: Column, modal: Column) -> Column:
    """NULL where no key is established."""
    doubtful = modal | (alternatives > 0)
    return (
        F.when(concentration < ESTABLISH, F.lit(None))
        .when(doubtful & (concentration >= HIGH), "medium")
        .when(doubtful, "low")
        .when(concentration >= HIGH, "high")
        .when(concentration >= MEDIUM, "medium")
        .otherwise("low")
    )


def strength(concentration: Column) -> Column:
    return F.when(concentration >= 0.80, "strongly tonal").when(concentration >= 0.72, "clearly tonal").when(concentration.isNotNull(), "weakly tonal")
