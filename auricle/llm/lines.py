"""Line dedup over levelled sorted runs of line hashes.

A batch of documents yields one row per line key: how many of its documents hold the key, and the largest of them. The row
is merge-joined with the runs so far; keys that no run knows are the batch's own and record their keeper, the others only add
to the count. The batch is then written as a run of level 0, bucketed and sorted by the hash, so that a later batch joins it
without moving it. When a level holds `fanout` runs, they are merged into one run of the next level. Batches go from the
largest ids to the smallest, so the first batch that holds a key also holds the document that keeps it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS, MIN_DOCS = 40, 5
#: Runs of a level before they are merged; batches of documents at least, and documents of a batch.
FANOUT, BATCHES, BATCH_DOCS = 3, 4, 20_000_000
OWN = ("__id", "__t", "__gone", "__lines")
#: A list of so many repeated keys (24 bytes each) is sent to all executors; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return common.fold(F.btrim(line, F.lit(common.SPACE)))


class LineRuns:
    """Sorted runs (k1, k2, n, keeper) by level, as bucketed tables whose files are in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", common.scratch(self.spark, "line-run")).saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _merged(self, names: list[str]) -> DataFrame:
        """Sorted runs merge by full outer merge joins, which the buckets spare any shuffle. (A union of bucketed tables is
        planned as bucketed but read unbucketed, so grouping it leaves a key in several rows.)"""
        rows, *others = map(self.spark.table, names)
        for other in others:
            other = other.select(*KEY, F.col("n").alias("m"), F.col("keeper").alias("its"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            rows = rows.join(other, KEY, "full").select(*KEY, n.alias("n"), F.greatest("keeper", "its").alias("keeper"))
        return rows

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of (k1, k2, n, top). A key that finds no partner in any run is new and keeps `top` as its keeper."""
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.select(*KEY, F.lit(True).alias(f"in{i}")), KEY, "left")
            known = known | F.coalesce(F.col(f"in{i}"), F.lit(False))
        self._write(keys.select(*KEY, "n", F.when(~known, F.col("top")).alias("keeper")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._write(self._merged(names), level + 1)
            self._drop(names)
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """k1, k2 and keeper of the keys that at least `min_docs` documents hold, over all runs."""
        return self._merged([x for level in self.levels for x in level]).where(F.col("n") >= min_docs).drop("n")

    def drop(self) -> None:
        self._drop([x for level in self.levels for x in level])
        self.levels = []


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select("*", F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__t"))


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """The columns of df, with the text of the kept lines in place of the text, and n_lines and n_dropped.

    Keys of at least `min_chars` code points that at least `min_docs` documents hold lose their lines everywhere but in the
    largest id that holds them (there, repeats of the line stay too). Null and empty texts are one empty line. Rows with the same
    id count as one document and each keep their own text. Rows with a null id neither count nor lose lines. Ids are cast to long, as the
    session casts. Columns named __id, __t, __gone and __lines are the operator's own; df with one of them is refused. Batches are as many as BATCH_DOCS documents each
    make, BATCHES at least.
    """
    if clash := [c for c in df.columns if c.lower() in OWN]:
        raise ValueError(f"columns {', '.join(clash)} are the operator's own: rename them")
    spark = df.sparkSession
    rows = _rows(df, id_col, text_col)
    batches = batches or max(BATCHES, -(-rows.select("__id").count() // BATCH_DOCS))
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cuts = sorted({int(x) for x in rows.approxQuantile("__id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    batch = sum((F.when(F.col("__id") <= c, 1).otherwise(0) for c in cuts), F.lit(0))
    key = line_key(F.col("line"))
    lines = common.stored(
        rows.where(F.col("__id").isNotNull())
        .select("__id", "__t", batch.cast("int").alias("batch"), F.posexplode(F.split(whole, "\n", -1)).alias("pos", "line"))
        .withColumn("key", key)
        .where(F.char_length("key") >= min_chars)
        .select("__id", "__t", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), "batch"),
        "lines",
        "batch",
    )
    runs = LineRuns(spark)
    try:
        for b in range(len(cuts) + 1):
            held = lines.where(F.col("batch") == b).select(*KEY, "__id").distinct()
            runs.add(held.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("__id").alias("top")))
        frequent = common.stored(runs.frequent(min_docs), "frequent-lines")
    finally:
        runs.drop()
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    gone = lines.join(frequent, KEY).where(F.col("__id") < F.col("keeper")).groupBy("__id", "__t").agg(F.collect_set("pos").alias("__gone"))
    all_rows = rows.join(gone, ["__id", "__t"], "left").withColumn("__lines", F.split(whole, "\n", -1))
    none = F.array().cast("array<int>")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__gone", none))
    text = F.when(F.col("__gone").isNull(), whole).otherwise(F.array_join(F.transform(kept, lambda p: F.get("__lines", p)), "\n"))
    own = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    return all_rows.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in own),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SPACE_SQL = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {SPACE_SQL}), '{common.UPPER}', '{common.LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id < keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
