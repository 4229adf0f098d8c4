"""Importance resampling towards a target: hashed features of two corpora give log ratios, a document's weight is their mean, and the highest weights plus
Gumbel noise are drawn without replacement.

Counts of all buckets are an array of fixed size, summed in each task before anything moves; scores are looked up in an array. The k-th highest score is found by a
distributed quickselect: random keys of the rows that are left are pivots, the rows below, at and above each are counted exactly, and the part that holds the k-th is what is left. Only
the rows drawn are sorted.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, order
from .manifest import CRC_SQL, crc_sql

BUCKETS, MAX_RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Pivots of a round, features whose gain a task remembers, and bytes of a text that are cut into words at once.
PIVOTS, MEMORY, PIECE = 16, 1 << 20, 1 << 20
#: Words of UTF-8 texts in lower case: all but these code points below 80 part them.
WORD, PARTING = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def features(text: bytes, longest: int) -> Iterator[list[bytes]]:
    """Runs of 1 to `longest` words of a text, some at a time: long texts are cut where words part, and runs go on over the cuts."""
    text, at, tail = text.translate(common.FOLD), 0, []
    while at < len(text):
        end = PARTING.search(text, min(len(text), at + PIECE))
        end = end.start() if end else len(text)
        fresh = WORD.findall(text, at, end)
        at = end
        if longest == 1:
            yield fresh
            continue
        own = tail + fresh
        yield [b" ".join(own[i - n + 1 : i + 1]) for i in range(len(tail), len(own)) for n in range(1, min(longest, i + 1) + 1)]
        tail = own[max(0, len(own) - longest + 1) :]


def counts(df: DataFrame, buckets: int = BUCKETS, longest: int = MAX_RUN, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in common.parts(batches):
            seen: Counter[bytes] = Counter()
            for text in common.texts(b):
                for some in features(text, longest):
                    seen.update(some)
                    if len(seen) > MEMORY:
                        _add(total, seen)
                        seen.clear()
            _add(total, seen)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    def _add(total: np.ndarray, seen: Counter) -> None:
        if seen:
            at = np.fromiter((zlib.crc32(x) for x in seen), np.int64, len(seen)) % buckets
            np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))

    found = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():  # as many rows as buckets
        out[bucket] = n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's share in the target to its share in the corpus; one is added to each count."""
    s, t, b = int(own.sum()), int(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log(float(x + 1) * (s + b) / (float(y + 1) * (t + b)))) for x, y in zip(target.tolist(), own.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Floored thousandths of a Gumbel variate that depends on the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Gains(dict):
    """Gains by feature, remembered."""

    def __init__(self, gain: np.ndarray):
        self.gain = gain.tolist()

    def __missing__(self, feature: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        out = self[feature] = self.gain[zlib.crc32(feature) % len(self.gain)]
        return out


def score(df: DataFrame, gain: np.ndarray, longest: int = MAX_RUN, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, n_words, weight, score) of each row: array look-ups within the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Gains(gain)
        for b in common.parts(batches):
            ids, out = b.column("id").to_pylist(), []
            for i, text in zip(ids, common.texts(b)):
                n = total = 0
                for some in features(text, longest):
                    n, total = n + len(some), total + sum(map(look.__getitem__, some))
                # a text of w words has w + (w - 1) + ... runs
                words = n if longest == 1 else sum(len(f) for f in features(text, 1))
                weight = total // n if n else 0
                out.append((n, words, weight, weight + noise(i, seed)))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4))], ["id", "n_features", "n_words", "weight", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_features long, n_words long, weight long, score long").withColumnRenamed("id", id_col)


def select(df: DataFrame, key: Column, k: int, seed: int = SEED) -> tuple | None:
    """The k-th smallest (from 1) key, a struct of longs without nulls that tells all rows apart. A round has PIVOTS pivots, which leave about a ninth of the rows; no row but pivots reaches the driver."""
    rows = df.select(key.alias("k"))
    names = rows.schema["k"].dataType.names
    value = lambda v: F.struct(*(F.lit(x).cast("long").alias(f) for x, f in zip(v, names)))
    below, low, high = 0, None, None
    while True:
        left = rows
        if low is not None:
            left = left.where(F.col("k") > value(low))
        if high is not None:
            left = left.where(F.col("k") < value(high))
        drawn = left.orderBy(F.xxhash64(F.lit(seed + below), *(F.col(f"k.{f}") for f in names))).limit(PIVOTS).collect()
        pivots = sorted(tuple(r["k"]) for r in drawn)
        if not pivots:
            return None
        sums = [x for p in pivots for x in (F.count_if(F.col("k") < value(p)), F.count_if(F.col("k") == value(p)))]
        found = left.agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first()
        lo, base = low, below
        for i, p in enumerate(pivots):
            less, equal = found[2 * i] + base, found[2 * i + 1]
            if k <= less:
                high = p
                break
            if k <= less + equal:
                return p
            lo, below = p, less + equal
        low = lo


def resample(df: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = MAX_RUN, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of df; rank is null for those not drawn.

    Of the rows with at least min_words words, `percent` in a hundred (rounded down) are drawn: the highest scores, equal ones by smaller id, null ids last, then by fewer features; rows alike in all
    that are interchangeable. Null and empty texts have no features and weight 0. An empty target has only counts of 0; an empty df gives an empty table."""
    gain = gains(counts(df, buckets, longest, text_col), counts(target, buckets, longest))
    scored = common.stored(score(df, gain, longest, seed, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()), "scored")
    fits = F.col("n_words") >= min_words
    k = scored.where(fits).count() * percent // 100
    parts = [-F.col("score"), F.col(id_col).isNull().cast("long"), F.coalesce(id_col, F.lit(0).cast("long")), F.col("n_features"), F.col("__row")]
    key = F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts)))
    out = [id_col, "n_features", "weight", "score"]
    last = select(scored.where(fits), key, k, seed) if k else None
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = fits & (key <= F.struct(*(F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(last))))
    winners = order.ranked(scored.where(drawn), [], parts, "__place").select(*out, (F.col("__place") + 1).alias("rank"))
    return winners.unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's distribution of words."""
    return resample(common.read(spark, sf_dir, "documents").select("doc_id", "text"), common.read(spark, sf_dir, "benchmark").select("text"))


_W = "'[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+'"
OP13_SQL = f"""
WITH {CRC_SQL},
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), {_W}) AS ws FROM documents),
du AS (SELECT r, unnest(ws) AS w FROM dw),
bu AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), {_W})) AS w FROM benchmark),
v AS (SELECT w, ({crc_sql("w")} % {BUCKETS})::INT AS b FROM (SELECT w FROM du UNION SELECT w FROM bu), ctable),
s AS (SELECT b, count(*) AS n FROM du JOIN v USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bu JOIN v USING (w) GROUP BY b),
g AS (SELECT v.w, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM v LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
x AS (SELECT r, sum(gain)::BIGINT AS total FROM du JOIN g USING (w) GROUP BY r),
y AS (SELECT dw.r, doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) END::BIGINT AS weight,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM dw LEFT JOIN x USING (r)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM z WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * {PERCENT} // 100 FROM k) THEN place END::BIGINT AS rank FROM z LEFT JOIN k USING (r)"""
