"""Substring dedup: repeated windows of 50 words, found by super-k-mers.

The minimiser of a window is the leftmost of its eight-word pieces with the smallest hash. Equal windows have equal minimisers, and
neighbouring windows mostly share one, so a run of windows with the same minimiser (a super-k-mer) goes to the minimiser's bucket
as one string of words. There, the windows of a bucket are sorted, so that equal ones stand together with the smallest document
that holds them. Three things keep this small and even:

- a first pass sends only (minimiser, document, place); buckets that one document alone reaches hold no repeat, and their strings stay home;
- equal strings of a bucket are one string: all but the smallest document lose all its windows;
- a bucket of over HOT super-k-mers is dealt over several tasks by document. Each settles its own repeats and passes on a digest of
  each of its windows, and the smallest document of a digest comes from an aggregation that combines before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

WINDOW, PIECE = 50, 8
HOT = 2048
ROW = ["doc_id", "t"]


def super_kmers(texts: list[bytes], window: int = WINDOW, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """For ranges of texts: index of the text, minimiser, first window, number of windows of each run of windows with one minimiser."""
    span = window - piece + 1
    for lo, hi in words.chunks(texts):
        hashed, counts = words.word_hashes(texts[lo:hi])
        if len(hashed) < window:
            continue
        value = words.shingle_hashes(hashed, piece)
        least = np.arange(len(value))
        width = 1
        while width < span:
            step = min(width, span - width)
            a, b = least[:-step], least[step:]
            least = np.where(value[b] < value[a], b, a)
            width += step
        doc = np.repeat(np.arange(lo, hi), counts)[: len(least)]
        stop = np.cumsum(counts)
        inside = np.arange(len(least)) + window <= stop[doc - lo]
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        new = np.concatenate([[True], (least[at][1:] != least[at][:-1]) | (doc[at][1:] != doc[at][:-1])])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        d = doc[at[first]]
        yield d, value[least[at[first]]].view(np.int64), at[first] - (stop - counts)[d - lo], n


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.parts(batches):
        ids, ts = (b.column(c).to_numpy(zero_copy_only=False) for c in ROW)
        for d, mini, start, n in super_kmers(common.texts(b)):
            columns = [pa.array(x) for x in (ids[d], ts[d], mini, start.astype(np.int32), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*ROW, "mini", "start", "n"])


PACKED = "doc_id long, t long, mini long, rows long, start int, n int, packed binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PACKED.split(", ")]
    for b in common.parts(batches):
        out: list[tuple] = []
        for doc, t, text, runs in zip(*(b.column(c).to_pylist() for c in ROW), common.texts(b), b.column("runs").to_pylist()):
            split = text.split()
            out += [(doc, t, r["mini"], r["rows"], r["start"], r["n"], b" ".join(split[r["start"] : r["start"] + r["n"] + WINDOW - 1])) for r in runs]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)


def _windows(packed: bytes) -> list[bytes]:
    ends = [-1, *np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist(), len(packed)]
    return [packed[ends[i] + 1 : ends[i + WINDOW]] for i in range(len(ends) - WINDOW)]


def _settle(group: list[tuple[int, int, int, int, bytes]], hot: bool) -> Iterator[tuple]:
    """(document, t, first window, windows, digest) of one bucket's repeats; with a digest, a window that is to be compared with other parts of a hot bucket."""
    by: dict[bytes, list[tuple[int, int, int, int]]] = {}
    for doc, t, start, n, packed in group:
        by.setdefault(packed, []).append((doc, t, start, n))
    listed = []
    for packed, members in by.items():
        least = min(members)[0]
        kept = [m for m in members if m[0] == least]  # one document may hold it twice
        yield from ((*m, None) for m in members if m[0] > least)
        listed.append((packed, least, kept))
    if hot:
        for packed, _, kept in listed:
            for k, window in enumerate(_windows(packed)):
                digest = hashlib.blake2b(window, digest_size=16).digest()
                yield from ((doc, t, start + k, 1, digest) for doc, t, start, _ in kept)
    elif len(listed) > 1:
        entries = sorted((window, least, i, k) for i, (packed, least, _) in enumerate(listed) for k, window in enumerate(_windows(packed)))
        for _, equal in groupby(entries, key=lambda e: e[0]):
            (_, first, _, _), *rest = equal
            for _, doc, i, k in rest:
                if doc > first:
                    yield from ((d, t, start + k, 1, None) for d, t, start, _ in listed[i][2])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by bucket and holds one bucket (or part of a hot one) at a time."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    out: list[tuple] = []
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*ROW, "start", "n", "digest"])
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("mini", "part", "parts", *ROW, "start", "n", "packed"))))
    for (_, _, parts), group in groupby(rows, key=lambda r: r[:3]):
        for row in _settle([r[3:] for r in group], parts > 1):
            out.append(row)
            if len(out) >= 20_000:
                yield batch_of()
                out = []
    if out:
        yield batch_of()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.parts(batches):
        out = []
        for text, runs in zip(common.texts(b), b.column("gone").to_pylist()):
            split = text.split()
            n = len(split)
            if runs:
                edge = np.zeros(n + 1, np.int64)
                start, count = (np.array([r[c] for r in runs]) for c in ("start", "n"))
                np.add.at(edge, start, 1)
                np.add.at(edge, np.minimum(start + count + WINDOW - 1, n), -1)
                split = [split[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            out.append((n, n - len(split), b" ".join(split).decode()))
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "text"])


def _text_key(c: Column) -> Column:
    return F.xxhash64(c)


def drop_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and text (kept words joined by one space), a row for every row.

    A word goes if a window of WINDOW words that covers it also starts in a row with a smaller id. Null texts have no words. Rows with
    the same id do not take words from each other. Rows with a null id neither take nor lose words.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text).alias("t"), text.alias("text"))
    named = docs.where(F.col("doc_id").isNotNull())
    places = common.stored(named.mapInArrow(_places, "doc_id long, t long, mini long, start int, n int"), "super-kmers")
    # stored, so that both sides of the join are plain scans: a hot minimiser's places are then split over tasks
    shared = common.stored(places.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("mini", "rows"), "shared-minimisers")
    runs = places.join(shared, "mini").groupBy(*ROW).agg(F.collect_set(F.struct("mini", "rows", "start", "n")).alias("runs"))
    packed = named.dropDuplicates(ROW).join(runs, ROW).select(*ROW, "text", "runs").mapInArrow(_packed, PACKED)
    parts = F.ceil(F.col("rows") / HOT)
    buckets = packed.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("doc_id"), parts)}).drop("rows").repartition("mini", "part").sortWithinPartitions("mini", "part")
    found = common.stored(buckets.mapInArrow(_repeats, "doc_id long, t long, start int, n int, digest binary"), "repeats")
    waiting = found.where(F.col("digest").isNotNull())
    first = common.stored(waiting.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "first-windows")
    late = waiting.join(first, "digest").where(F.col("doc_id") > F.col("first"))
    gone = found.where(F.col("digest").isNull()).drop("digest").unionAll(late.select(*ROW, "start", "n"))
    gone = gone.groupBy(*ROW).agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    return docs.join(gone, ROW, "left").select("doc_id", "text", "gone").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_passages(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


#: White space of the contract, in DuckDB's regular expressions.
WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lo FROM k) WHERE doc_id > lo),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS n, coalesce(len(ps), 0) AS gone, w, ps FROM d LEFT JOIN g USING (doc_id)),
y AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM x WHERE gone > 0),
z AS (SELECT y.doc_id, string_agg(word, ' ' ORDER BY y.p) AS kept FROM y ANTI JOIN c ON y.doc_id = c.doc_id AND y.p = c.p GROUP BY y.doc_id)
SELECT doc_id, n AS n_words, gone AS n_removed,
  sha256(CASE WHEN gone = 0 THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM x LEFT JOIN z USING (doc_id)"""
