"""Benchmark decontamination: SimHash over windows as long as an item, multi-index lookup, exact weighted similarity.

A window has as many words as the item it is held against; a document with fewer words is one window as a whole. Its fingerprint is the sign of the sum of +1/-1 vectors of its five-word
shingles, each as often as it stands there. Items are listed under every value within FLIPS bits of each of BLOCKS blocks of their
fingerprint, so two fingerprints within RADIUS share a listing for certain (the pigeonhole principle: RADIUS < BLOCKS * (FLIPS + 1)).
What is found is then compared exactly: sum of the smaller over sum of the larger shingle counts, SIMILARITY or more. Windows with too few
shingles of any item to reach that are passed over first; that bound is exact too, and does most of the choosing: at this similarity fingerprints
differ in 11 bits of 64 on average, so an index that loses none within RADIUS lists most items of a length. Items of fewer than five words
have one shingle, their whole sequence, and are found where it stands.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

SHINGLE, SIMILARITY = 5, 0.75
BLOCKS, FLIPS = 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Bytes of items that one pass over the documents holds; more items take more passes.
PASS_BYTES = 16_000_000
_BITS = np.arange(64, dtype=np.uint64)
#: Windows whose fingerprints are made together.
STEP = 4096


def _signs(shingles: np.ndarray) -> np.ndarray:
    return ((words.mix(shingles)[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class Index:
    """Items (id, text) by length, fingerprint blocks and shingles; those of fewer than five words by their whole sequence."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.counts, self.prints = [], [], []
        #: words -> (hash of the whole sequence -> item numbers) of short items
        self.short: dict[int, dict[int, list[int]]] = {}
        self.by_length: dict[int, list[dict[int, list[int]]]] = {}
        flips = [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(64 // BLOCKS), n)]
        for item, text in items:
            hashed, _ = words.word_hashes([text.translate(common.FOLD)])
            if len(hashed) < SHINGLE:
                if len(hashed):
                    self.short.setdefault(len(hashed), defaultdict(list))[int(words.shingle_hashes(hashed, len(hashed))[0])].append(len(self.ids))
                    self.ids.append(item)
                    self.counts.append({})
                    self.prints.append(0)
                continue
            shingles = words.shingle_hashes(hashed, SHINGLE)
            fingerprint = int(_fingerprints(_signs(shingles).sum(axis=0)[None])[0])
            number = len(self.ids)
            self.ids.append(item)
            self.counts.append(dict(zip(*(x.tolist() for x in np.unique(shingles, return_counts=True)))))
            self.prints.append(fingerprint)
            blocks = self.by_length.setdefault(len(hashed), [defaultdict(list) for _ in range(BLOCKS)])
            for k, listed in enumerate(blocks):
                value = fingerprint >> k * (64 // BLOCKS) & (1 << 64 // BLOCKS) - 1
                for f in flips:
                    listed[value ^ f].append(number)
        self.shingles = np.unique(np.array([s for c in self.counts for s in c], np.uint64))

    def near(self, length: int, fingerprint: int) -> set[int]:
        """All items of the length whose fingerprints are within RADIUS, and no other."""
        blocks, mask = self.by_length[length], (1 << 64 // BLOCKS) - 1
        found = {i for k, listed in enumerate(blocks) for i in listed.get(fingerprint >> k * (64 // BLOCKS) & mask, ())}
        return {i for i in found if (self.prints[i] ^ fingerprint).bit_count() <= RADIUS}

    def short_leaks(self, hashed: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """(item number, 1, first word, words) of the first place of each short item whose words stand in a row in a text."""
        for n, listed in self.short.items():
            value = words.shingle_hashes(hashed, n)
            at = np.flatnonzero(np.isin(value, np.fromiter(listed, np.uint64, len(listed))))
            first: dict[int, int] = {}
            for p in at.tolist():
                first.setdefault(int(value[p]), p)
            yield from ((i, 1.0, p, n) for h, p in first.items() for i in listed[h])

    def known(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.shingles, shingles)
        return self.shingles[np.minimum(at, len(self.shingles) - 1)] == shingles if len(self.shingles) else np.zeros(len(shingles), bool)

    def leaks(self, shingles: np.ndarray, known: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item number -> (similarity, first word, words) of its best window, the first of equals."""
        best: dict[int, tuple[float, int, int]] = {}
        total = np.concatenate([[0], np.cumsum(known)])
        for length in self.by_length:
            m = length - SHINGLE + 1
            n = min(m, len(shingles))
            # the sides have m and n shingles, so a similarity s needs (m + n) * s / (1 + s) common ones
            least = (m + n) * SIMILARITY / (1 + SIMILARITY) - 1e-9
            if n < least:
                continue
            starts = np.flatnonzero(total[n:] - total[:-n] >= least)
            for a in range(0, len(starts), STEP):
                own = starts[a : a + STEP]
                lo, hi = int(own[0]), int(own[-1]) + n
                if hi - lo <= 16 * STEP:
                    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(shingles[lo:hi]), axis=0)])
                    prints = _fingerprints(sums[own - lo + n] - sums[own - lo])
                else:
                    prints = np.array([_fingerprints(_signs(shingles[s : s + n]).sum(axis=0)[None])[0] for s in own.tolist()], np.uint64)
                for s, fingerprint in zip(own.tolist(), prints.tolist()):
                    found = self.near(length, fingerprint)
                    if not found:
                        continue
                    window, times = (x.tolist() for x in np.unique(shingles[s : s + n], return_counts=True))
                    for i in found:
                        common_ = sum(min(t, self.counts[i].get(h, 0)) for h, t in zip(window, times))
                        similarity = common_ / (m + n - common_)
                        if similarity >= SIMILARITY and (i not in best or similarity > best[i][0]):
                            best[i] = (similarity, s, n + SHINGLE - 1)
        return best


LEAK = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _found(texts: list[bytes], index: Index) -> Iterator[tuple[int, int, float, int, int]]:
    """(number of the text, item, similarity, first word, words) of the best window of every text for every item that it leaks."""
    texts = [t.translate(common.FOLD) for t in texts]
    for lo, hi in words.chunks(texts):
        hashed, counts = words.word_hashes(texts[lo:hi])
        value = words.shingle_hashes(hashed, SHINGLE)
        known = index.known(value)
        at = 0
        for k, n in enumerate(counts.tolist(), lo):
            own = slice(at, at + max(0, n - SHINGLE + 1))
            if index.short:
                yield from ((k, index.ids[i], *rest) for i, *rest in index.short_leaks(hashed[at : at + n]))
            at += n
            if known[own].any():
                yield from ((k, index.ids[i], *rest) for i, rest in index.leaks(value[own], known[own]).items())


def _leaks(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in LEAK.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    for b in common.parts(batches):
        ids = b.column("doc_id").to_pylist()
        out = [(ids[k], *rest) for k, *rest in _found(common.texts(b), index)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)


def _indexes(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[Callable[[], Index], bool]]:
    """For each pass, a function that gives a Python worker its index, and whether there are several passes. The items of a pass have at most about PASS_BYTES and go to all executors; of
    several passes, each is released when the next is asked for, so what a pass gives must be stored by then."""
    spark = items.sparkSession
    listed = items.select(F.col(item_col).cast("long").alias("item_id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text")).where(F.col("text").isNotNull())
    size = listed.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    passes = max(1, -(-int(size) // PASS_BYTES))
    for k in range(passes):
        part = listed.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(passes)) == k) if passes > 1 else listed
        sent = spark.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in part.orderBy("item_id", "text").collect()])
        made: list[Index] = []

        def index(sent=sent, made=made) -> Index:
            if not made:
                made.append(Index(sent.value))
            return made[0]

        yield index, passes > 1
        if passes > 1:
            sent.destroy()


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of the best window of every row for every item that it leaks.

    Items of fewer than five words are leaked where their words stand in a row. Texts and items without words leak nothing. Repeated items are
    found each; repeated rows are found each; null ids stay null. Ids are cast to long, as the session casts. Items go to all executors,
    PASS_BYTES of them in a pass; a longer list takes several passes over the documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = []
    for index, several in _indexes(items, item_col, item_text_col):
        found = rows.mapInArrow(lambda it, index=index: _leaks(it, index()), LEAK)
        own.append(common.stored(found, "leaks") if several else found)
    return reduce(DataFrame.unionAll, own)


def _clean(batches: Iterator[pa.RecordBatch], index: Index, text_col: str) -> Iterator[pa.RecordBatch]:
    for b in common.parts(batches):
        bad = {k for k, *_ in _found(common.texts(b, text_col), index)}
        yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, with all their columns, judged by their text where they are read: nothing is shuffled."""
    for index, several in _indexes(items, item_col, item_text_col):
        docs = docs.mapInArrow(lambda it, index=index: _clean(it, index(), text_col), docs.schema)
        docs = common.stored(docs, "clean") if several else docs
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) AS n, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM b WHERE len(w) >= {SHINGLE})),
bc AS (SELECT item_id, n, s, count(*) AS c FROM bs GROUP BY ALL),
ds AS (SELECT doc_id, len(w) AS len, i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d WHERE len(w) >= {SHINGLE})),
h AS (SELECT doc_id, least(len, n) AS own, len, i, item_id, n, s, c FROM ds JOIN bc USING (s)),
st AS (SELECT DISTINCT doc_id, item_id, n, own, unnest(range(greatest(1, i - own + {SHINGLE}), least(i, len - own + 1) + 1)) AS p FROM h),
k AS (SELECT st.doc_id, st.item_id, st.n, st.own, p, s, least(count(*), any_value(c)) AS m
  FROM st JOIN h ON h.doc_id = st.doc_id AND h.item_id = st.item_id AND h.i BETWEEN p AND p + st.own - {SHINGLE} GROUP BY st.doc_id, st.item_id, st.n, st.own, p, s),
v AS (SELECT doc_id, item_id, own, p, sum(m) / (n + own - 2 * {SHINGLE - 1} - sum(m)) AS similarity FROM k GROUP BY doc_id, item_id, n, own, p),
q AS (SELECT doc_id, len(b.w) AS n, i, item_id FROM (SELECT d.doc_id, d.w, b.item_id, b.w AS x, unnest(range(1, len(d.w) - len(b.w) + 2)) AS i
  FROM d JOIN b ON len(b.w) BETWEEN 1 AND {SHINGLE - 1} AND list_has_all(d.w, b.w)) z JOIN b USING (item_id) WHERE z.w[i:i + len(b.w) - 1] = b.w)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, arg_max(p, (similarity, -p)) - 1 AS first_word, own AS n_words
FROM v WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id, own
UNION ALL SELECT doc_id, item_id, 1.0, min(i) - 1, n FROM q GROUP BY doc_id, item_id, n"""
