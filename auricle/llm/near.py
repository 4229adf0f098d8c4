"""Near-duplicates by SuperMinHash.

Every shingle ranks all slots of a signature by a random permutation of its own: at level j it offers j plus a fraction to the
j-th slot of its permutation. A slot keeps the smallest offer, so once each slot has one, later levels cannot change it and the
document is done (most end at level 0 or 1). Bands of slots give candidates, a 4-bit sketch of the slots and the set sizes drop
pairs far below the threshold, and full shingle sets decide.

Pairs within a bucket are never all made. Equal word sequences are one text from the start. First each text of a bucket meets three
centres of it, and the links found are joined into components. In a bucket that still holds several components, blocks of texts outside its
largest component are held against blocks of all its texts. A task has one block of each. At first it gets sketches and sizes alone and
names the texts that any other may link with; only their texts are then sent, and the task goes through what is near, nearest first,
leaving out what its own links have joined by then. Only links leave the task. So every pair of a bucket is linked through others, or
compared, or too far apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, words

SHINGLE, PERCENT = 5, 75
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Slots whose 4 bits may differ. At similarity 0.75 the mean is 30 and the deviation 4.8.
SKETCH_DIFFERENCE = 56
#: Texts of a block of a bucket, and rows of the matrix of sketches that is made at once.
BLOCK, STRIPE = 1024, 64
#: So many ids (8 bytes each) are sent to all executors to pick out the texts to compare; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a text of fewer than k words is one shingle, one without words has none."""
    hashed, counts = words.word_hashes([t.translate(common.FOLD) for t in texts])
    value = words.shingle_hashes(hashed, k)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            own = np.unique(value[at : at + n - k + 1])
        elif n:
            own = words.mix(np.array([int(words.shingle_hashes(hashed[at : at + n], n)[0]) ^ n], np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set, (sets, SLOTS); level in the upper and fraction in the lower half. Empty sets stay at the maximum."""
    sizes = np.array([len(s) for s in sets])
    h = np.full((len(sets), SLOTS), _EMPTY)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    low = np.uint64(0xFFFFFFFF)
    order = None
    for level in range(SLOTS):
        if not len(element):
            break
        r = words.mix(element + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = level + ((r & low) % np.uint64(SLOTS - level)).astype(np.int64)
        if order is None:
            slot = k
        else:
            rows = np.arange(len(element))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, level]
        np.minimum.at(h.reshape(-1), doc * SLOTS + slot, r >> np.uint64(32) | np.uint64(level << 32))
        still = (h == _EMPTY).any(axis=1)[doc]
        if level == 0:
            order = np.tile(np.arange(SLOTS, dtype=np.uint8), (int(still.sum()), 1))
            order[np.arange(len(order)), k[still]] = 0
        else:
            order = order[still]
        element, doc = element[still], doc[still]
    return h


def band_keys(h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h), BANDS), np.uint64)
    for j in range(ROWS):
        out = words.mix(out + h[:, j::ROWS])
    return words.mix(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    """Four bits of every slot, 16 slots to a 64-bit integer."""
    bits = (words.mix(h) & np.uint64(15)).reshape(len(h), SLOTS // 16, 16)
    return np.bitwise_or.reduce(bits << np.arange(0, 64, 4, dtype=np.uint64), axis=2).view(np.int64)


def differing(a: str, b: str) -> Column:
    """Number of slots of two sketches whose bits differ, from bit operations on the integers."""
    mask = F.lit(0x1111111111111111)

    def one(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        return F.bit_count(any_bit.bitwiseAND(mask))

    return sum((one(i) for i in range(1, SLOTS // 16)), one(0))


ROW = "doc_id long, h1 long, h2 long, n_shingles long, bands array<long>, sketch array<long>"


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.parts(batches):
        texts, ids = common.texts(b), b.column("doc_id")
        for lo, hi in words.chunks(texts):
            sets = shingle_sets(texts[lo:hi])
            h = signatures(sets)
            whole = np.array([np.frombuffer(hashlib.blake2b(b" ".join(t.translate(common.FOLD).split()), digest_size=16).digest(), "<i8") for t in texts[lo:hi]])
            n = np.array([len(s) for s in sets], np.int64)
            columns = [ids.slice(lo, hi - lo), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(n), _lists(band_keys(h)), _lists(sketch(h))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROW.split(", ")])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets reach the threshold. Rows come ordered by a, whose set is made once."""
    last: tuple[bytes, np.ndarray] | None = None
    for b in batches:
        left, right = common.texts(b, "text_a"), common.texts(b, "text_b")
        good = []
        for x, y in zip(left, right):
            if last is None or last[0] != x:
                last = (x, shingle_sets([x])[0])
            own = shingle_sets([y])[0]
            good.append(_reaches(last[1], own))
        yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _reaches(a: np.ndarray, b: np.ndarray) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= PERCENT * (len(a) + len(b) - inter)


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """(bucket, i, j), the texts outside the main component and all texts of each pair of blocks; rows come sorted by (key, i, j)."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "apart", *columns))))
    for at, group in groupby(rows, key=lambda r: r[:3]):
        mine, all_ = [], []
        for r in group:
            (mine if r[3] else all_).append(r[4:])
        if mine and all_:
            yield at, mine, all_


def _close(mine: list[tuple], all_: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in mine, in all) and distances of sketches that may belong to linked texts of different components. Rows begin with rep, comp, n_shingles and sketch."""
    n, m = (np.array([r[2] for r in side]) for side in (mine, all_))
    c, d = (np.array([r[1] for r in side]) for side in (mine, all_))
    x, y = (np.array([r[3] for r in side], np.int64).view(np.uint64) for side in (mine, all_))
    out = []
    for lo in range(0, len(mine), STRIPE):
        own = slice(lo, lo + STRIPE)
        near = (np.minimum(n[own, None], m) * 100 >= np.maximum(n[own, None], m) * PERCENT) & (c[own, None] != d)
        p, q = np.nonzero(near)
        bits = x[own][p] ^ y[q]
        bits |= bits >> np.uint64(1)
        bits |= bits >> np.uint64(2)
        distance = np.bitwise_count(bits & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
        keep = distance <= SKETCH_DIFFERENCE
        out.append((p[keep] + lo, q[keep], distance[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which texts a pair of blocks needs: (key, i, j, apart, rep)."""
    for at, mine, all_ in _groups(batches, ("rep", "comp", "n_shingles", "sketch")):
        p, q, _ = _close(mine, all_)
        out = [(*at, apart, side[k][0]) for apart, side, places in ((True, mine, p), (False, all_, q)) for k in np.unique(places).tolist()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["key", "i", "j", "apart", "rep"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between texts of different components."""
    for _, mine, all_ in _groups(batches, ("rep", "comp", "n_shingles", "sketch", "text")):
        out: list[tuple[int, int]] = []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        sets: dict[int, np.ndarray] = {}

        def set_of(row: tuple) -> np.ndarray:
            if row[0] not in sets:
                sets[row[0]] = shingle_sets([row[4].encode()])[0]
            return sets[row[0]]

        p, q, distance = _close(mine, all_)
        for k in np.argsort(distance, kind="stable").tolist():
            u, v = mine[p[k]], all_[q[k]]
            if (a := root(u[1])) != (b := root(v[1])) and _reaches(set_of(u), set_of(v)):
                parent[max(a, b)] = min(a, b)
                out.append((min(u[0], v[0]), max(u[0], v[0])))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids, sent to all executors if they are few."""
    ids = common.stored(ids.distinct(), "compared")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return common.stored(docs.join(ids, "doc_id", "left_semi").distinct(), "compared-texts")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) among pairs, confirmed on the full sets; where an id has several texts, a link may be repeated."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    near = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT) & (differing("s_a", "s_b") <= SKETCH_DIFFERENCE)
    pairs = common.stored(sized.where(near).select("a", "b"), "pairs")
    texts = _texts(docs, pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")))
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return common.stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long"), "links")


def _across(members: DataFrame, labels: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between different components (labels) that meet in a bucket (key, rep), some of them repeatedly."""
    labelled = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    labelled = common.stored(labelled, "labelled")
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("comps"))
    # stored, so that both sides of the join are plain scans: a hot bucket's rows are then split over tasks
    main = common.stored(main.where("comps > 1").drop("comps"), "mixed-buckets")
    full = labelled.join(main, "key").join(reps.select("rep", "n_shingles", "sketch"), "rep")
    full = full.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["key", "i", "j", "apart", "rep", "comp", "n_shingles", "sketch"]
    mine = full.where("comp <> main").withColumns({"i": F.col("block"), "apart": F.lit(True)}).withColumn("j", other).select(columns)
    every = full.withColumns({"j": F.col("block"), "apart": F.lit(False)}).withColumn("i", other).select(columns)
    tasks = common.stored(mine.unionAll(every), "blocks")
    wanted = common.stored(tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_wanted, "key long, i int, j int, apart boolean, rep long"), "wanted")
    texts = _texts(docs, wanted.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    needed = tasks.join(wanted, ["key", "i", "j", "apart", "rep"]).join(texts, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return common.stored(needed.mapInArrow(_blocks, "a long, b long"), "more-links")


def _joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Components (id, comp) from those of the first links and links found since, whose ends stand for their components."""
    if more.isEmpty():
        return labels
    label = lambda x: labels.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}"))
    ends = more.join(label("a"), "a", "left").join(label("b"), "b", "left")
    merged = graph.components(ends.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")))
    merged = common.stored(merged.select(F.col("id").alias("comp"), F.col("comp").alias("new")), "merged")
    old = labels.join(merged, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp"))
    return old.unionAll(merged.select(F.col("comp").alias("id"), F.col("new").alias("comp"))).distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (doc_id = component_id), a row for every row.

    Texts without words have no shingles and no links. Rows with the same id are one node. A row with a null id links with nothing; its
    component is null and it is kept. Ids are cast to long, as the session casts.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = common.stored(docs.mapInArrow(_signed, ROW), "signatures")
    whole = ["h1", "h2"]
    reps = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*whole).agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    reps = common.stored(reps, "distinct-texts")
    entries = reps.select("rep", F.explode("bands").alias("key"))
    centres = [F.min("rep").alias("c0"), *(F.min_by("rep", F.xxhash64("rep", F.lit(i))).alias(f"c{i}") for i in (1, 2))]
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), *centres).where("n > 1").drop("n")
    members = common.stored(entries.join(buckets, "key"), "buckets")
    star = members.select("rep", F.explode(F.array("c0", "c1", "c2")).alias("c")).where("rep <> c")
    links = _verified(star.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")), docs, reps)
    labels = common.stored(graph.components(links), "components")
    more = _across(members.select("key", "rep"), labels, docs, reps)
    comps = _joined(labels, more).withColumnRenamed("id", "rep")
    named = reps.select(*whole, "rep").join(comps, "rep", "left").select(*whole, F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("doc_id", *whole, "n_shingles").join(named, whole, "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("comp"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.read(spark, sf_dir, "documents"))


OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
