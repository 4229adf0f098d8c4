"""Language-model scoring by online logistic context mixing over bits.

A text is a sequence of tokens: its words, then one end. Every token is a few binary decisions, and every decision is predicted by
several contexts, each of which has a hashed slot with the zeros and ones that followed it in training. A slot's opinion is the logarithm
of its ones to its zeros; opinions are added with weights from the set that a gate picks, and an adaptive map refines the sum.

- Match: some three-word contexts are anchors (their hash decides). All words up to the next anchor, FOLLOW at most, are compared with what followed the same
  anchor and the same words since elsewhere in training. Where anything did, one bit says whether the most frequent continuation comes.
  Its contexts are how often that continuation and others came, how the last four such bits ended, and the document's class.
- Code: else the token's code in the code book follows (the BOOK most frequent training tokens by Shannon-Fano splits). Contexts of each bit:
  the document's class, the word before, the two words before. (Longer ones are what matches are for: they are counted exactly, however large the corpus.)
- Spelling: a word outside the book is an escape code, then its bytes and a space, each by a code of its own. Contexts of each bit: the last one to six
  bytes and the whole beginning of the word. It depends on the word alone, so that each distinct word is spelled once,
  and what sorted words begin with in common is spelled once.

Where a document of the training part is scored or learned from, its own occurrence is taken out of the slots of match and code, so a text is
predicted from all others. Weights are learned online, over all training tokens: each task learns over its blocks from the same start,
and the tasks' weights are averaged by what they have seen (iterative parameter mixing), so they depend a little on how rows are dealt
to tasks; the counts do not.

What grows with the corpus is dealt by hash to shards in packed arrays: each block of documents sends a shard its distinct words with
their counts, and its anchors with what follows them; equal ones of a block are sent once, so a common passage weighs as one. Nothing per token but these arrays
is shuffled. What all tasks hold has a fixed size: the code book, the slots, weights and maps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Contexts of spelled bits, in bytes; 0 is the whole beginning of the word.
ORDERS = (1, 2, 3, 4, 5, 6, 0)
SPELL_BITS = 19
#: Slots of the code's contexts, one after the other: class, the word before, the two words before. Match bits have their own in each.
CODE_SLOTS = (1 << 20, 1 << 22, 1 << 22)
CODE_BITS = tuple(x.bit_length() - 1 for x in CODE_SLOTS)
CODE_AT = tuple(int(x) for x in np.cumsum((0, *CODE_SLOTS))[:-1])
BOOK = (1 << 16) - 1
CLASSES, BINS, ROUNDS = 8, 64, 6
#: Words of an anchor's context; one context in ANCHORS is an anchor (those with the smallest hashes); words that are compared after it, at most 31.
CONTEXT, ANCHORS, FOLLOW = 3, 6, 16
#: Distinct words and tokens of a block of documents; one block is held in memory at a time.
BLOCK_WORDS, BLOCK_TOKENS = 400_000, 2_000_000
#: Tokens of a stored row of coded documents, and bits' tokens that are predicted together and in one online step of the weights.
ROW_TOKENS, STEP, BATCH = 100_000, 1 << 11, 1 << 11
#: Words and tokens of a shard, on average.
SHARD_WORDS, SHARD_TOKENS = 400_000, 4_000_000
#: Tokens (or distinct words) of a task that counts slots; such a task sends on a whole table.
TASK_TOKENS, TASK_WORDS = 20_000_000, 1_000_000
#: Slots that travel as one row while the tasks' counts are added up.
PART = 1 << 12
#: Longer words are spelled in pieces.
PIECE = 4096
PRIOR, RATE, CELLS, REACH = 0.1, 0.02, 33, 8.0
#: The end: no word can be a line end.
END = b"\n"
_END = np.uint64(0x13198A2E03707344)
_SMALL = np.uint32(0x9E3779B1)


def pack(x: np.ndarray) -> bytes:
    """An array's bytes, first the lowest of each number, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"")


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def pack_words(found: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(found))


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split()


def _small(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _slot(context: np.ndarray, inner: np.ndarray, way: np.ndarray | np.uint32, bits: int) -> np.ndarray:
    """The slot, of so many bits, of a place within a code or a match, in a context: a group of 16 and a place in it."""
    x = context ^ inner
    x *= _SMALL
    x >>= np.uint32(32 - bits)
    x ^= way
    return x.astype(np.int64)


# The mixer


@dataclass(frozen=True)
class Kind:
    """What is mixed: predictors, slots of all of them, gates, rows of the refining map, first weight, and which predictors' certainty
    takes part in the gate (predictor, levels, logarithms of counts a level). Bounds are those of the predictors' slots."""

    inputs: int
    slots: int
    gates: int
    rows: int
    start: float
    sure: tuple[tuple[int, int, float], ...]
    bounds: tuple[int, ...]


SPELLING = Kind(len(ORDERS), len(ORDERS) << SPELL_BITS, 8 * 8 * 4, 256, 1.5 / len(ORDERS), ((ORDERS.index(0), 8, 1.25), (ORDERS.index(3), 4, 2.5)), tuple(i << SPELL_BITS for i in range(len(ORDERS) + 1)))
#: A gate of code bits: how frequent the word before is (8), early or late bit (2); of match bits: how the last two ended (9), how often the continuation came (8).
#: How much is known after the two words before (4) in all.
SEQUENCE = Kind(len(CODE_SLOTS), sum(CODE_SLOTS), (16 + 72) * 4, 32 + 9, 0.4, ((2, 4, 1.2),), (*CODE_AT, sum(CODE_SLOTS)))


@dataclass
class Bits:
    """Binary decisions: their slots (a row for each input), values, part of the gate, row of the refining map, token, weight and times (1 if None), and whether one occurrence is their own."""

    slots: np.ndarray
    bit: np.ndarray
    gate: np.ndarray
    row: np.ndarray
    token: np.ndarray
    weight: np.ndarray | None
    own: int
    times: np.ndarray | None = None


#: Counts are kept as round(1024 * log2(1 + count)) in 16 bits; this is the way back.
COUNT = np.exp2(np.arange(1 << 16) / 1024) - 1
#: An opinion is kept in 8 bits, so many steps for each unit of the logarithm.
STEPS = 12


def packed(counts: np.ndarray) -> np.ndarray:
    return np.rint(1024 * np.log2(1 + counts)).clip(0, 65535).astype("<u2")


class Opinions:
    """What every slot says: all counts, with a zero less, and with a one less. Certainty is a level of the larger count."""

    def __init__(self, kind: Kind, table: np.ndarray):
        whole = np.log(COUNT + PRIOR).astype(np.float32)
        less = np.log(np.maximum(COUNT - 1, 0) + PRIOR).astype(np.float32)
        self.kind = kind
        #: an opinion and a level for each slot, side by side, so that a look-up finds both
        self.said = np.zeros(3 * kind.slots, np.int16)
        pairs = self.said.view(np.int8).reshape(3, kind.slots, 2)
        for k, (of_zero, of_one) in enumerate(((whole, whole), (less, whole), (whole, less))):
            a, b = of_zero[table[: kind.slots]], of_one[table[kind.slots :]]
            for i, levels, width in kind.sure:
                own = slice(*kind.bounds[i : i + 2])
                pairs[k, own, 1] = np.minimum((np.maximum(a[own], b[own]) - np.float32(np.log(PRIOR))) / np.float32(width), levels - 1)
            b -= a
            b *= STEPS
            pairs[k, :, 0] = np.rint(b, out=b).clip(-127, 127, out=b)

    def of(self, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Each input's log ratio of ones to zeros, in steps, and the gate."""
        gate = bits.gate
        # no place is out of range; "clip" only spares take a look at each
        said = np.take(self.said, bits.slots + (1 + bits.bit) * self.kind.slots if bits.own else bits.slots, mode="clip")
        for i, levels, _ in self.kind.sure:
            gate = gate * levels + (said[i] >> 8)
        return said.view(np.int8)[:, ::2].astype(np.float32), gate


class Slots:
    """The slots of one kind of bits, packed (most are empty or small), and what they say, made once where they are asked."""

    def __init__(self, kind: Kind, table: np.ndarray):
        self.kind, self.table, self.made = kind, pack(table), None

    @property
    def opinions(self) -> Opinions:
        if self.made is None:
            self.made = Opinions(self.kind, unpack(self.table, "<u2"))
        return self.made


def _cell(total: np.ndarray) -> np.ndarray:
    return (total * np.float32((CELLS - 1) / (2 * REACH)) + np.float32(CELLS / 2)).astype(np.int64)


def _sum(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The weighted opinions, within REACH; what is surer than that, the refining map knows."""
    own = np.take(weights, gate, axis=1, mode="clip")
    own *= x
    total = own.sum(axis=0)
    return np.clip(total, np.float32(-REACH), np.float32(REACH), out=total)


class Learner:
    """Weights (inputs, gates), learned online, how much each gate has seen, and the refining map's counts (rows, cells, 2)."""

    def __init__(self, kind: Kind, opinions: Opinions):
        self.kind, self.opinions = kind, opinions
        self.weights = np.full((kind.inputs, kind.gates), kind.start / STEPS, np.float32)
        self.past = np.zeros((kind.inputs, kind.gates))
        self.seen, self.refine = np.zeros(kind.gates), np.zeros(kind.rows * CELLS * 2)

    def add(self, bits: Bits) -> None:
        kind = self.kind
        x, gate = self.opinions.of(bits)
        total = _sum(self.weights, x, gate)
        error = bits.bit.astype(np.float32) - 1 / (1 + np.exp(-total))
        if bits.weight is not None:
            error = error * bits.weight
        mass = np.bincount(gate, bits.weight, kind.gates)
        scale = 1 / np.sqrt(np.maximum(mass, 1e-9))
        x *= error
        step = np.array([np.bincount(gate, own, kind.gates) for own in x]) * (scale / STEPS)
        self.past += step * step
        self.weights += (RATE / STEPS * step / np.sqrt(np.maximum(self.past, 1e-9))).astype(np.float32)
        self.seen += mass
        self.refine += np.bincount((bits.row * CELLS + _cell(total)) * 2 + bits.bit, bits.times, len(self.refine))

    def values(self) -> np.ndarray:
        return np.concatenate([(self.weights * self.seen).ravel(), self.seen, self.refine])


class Model:
    """Slots, weights and refining map of one kind of bits."""

    def __init__(self, kind: Kind, table: np.ndarray, values: np.ndarray):
        self.kind, self.slots = kind, Slots(kind, table)
        w, seen, refine = np.split(values, [kind.gates * kind.inputs, kind.gates * (kind.inputs + 1)])
        self.weights = np.where(seen > 0, w.reshape(kind.inputs, -1) / np.maximum(seen, 1e-9), kind.start / STEPS).astype(np.float32)
        refine = refine.reshape(kind.rows, CELLS, 2)
        prior = 1 / (1 + np.exp(-(np.arange(CELLS) / (CELLS - 1) * 2 - 1) * REACH))
        self.refined = ((refine[:, :, 1] + 8 * prior) / (refine.sum(axis=2) + 8)).astype(np.float32).ravel()

    def log10(self, bits: Bits, tokens: int) -> np.ndarray:
        """log10 probability of each token's bits."""
        x, gate = self.slots.opinions.of(bits)
        total = _sum(self.weights, x, gate)
        p = (1 / (1 + np.exp(-total)) + np.take(self.refined, bits.row * CELLS + _cell(total))) / 2
        return np.bincount(bits.token, np.log10(np.where(bits.bit == 1, p, 1 - p)), tokens)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PART)
    for x in group["counts"]:
        total += unpack(x, "<i8")
    return pd.DataFrame({"part": [group["part"].iloc[0]], "counts": [packed(total).tobytes()]})


def count(table: np.ndarray, kind: Kind, found: Iterable[Bits]) -> None:
    """Adds the zeros and ones of bits to the counts of their slots."""
    for bits in found:
        times = 1 if bits.times is None else np.rint(bits.times).astype(np.int64)
        for own in bits.slots + kind.slots * bits.bit:
            np.add.at(table, own, times)


def fit(rows: DataFrame, kind: Kind, tasks: int, bits_of: Callable[[pa.RecordBatch, int], Iterator[Bits]]) -> Model:
    """A model of all training bits of the rows. What comes back to the driver has a fixed size: slots, weights and map (at most 38 MB)."""
    spark = rows.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * kind.slots, np.int64)
        count(table, kind, (bits for b in batches for bits in bits_of(b, STEP)))
        parts = table.reshape(-1, PART)
        full = np.flatnonzero(parts.any(axis=1))
        for lo in range(0, len(full), 64):
            own = full[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([pack(parts[i]) for i in own], pa.binary())], ["part", "counts"])

    sums = rows.coalesce(max(1, tasks)).mapInArrow(counted, "part int, counts binary").groupBy("part").applyInPandas(_added, "part int, counts binary")
    table = np.zeros((2 * kind.slots // PART, PART), "<u2")
    for part, counts in sums.toLocalIterator():
        table[part] = np.frombuffer(counts, "<u2")
    sent = spark.sparkContext.broadcast(Slots(kind, table.ravel()))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(kind, sent.value.opinions)
        for b in batches:
            for bits in bits_of(b, BATCH):
                learner.add(bits)
        values = learner.values()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "x"])

    found = rows.mapInArrow(learned, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    values = np.zeros(kind.gates * (kind.inputs + 1) + kind.rows * CELLS * 2)
    values[found["i"].to_numpy()] = found["x"].to_numpy()
    sent.unpersist()
    return Model(kind, table.ravel(), values)


# Spelling


#: Masks of up to six bytes of nine bits, what tells orders apart, and where the slots of an order begin.
_MASKS = np.array([(1 << 9 * k) - 1 for k in range(7)], np.uint64)
_SALTS = words.mix(np.arange(1, 8, dtype=np.uint64))
SPELL_AT = (np.arange(len(ORDERS)) << SPELL_BITS)[:, None]


class Beginnings:
    """The bytes of words, each closed by a space, where a byte that a word shares with the word before, and all bytes up to it, is there once.
    Nothing but what stands before it in the word decides on a byte, so that sorted words are spelled in a fraction of the steps."""

    def __init__(self, found: list[bytes]):
        self.n = len(found)
        lengths = np.array([len(t) + 1 for t in found])
        begin = np.cumsum(lengths) - lengths
        self.raw = np.frombuffer(b" ".join(found) + b" ", np.uint8)
        here = np.arange(len(self.raw))
        self.word = np.repeat(np.arange(self.n), lengths)
        self.place = here - begin[self.word]
        before = np.concatenate([begin[:1], begin[:-1]])
        other = np.flatnonzero(self.raw != self.raw[np.minimum(before[self.word] + self.place, len(here) - 1)])
        # a word that is wholly in the one before differs from it at its space, if at all; equal words share all but that
        common = lengths - 1
        np.minimum.at(common, self.word[other], self.place[other])
        common[0] = 0
        # the word where each shared place was new
        new = np.where(common[:, None] <= np.arange(common.max()), np.arange(self.n, dtype=np.int32)[:, None], 0)
        new = np.maximum.accumulate(new, axis=0)
        shared = np.flatnonzero(self.place < common[self.word])
        source = here.copy()
        source[shared] = begin[new[self.word[shared], self.place[shared]]] + self.place[shared]
        self.own = np.flatnonzero(source == here)
        number = np.zeros(len(here), np.int64)
        number[self.own] = np.arange(len(self.own))
        #: of each byte: the number of the own byte that stands for it
        self.number = number[source]

    def summed(self, x: np.ndarray) -> np.ndarray:
        """For every word, the sum of what its bytes have."""
        return np.bincount(self.word, x[self.number], self.n)

    def dealt(self, x: np.ndarray) -> np.ndarray:
        """For every own byte, the sum of what the words have that it is in."""
        return np.bincount(self.number, x[self.word], len(self.own))

    def bits(self, letters: Letters, count: np.ndarray | None) -> Bits:
        """Decisions on own bytes, which are the tokens; with counts, of training words."""
        data, n = self.raw.astype(np.uint64) + np.uint64(1), len(self.raw)
        up, down = words._powers(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(data * up[:n], dtype=np.uint64)])
        # the six bytes before, of nine bits each, none of them 0; what stands before the word is masked
        two = np.concatenate([[np.uint64(0)], data[:-1]])
        two[1:] |= two[:-1] << np.uint64(9)
        last = two.copy()
        for k in (2, 4):
            last[k:] |= two[:-k] << np.uint64(9 * k)
        own, place = self.own, self.place[self.own]
        start, last = own - place, last[own]
        context = np.empty((len(ORDERS), len(own)), np.uint64)
        for x, order in zip(context, ORDERS):
            if order:
                np.bitwise_and(last, _MASKS[np.minimum(place, order)], out=x)
            else:
                np.multiply(sums[own] - sums[start], down[start], out=x)
        context ^= _SALTS[: len(ORDERS), None]
        context *= np.uint64(words.MULTIPLIER)
        context >>= np.uint64(32)
        token, (inner, step, row, way) = letters.spread(letters.symbol[self.raw[own]])
        slots = _slot(np.take(context.astype(np.uint32), token, axis=1), inner, way, SPELL_BITS) + SPELL_AT
        weight, times = (None, None) if count is None else (self.dealt(np.sqrt(count))[token], self.dealt(count)[token])
        return Bits(slots, step & 1, np.minimum(row, 7), step >> 1, token, weight, int(count is not None), times)


def spelled(found: list[bytes], letters: Letters, count: np.ndarray, own: bool) -> Bits:
    """The bits of some words, each closed by a space; of training words with their counts if own."""
    return Beginnings(found).bits(letters, count if own else None)


def _steps(found: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of words of about 3 * size bytes."""
    lo, n = 0, 0
    for i, t in enumerate(found):
        if n and n + len(t) > 3 * size:
            yield lo, i
            lo, n = i, 0
        n += len(t) + 1
    if n:
        yield lo, len(found)


def _pieces(found: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words in pieces of PIECE bytes at most, each spelled with a space, and the place of each piece's word."""
    if max(map(len, found), default=0) <= PIECE:
        return found, np.arange(len(found))
    out = [(w[i : i + PIECE], k) for k, w in enumerate(found) for i in range(0, len(w), PIECE)]
    return [w for w, _ in out], np.array([k for _, k in out])


def _training_words(b: pa.RecordBatch, size: int, letters: Letters) -> Iterator[Bits]:
    for found, count in zip(b.column("words").to_pylist(), b.column("counts").to_pylist()):
        known, count = unpack_words(found), unpack(count, "<i8")
        # from frequent words to rare ones, which are most like words never seen; neighbours share beginnings, so each part is learned from in steps from all over the alphabet
        often = np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), 3)
        for part in (3, 2, 1, 0):
            at = np.flatnonzero((often == part) & (count > 0))
            found, owner = _pieces([known[i] for i in at.tolist()])
            times = count[at].astype(float)[owner]
            steps = list(_steps(found, size))
            for i in np.random.default_rng(len(steps)).permutation(len(steps)).tolist():
                lo, hi = steps[i]
                yield spelled(found[lo:hi], letters, times[lo:hi], True)


def spellings(model: Model, letters: Letters, found: list[bytes]) -> np.ndarray:
    """log10 probability of each word as it is spelled."""
    pieces, owner = _pieces(found)
    out = np.zeros(len(pieces))
    for lo, hi in _steps(pieces, STEP):
        own = Beginnings(pieces[lo:hi])
        out[lo:hi] = own.summed(model.log10(own.bits(letters, None), len(own.own)))
    return np.bincount(owner, out, len(found))


# Codes and matches


#: How many steps a way has gone in its group.
_WAYS = np.array([0, 0, 1, 1, *[2] * 4, *[3] * 8])


class Code:
    """A binary code of symbols, most frequent first, by halving their list where the counts balance."""

    def __init__(self, weights: np.ndarray):
        total = np.concatenate([[0.0], np.cumsum(weights, dtype=float)])
        n = len(weights)
        lo, hi = np.zeros(n, np.int64), np.full(n, n)
        leaves, steps = [], []
        live = np.arange(n)
        while len(live := live[hi[live] - lo[live] > 1]):
            a, b = lo[live], hi[live]
            cut = np.clip(np.searchsorted(total, (total[a] + total[b]) / 2), a + 1, b - 1)
            bit = live >= cut
            leaves.append(live)
            steps.append(cut * 2 + bit)
            lo[live], hi[live] = np.where(bit, cut, a), np.where(bit, b, cut)
        leaves, steps = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (leaves, steps))
        #: of each bit of each code: twice its node (below the number of symbols) and the bit
        self.steps = steps[np.argsort(leaves, kind="stable")]
        self.length = np.bincount(leaves, minlength=n).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        #: four steps share a group of 16 slots: a hash of the node where they begin, and the way from there (1, then a bit more each)
        depth = np.arange(len(self.steps)) - np.repeat(self.start, self.length)
        way = np.ones(len(self.steps), np.int64)
        for k in range(1, 4):
            at = np.flatnonzero(depth % 4 == k)
            way[at] = way[at - 1] * 2 + (self.steps[at - 1] & 1)
        #: twice the node and the bit, the depth (31 at most) and the way in one number
        self.packed = (self.steps << 9 | np.minimum(depth, 31) << 4 | way).astype(np.uint32)

    def spread(self, symbols: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For every bit of the symbols' codes: its symbol's place; then the hash of its group, twice its node and the bit, its depth, and its way."""
        length = self.length[symbols]
        owner = np.repeat(np.arange(len(symbols)), length)
        flat = np.arange(len(owner))
        flat += np.take(self.start[symbols] - (np.cumsum(length) - length), owner)
        at = np.take(self.packed, flat)
        step, way = at >> np.uint32(9), at & np.uint32(15)
        inner = np.take(step, np.arange(len(at)) - np.take(_WAYS, way)) >> np.uint32(1)
        inner *= np.uint32(0x2545F491)
        return owner, (inner, step.astype(np.int64), (at >> np.uint32(4) & np.uint32(31)).astype(np.int64), way)


class Book(Code):
    """Codes of the most frequent tokens; any other is the escape."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, escaped: int):
        weights = np.append(escaped + 1, counts + 1)
        order = np.argsort(-weights, kind="stable")
        self.leaf = {tokens[i - 1]: k for k, i in enumerate(order.tolist()) if i}
        self.escape = int(np.flatnonzero(order == 0)[0])
        super().__init__(weights[order])


class Letters(Code):
    """Codes of all bytes, from how often they stand in the training words; rare ones share a quarter of the codes evenly."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.symbol = np.empty(256, np.int64)
        self.symbol[order] = np.arange(256)
        super().__init__(counts[order] + counts.sum() / 768 + 1)


def anchors(seq: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that follow an anchor's context, the context's hash, and how many tokens from there belong to it."""
    n, stops = len(seq), np.cumsum(lengths)
    h = hashes[seq]
    key = np.zeros(n, np.uint64)
    for j in range(1, CONTEXT + 1):
        key[j:] = key[j:] * np.uint64(words.MULTIPLIER | 1) + h[: max(0, n - j)]
    key = words.mix(key)
    begin = np.repeat(stops - lengths, lengths)
    at = np.flatnonzero((np.arange(n) - begin >= CONTEXT) & (key < np.uint64((1 << 64) // ANCHORS)))
    stop = np.repeat(stops, lengths)[at]
    many = np.minimum(np.minimum(np.append(at[1:], n), stop) - at, FOLLOW)
    return at, key[at], many


class Anchored:
    """The distinct anchors of a block with what follows them, sorted by shard and hash; every occurrence knows its row."""

    def __init__(self, seq: np.ndarray, lengths: np.ndarray, held: np.ndarray, hashes: np.ndarray, shards: int):
        self.at, key, self.many = anchors(seq, lengths, hashes)
        self.hashes = hashes
        self.flat = np.arange(self.many.sum()) - np.repeat(np.cumsum(self.many) - self.many, self.many)
        owner = np.repeat(np.arange(len(self.at)), self.many)
        after = seq[np.repeat(self.at, self.many) + self.flat]
        out = np.repeat(held, lengths)[self.at]
        weight = words.mix(np.arange(1, FOLLOW + 1, dtype=np.uint64))
        digest = np.zeros(len(self.at), np.uint64)
        if len(owner):
            digest = np.add.reduceat(hashes[after] * weight[self.flat], np.cumsum(self.many) - self.many)
        digest = words.mix(digest + key) + words.mix(out.astype(np.uint64) + np.uint64(7) * self.many.astype(np.uint64))
        _, first, inverse, times = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
        shard = (key[first] >> np.uint64(17)) % np.uint64(shards)
        order = np.lexsort((first, key[first], shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.row = place[inverse]
        first = first[order]
        self.key, self.lengths, self.times, self.held = key[first], self.many[first], times[order], out[first]
        self.begin = np.cumsum(self.lengths) - self.lengths
        starts = np.cumsum(self.many) - self.many
        self.after = after[np.repeat(starts[first] - self.begin, self.lengths) + np.arange(self.lengths.sum())]
        self.bounds = np.searchsorted(shard[order], np.arange(shards + 1))

    def rows(self, leaf: np.ndarray, escape: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """For each shard that has any: its number, the hashes, the codes of the words after them, lengths, times and held out marks, and
        the whole hashes of those words that have no code of their own."""
        codes = leaf[self.after].astype("<u2")
        for s in range(len(self.bounds) - 1):
            lo, hi = self.bounds[s], self.bounds[s + 1]
            if lo < hi:
                text = slice(self.begin[lo], self.begin[hi - 1] + self.lengths[hi - 1])
                yield s, pack(np.diff(self.key[lo:hi], prepend=np.uint64(0))), pack(codes[text]), pack((self.times[lo:hi] << 6 | self.held[lo:hi].astype(np.int64) << 5 | self.lengths[lo:hi]).astype("<i8")), pack(self.hashes[self.after[text][codes[text] == escape]])

    def spread(self, answers: dict[int, bytes], n: int) -> np.ndarray:
        """A byte for every token of the block, from the shards' answers for the rows."""
        answer = np.zeros(self.lengths.sum(), np.uint8)
        for s, data in answers.items():
            lo, hi = self.bounds[s], self.bounds[s + 1]
            answer[self.begin[lo] : self.begin[hi - 1] + self.lengths[hi - 1]] = unpack(data, "u1")
        out = np.zeros(n, np.uint8)
        out[np.repeat(self.at, self.many) + self.flat] = answer[np.repeat(self.begin[self.row], self.many) + self.flat]
        return out


SEEN, HIT = 128, 64


def _bucket(n: np.ndarray) -> np.ndarray:
    """0, 1, 2, 3-4, 5-8, ... and 7 for over 32."""
    return np.where(n > 0, np.minimum(1 + np.ceil(np.log2(np.maximum(n, 1))), 7), 0).astype(np.uint8)


def continued(key: np.ndarray, after: np.ndarray, lengths: np.ndarray, times: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For every word after every anchor: SEEN if training has another continuation of that context, HIT if the most frequent one (the first of
    equals by number) is this word, how often it came and how often others came, in three bits each. Training rows do not count one of their own times."""
    n, begin = len(key), np.cumsum(lengths) - lengths
    out = np.zeros(lengths.sum(), np.uint8)
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
    trained = np.where(held, 0, times)
    # anchors that stand alone, once, meet nothing
    alone = ~(same[1:] | same[:-1]) & (trained[order] <= 1)
    rows = order[~alone]
    if not len(rows):
        return out
    f = np.zeros((FOLLOW + 1, len(rows)), np.int32)
    for j in range(FOLLOW):
        live = lengths[rows] > j
        f[j, live] = after[begin[rows[live]] + j]
    # numbers are sorted by halves, which numpy does without comparisons
    halves = [half for x in f[FOLLOW - 1 :: -1] for half in ((x & 0xFFFF).astype(np.uint16), (x >> 16).astype(np.uint16))]
    by = np.lexsort((*halves, key[rows]))
    rows, f = rows[by], f[:, by]
    t, own = trained[rows], (~held[rows]).astype(np.int64)
    new = np.concatenate([[True], key[rows][1:] != key[rows][:-1]])
    for j in range(FOLLOW):
        # rows whose text goes on; a run is one context, a child one continuation of it
        on = np.flatnonzero(lengths[rows] > j)
        if not len(on):
            break
        run = np.cumsum(new)[on]
        child_new = new | np.concatenate([[True], f[j, 1:] != f[j, :-1]])
        child = np.cumsum(child_new)[on]
        run_first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        child_first = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
        run_of = np.cumsum(np.concatenate([[False], run[1:] != run[:-1]]))
        child_of = np.cumsum(np.concatenate([[False], child[1:] != child[:-1]]))
        total, count = np.add.reduceat(t[on], run_first), np.add.reduceat(t[on], child_first)
        child_run = run_of[child_first]
        first_child = np.flatnonzero(np.concatenate([[True], child_run[1:] != child_run[:-1]]))
        best = np.maximum.reduceat(count, first_child)
        number = np.arange(len(count))
        top = np.minimum.reduceat(np.where(count == best[child_run], number, len(count)), first_child)
        rest = np.where(number == top[child_run], -1, count)
        second = np.maximum.reduceat(rest, first_child)
        runner = np.minimum.reduceat(np.where(rest == second[child_run], number, len(count)), first_child)
        c, r, me = child_of, run_of, own[on]
        mine = count[c] - me
        is_top = c == top[r]
        hit = np.where(is_top, (mine > second[r]) | (mine == second[r]) & (c < runner[r]), False)
        came = np.where(is_top & ~hit, second[r], np.where(is_top, mine, best[r]))
        others = total[r] - me - came
        hit &= came > 0
        value = SEEN | hit.astype(np.uint8) * HIT | _bucket(came) << 3 | _bucket(others)
        out[begin[rows[on]] + j] = np.where(came > 0, value, 0)
        new = child_new
    return out


#: By the code of the word before (the last one stands for none): twice a class of frequency of eight, and a hash.
FREQUENT = np.minimum(np.log2(np.arange(BOOK + 2) + 1).astype(np.int64) >> 1, 7) * 2
AFTER = _small((np.arange(BOOK + 2, dtype=np.uint32) + np.uint32(1)) * _SMALL)


class Contexts:
    """What the bits of coded documents are predicted from, a value for every token. own: 1 if they are of the training part, else 0."""

    def __init__(self, leaf: np.ndarray, match: np.ndarray, lengths: np.ndarray, classes: np.ndarray, own: int):
        n = len(leaf)
        self.leaf, self.match = leaf.astype(np.int64), match.astype(np.int64)
        self.classes, self.own = np.repeat(classes.astype(np.int64), lengths), own
        first = np.cumsum(lengths) - lengths

        def back(x: np.ndarray, k: int, outside: int) -> np.ndarray:
            """The value k tokens before; outside where that is before the document."""
            out = np.empty_like(x)
            out[k:] = x[: max(0, n - k)]
            for i in range(k):
                out[np.minimum(first + i, n - 1)[lengths > i]] = outside
            return out

        before = back(self.leaf, 1, BOOK + 1)
        self.frequent, self.one = np.take(FREQUENT, before), np.take(AFTER, before)
        self.two = _small(self.one ^ (back(self.leaf, 2, BOOK + 1).astype(np.uint32) + np.uint32(0x51ED27)) * np.uint32(0x85EBCA77))
        state = np.where(match >= SEEN, 1 + (match >> 6 & 1), 0).astype(np.uint8)
        self.past = sum(back(state, k, 0) * np.uint8(3 ** (k - 1)) for k in range(1, 5))

    def bits(self, book: Book, lo: int, hi: int) -> Iterator[Bits]:
        """The decisions of tokens lo to hi: match bits, then code bits."""
        here = np.arange(lo, hi)
        asked = here[self.match[lo:hi] >= SEEN]
        hit = self.match[asked] >> 6 & 1
        often, others, past = self.match[asked] >> 3 & 7, self.match[asked] & 7, self.past[asked].astype(np.int64)
        flags = [
            CODE_AT[0] + (1 << 19) + (self.classes[asked] << 3 | often) * 9 + past % 9,
            CODE_AT[1] + 81 * (often << 3 | others) + past,
            CODE_AT[2] + _slot(self.one[asked], (64 + (often << 3 | others)).astype(np.uint32), np.uint32(0), CODE_BITS[2]),
        ]
        if len(asked):
            yield Bits(np.array(flags), hit, 16 + (past % 9) * 8 + often, 32 + past % 9, asked - lo, None, self.own)
        coded = here[(self.match[lo:hi] & (SEEN | HIT)) != (SEEN | HIT)]
        owner, (inner, step, row, way) = book.spread(self.leaf[coded])
        slots = np.empty((len(CODE_SLOTS), len(owner)), np.int64)
        np.add(step >> 1, np.take((self.classes[coded] << 16) + CODE_AT[0], owner), out=slots[0])
        for i, x in ((1, self.one), (2, self.two)):
            np.add(_slot(np.take(x[coded], owner), inner, way, CODE_BITS[i]), CODE_AT[i], out=slots[i])
        yield Bits(slots, step & 1, np.take(self.frequent[coded], owner) + (row < 4), row, np.take(coded - lo, owner), None, self.own)


# Blocks, shards and coded rows


BLOCK = "block long, ids binary, named binary, held binary, classes binary, lengths binary, numbers binary, words binary, counts binary, n_words long, n_tokens long, trained_docs long"


def profile(text: bytes) -> np.ndarray:
    """Square roots of the shares of 64 kinds of bytes."""
    n = np.bincount(np.frombuffer(text.translate(common.FOLD), np.uint8) & (BINS - 1), minlength=BINS)
    return np.sqrt(n / max(1, n.sum()))


def nearest(profiles: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((profiles[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([profile(t).astype("<f4").tobytes() for t in common.texts(b)], pa.binary())], ["doc_id", "profile"])


def fit_classes(rows: DataFrame) -> np.ndarray:
    """k-means over the profiles of all training documents; it begins with documents far from each other among those of smallest hash."""
    profiles = common.stored(rows.where("NOT held_out").select("doc_id", "text").mapInArrow(_profiles, "doc_id long, profile binary"), "profiles")
    first = np.array([np.frombuffer(r[0], "<f4") for r in profiles.orderBy(F.xxhash64("profile"), "profile").limit(64).select("profile").collect()] or [np.zeros(BINS)])
    centres = first[:1]
    while len(centres) < CLASSES:
        centres = np.vstack([centres, first[((first[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).argmax()]])
    for _ in range(ROUNDS):
        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros((CLASSES, BINS + 1))
            for b in batches:
                own = np.array([np.frombuffer(x, "<f4") for x in b.column("profile").to_pylist()]).reshape(-1, BINS)
                g = nearest(own, centres)
                np.add.at(total, g, np.column_stack([own, np.ones(len(own))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "x"])

        found = profiles.mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros(CLASSES * (BINS + 1))
        total[found["i"].to_numpy()] = found["x"].to_numpy()
        total = total.reshape(CLASSES, BINS + 1)
        centres = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centres)
    return centres


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], [n for n, _ in fields])


class Numbers(dict):
    """Numbers words as they come."""

    def __init__(self, first: int):
        super().__init__()
        self.first = first

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + self.first
        return number


def _blocks(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per block of documents: their words, numbered as they come (0 is the end), and their texts as numbers."""
    task, blocks = TaskContext.get().partitionId(), 0
    numbers = Numbers(1)
    docs: list[tuple[int | None, bool, int]] = []
    seqs: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids, held, classes = zip(*docs)
        held = np.array(held)
        lengths = np.array([len(s) for s in seqs])
        seq = np.concatenate(seqs)
        counts = np.bincount(seq[np.repeat(~held, lengths)], minlength=len(numbers) + 1)[1:]
        arrays = (np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids]), held, np.array(classes, "u1"), lengths.astype("<i4"), seq.astype("<i4"))
        return _batch([(task << 32 | blocks, *map(pack, arrays), pack_words(list(numbers)), pack(counts.astype("<i8")), len(numbers), len(seq), int((~held).sum()))], BLOCK)

    for b in common.parts(batches):
        texts = common.texts(b)
        classes = nearest(np.array([profile(t) for t in texts]).reshape(-1, BINS), centres).tolist()
        for doc, out, own_class, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), classes, texts):
            docs.append((doc, out, own_class))
            found = text.translate(common.FOLD).split()
            own = np.zeros(len(found) + 1, np.int32)
            own[:-1] = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
            seqs.append(own)
            size += len(own)
            if len(numbers) >= BLOCK_WORDS or size >= BLOCK_TOKENS:
                yield flush()
                numbers.clear()
                docs.clear()
                seqs.clear()
                blocks, size = blocks + 1, 0
    if docs:
        yield flush()


def _hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, in parts that keep the arrays small."""
    return np.concatenate([words.word_hashes([b" ".join(found[i : i + STEP])])[0] for i in range(0, len(found), STEP)] or [np.zeros(0, np.uint64)])


def _of_shards(found: list[bytes], shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words' hashes, and for each shard the places of its words."""
    hashed = _hashes(found)
    shard = (hashed >> np.uint64(11)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return hashed, np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


PAYLOAD = "shard int, block long, a binary, b binary, c binary"
ANCHORED = PAYLOAD + ", d binary"


def _word_rows(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, found, counts in zip(*(b.column(c).to_pylist() for c in ("block", "words", "counts"))):
            found, counts = unpack_words(found), unpack(counts, "<i8")
            yield _batch([(s, block, pack_words([found[i] for i in own.tolist()]), pack(counts[own]), b"") for s, own in enumerate(_of_shards(found, shards)[1]) if len(own)], PAYLOAD)


def _block_anchors(row: dict, found: list[bytes], shards: int) -> Anchored:
    hashes = np.concatenate([[_END], _hashes(found)])
    return Anchored(unpack(row["numbers"], "<i4"), unpack(row["lengths"], "<i4").astype(np.int64), unpack(row["held"], "?"), hashes, shards)


def _leaves(found: list[bytes], book: Book) -> np.ndarray:
    """The codes of the end and of a block's words; the escape for those that have none."""
    return np.array([book.leaf.get(END, book.escape), *(book.leaf.get(w, book.escape) for w in found)])


def _anchor_rows(batches: Iterator[pa.RecordBatch], shards: int, book: Book) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            found = unpack_words(row["words"])
            yield _batch([(s, row["block"], *x) for s, *x in _block_anchors(row, found, shards).rows(_leaves(found, book), book.escape)], ANCHORED)


SHARD = "shard int, words binary, counts binary, n long, v long"


def _shard_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """All distinct words of a shard, sorted, with how often training has them."""
    numbers = Numbers(0)
    total = np.zeros(1 << 16, np.int64)
    for a, b in zip(rows["a"], rows["b"]):
        at = np.array(list(map(numbers.__getitem__, unpack_words(a))))
        if len(numbers) > len(total):
            total = np.concatenate([total, np.zeros(max(len(total), len(numbers)), np.int64)])
        total[at] += unpack(b, "<i8")
    found = list(numbers)
    order = sorted(range(len(found)), key=found.__getitem__)
    total = total[order]
    return pd.DataFrame([(rows["shard"].iloc[0], pack_words([found[i] for i in order]), pack(total), int(total.sum()), int((total > 0).sum()))], columns=["shard", "words", "counts", "n", "v"])


def _bytes_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many training words of a task have each byte at each place, and how many words end."""
    total = np.zeros(256, np.int64)
    for b in batches:
        for found, counts in zip(b.column("words").to_pylist(), b.column("counts").to_pylist()):
            known = [w for w, n in zip(unpack_words(found), unpack(counts, "<i8").tolist()) if n]
            total += np.bincount(np.frombuffer(b" ".join([*known, b""]), np.uint8), minlength=256)
    yield _batch(list(enumerate(total.tolist())), "i int, n long")


def _most_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's words that may be in the code book."""
    for b in batches:
        for found, counts in zip(b.column("words").to_pylist(), b.column("counts").to_pylist()):
            found, counts = unpack_words(found), unpack(counts, "<i8")
            own = np.argsort(-counts, kind="stable")[: BOOK + 1]
            if len(own) > BOOK:  # all of the last one's count stay, so that ties are settled over all shards
                own = np.flatnonzero(counts >= counts[own[-1]])
            own = own[counts[own] > 0]
            yield _batch([(found[i], int(counts[i])) for i in own.tolist()], "word binary, n long")


ANSWER = "shard int, block long, a binary, b binary, matches boolean"


def _word_answers(_: tuple, rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """Counts and spellings of the words that a block asked for."""
    numbers = {w: i for i, w in enumerate(unpack_words(shard["words"].iloc[0]))}
    counts, spelt = unpack(shard["counts"].iloc[0], "<i8"), unpack(shard["spelt"].iloc[0], "<f4")
    out = []
    for s, block, a in zip(rows["shard"], rows["block"], rows["a"]):
        at = np.array(list(map(numbers.__getitem__, unpack_words(a))))
        out.append((s, block, pack(counts[at]), pack(spelt[at]), False))
    return pd.DataFrame(out, columns=["shard", "block", "a", "b", "matches"])


def numbered(codes: np.ndarray, rare: np.ndarray, escape: int) -> np.ndarray:
    """Words as numbers, equal for equal words alone: their codes, or a number past all codes for each distinct hash of those without."""
    out = codes.astype(np.int32)
    out[codes == escape] = (1 << 16) + np.unique(rare, return_inverse=True)[1]
    return out


def _matches(rows: pd.DataFrame, escape: int) -> pd.DataFrame:
    """The continuations of a shard's anchors, for every block."""
    keys = [np.cumsum(unpack(x, "<u8"), dtype=np.uint64) for x in rows["a"]]
    marks = np.concatenate([unpack(x, "<i8") for x in rows["c"]])
    lengths = marks & 31
    after = numbered(np.concatenate([unpack(x, "<u2") for x in rows["b"]]), np.concatenate([unpack(x, "<u8") for x in rows["d"]]), escape)
    answer = continued(np.concatenate(keys), after, lengths, marks >> 6, (marks & 32) > 0)
    ends = np.cumsum(lengths)[np.cumsum([len(k) for k in keys]) - 1]
    parts = np.split(answer, ends[:-1])
    return pd.DataFrame({"shard": rows["shard"], "block": rows["block"], "a": [pack(p) for p in parts], "b": [b""] * len(parts), "matches": True})


CODED = "ids binary, named binary, held binary, classes binary, lengths binary, known binary, base binary, sizes binary, leaves binary, matches binary, spelt binary"


def _coded(block: pd.DataFrame, answers: pd.DataFrame, book: Book, shards: tuple[int, int], n: int, v: int, ends: int) -> pd.DataFrame:
    """The documents of a block as codes and matches, with what does not depend on the mix; a row for about ROW_TOKENS tokens."""
    row = block.iloc[0].to_dict()
    found = unpack_words(row["words"])
    counts, spelt = np.zeros(len(found) + 1, np.int64), np.zeros(len(found) + 1, np.float32)
    counts[0] = ends
    ours = answers[~answers["matches"]]
    places = _of_shards(found, shards[0])[1]
    for s, a, b in zip(ours["shard"], ours["a"], ours["b"]):
        counts[places[s] + 1], spelt[places[s] + 1] = unpack(a, "<i8"), unpack(b, "<f4")
    leaf = _leaves(found, book)
    size = np.array([1, *(len(w) + 1 for w in found)])
    ids, named, held, classes = (unpack(row[c], k) for c, k in (("ids", "<i8"), ("named", "?"), ("held", "?"), ("classes", "u1")))
    lengths, seq = unpack(row["lengths"], "<i4").astype(np.int64), unpack(row["numbers"], "<i4")
    theirs = answers[answers["matches"]]
    match = _block_anchors(row, found, shards[1]).spread(dict(zip(theirs["shard"], theirs["a"])), len(seq))
    first = np.cumsum(lengths) - lengths
    base, known, sizes = (np.add.reduceat(x[seq], first) for x in (np.log10((counts + 1) / (n + v + 1)), (counts > 0).astype(np.int64), size))
    cuts = np.flatnonzero(np.diff(first // ROW_TOKENS)) + 1
    out = []
    for docs in np.split(np.arange(len(ids)), cuts):
        d, t = slice(docs[0], docs[-1] + 1), slice(first[docs[0]], first[docs[-1]] + lengths[docs[-1]])
        leaves = leaf[seq[t]]
        escaped = spelt[seq[t]][leaves == book.escape]
        out.append(tuple(map(pack, (ids[d], named[d], held[d], classes[d], lengths[d].astype("<i4"), known[d], base[d], sizes[d], leaves.astype("<u2"), match[t], escaped))))
    return pd.DataFrame(out, columns=[x.split()[0] for x in CODED.split(", ")])


def _parts(row: dict) -> Iterator[tuple[Contexts, np.ndarray, np.ndarray]]:
    """The training documents of a row, then its held-out ones: contexts, the documents' places, and their tokens' places."""
    held, lengths, classes = unpack(row["held"], "?"), unpack(row["lengths"], "<i4").astype(np.int64), unpack(row["classes"], "u1")
    leaves, matches = unpack(row["leaves"], "<u2"), unpack(row["matches"], "u1")
    for own in (1, 0):
        docs = np.flatnonzero(held != own)
        if len(docs):
            tokens = np.flatnonzero(np.repeat(held != own, lengths))
            yield Contexts(leaves[tokens], matches[tokens], lengths[docs], classes[docs], own), docs, tokens


def _training_bits(b: pa.RecordBatch, size: int, book: Book) -> Iterator[Bits]:
    for row in b.select(["held", "lengths", "classes", "leaves", "matches"]).to_pylist():
        for contexts, _, _ in _parts(row):
            if contexts.own:
                for lo in range(0, len(contexts.leaf), size):
                    yield from contexts.bits(book, lo, min(lo + size, len(contexts.leaf)))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def _scored(row: dict, model: Model, book: Book) -> pa.RecordBatch:
    lengths = unpack(row["lengths"], "<i4").astype(np.int64)
    leaves, matches = unpack(row["leaves"], "<u2"), unpack(row["matches"], "u1")
    value = np.zeros(len(leaves))
    for contexts, _, tokens in _parts(row):
        own = np.zeros(len(tokens))
        for lo in range(0, len(own), STEP):
            hi = min(lo + STEP, len(own))
            for bits in contexts.bits(book, lo, hi):
                own[lo:hi] += model.log10(bits, hi - lo)
        value[tokens] = own
    spelt = np.zeros(len(leaves))
    spelt[leaves == book.escape] = unpack(row["spelt"], "<f4")
    value += np.where((matches & (SEEN | HIT)) == (SEEN | HIT), 0, spelt)
    score = np.add.reduceat(value, np.cumsum(lengths) - lengths) - math.log10(CLASSES)
    ids, named, sizes = unpack(row["ids"], "<i8"), unpack(row["named"], "?"), unpack(row["sizes"], "<i8")
    columns = [pa.array(ids, mask=~named), pa.array(unpack(row["held"], "?")), pa.array(lengths), pa.array(unpack(row["known"], "<i8")), pa.array(unpack(row["base"], "<f8")), pa.array(score), pa.array(-score / math.log10(2) / sizes)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])


def score(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (of the text as it is spelled) of every row.

    held_out: a Column over id_col; its rows are scored but not learned from. A null or empty text is its end token alone. If
    nothing can be learned from, every prediction is even odds. Repeated rows are learned from and scored each time. Ids are cast to
    long, as the session casts.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    centres = fit_classes(rows)
    blocks = common.stored(rows.mapInArrow(lambda it: _blocks(it, centres), BLOCK), "blocks")
    n_words, n_tokens, ends = (int(x or 0) for x in blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("trained_docs")).first())
    shards = (max(1, math.ceil(n_words / SHARD_WORDS)), max(1, math.ceil(n_tokens / SHARD_TOKENS)))
    asked = blocks.select("block", "words", "counts").mapInArrow(lambda it: _word_rows(it, shards[0]), PAYLOAD)
    counted = common.stored(asked.groupBy("shard").applyInPandas(_shard_counts, SHARD), "word-counts")
    n, v = (int(x or 0) for x in counted.agg(F.sum("n"), F.sum("v")).first())
    n, v = n + ends, v + (ends > 0)
    # the most frequent tokens, at most BOOK
    top = counted.select("words", "counts").mapInArrow(_most_frequent, "word binary, n long").orderBy(F.desc("n"), "word").limit(BOOK - 1).toPandas()
    tokens, counts = [*map(bytes, top["word"]), END], np.append(top["n"].to_numpy(np.int64), ends)
    book = spark.sparkContext.broadcast(Book(tokens, counts, n - int(counts.sum())))
    lettered = counted.select("words", "counts").mapInArrow(_bytes_counted, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(256, np.int64)
    seen[lettered["i"].to_numpy()] = lettered["n"].to_numpy()
    letters = Letters(seen)
    spelling = spark.sparkContext.broadcast(fit(counted.select("words", "counts"), SPELLING, math.ceil(v / TASK_WORDS), lambda b, size: _training_words(b, size, letters)))

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, found, c in zip(*(b.column(x).to_pylist() for x in ("shard", "words", "counts"))):
                yield _batch([(shard, found, c, pack(spellings(spelling.value, letters, unpack_words(found)).astype("<f4")))], "shard int, words binary, counts binary, spelt binary")

    valued = counted.select("shard", "words", "counts").mapInArrow(spelt, "shard int, words binary, counts binary, spelt binary")
    answers = asked.select("shard", "block", "a").groupBy("shard").cogroup(valued.groupBy("shard")).applyInPandas(_word_answers, ANSWER)
    anchored = blocks.select("block", "held", "lengths", "numbers", "words").mapInArrow(lambda it: _anchor_rows(it, shards[1], book.value), ANCHORED)
    escape = book.value.escape
    matched = anchored.groupBy("shard").applyInPandas(lambda rows: _matches(rows, escape), ANSWER)
    place = lambda _, block, found: _coded(block, found, book.value, shards, n, v, ends)
    coded = common.stored(blocks.groupBy("block").cogroup(answers.unionAll(matched).groupBy("block")).applyInPandas(place, CODED), "coded")
    model = spark.sparkContext.broadcast(fit(coded, SEQUENCE, math.ceil(n_tokens / TASK_TOKENS), lambda b, size: _training_bits(b, size, book.value)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield _scored(row, model.value, book.value)

    out = coded.mapInArrow(scored, SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"), common.held_out(F.col("doc_id"), 7, 2))
