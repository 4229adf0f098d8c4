"""Byte-level BPE as a monoid: encodings of two neighbours join by re-encoding a window around their seam.

A token sequence is the encoding of its bytes exactly if every adjacent pair of it encodes to itself. So two encodings
join to the right one as soon as a re-encoded window begins with a token that the left side already had there and ends
with one that the right side had: the pairs inside are valid because they were encoded together, the pairs outside because
they stood in the halves, and the two at the window's ends because the outer tokens stayed. Until then the window grows.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pieces up to so many bytes are merged directly.
LEAF = 24
#: Ids up to so many are decoded directly.
SPAN = 4096
#: Encoded pieces that a worker remembers; beyond, it forgets those not met since half of them came.
MEMORY = 300_000
#: Higher than any rank.
NONE = 1 << 62
NAME = "byte_bpe_multi_50k.tiktoken"


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and numbers."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) }


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Joins the adjacent pair of lowest rank, the leftmost first, until no pair has a rank; a heap keeps long pieces n log n, a list is quicker for short ones."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    if n <= LEAF:
        get, cut = ranks.get, list(range(n + 1))
        pairs = [*[get(piece[i : i + 2], NONE) for i in range(n - 1)], NONE]
        while (least := min(pairs)) != NONE:
            i = pairs.index(least)
            del pairs[i], cut[i + 1]
            if i + 2 < len(cut):
                pairs[i] = get(piece[cut[i] : cut[i + 2]], NONE)
            if i:
                pairs[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], NONE)
        return [ranks[piece[i:j]] for i, j in pairwise(cut)]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop or end[i] == stop:
            continue
        alive[j], end[i], after[i] = 0, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Known(dict):
    """Packed ids by piece, in two halves: what is met again moves from the old one to the new one, which becomes the old one when it is full."""

    def __init__(self, made: Callable[[str], bytes]):
        super().__init__()
        self.made, self.old = made, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY // 2:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece) or self.made(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes with one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {i: token for token, i in ranks.items()}
        self.known = Known(self.packed)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes from the encodings of each."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            mid = merge(self.decode(left[-i:] + right[:j]), self.ranks)
            starts, ends = i == len(left) or mid[0] == left[-i], j == len(right) or mid[-1] == right[j - 1]
            if starts and ends:
                return left[:-i] + mid + right[j:]
            i, j = i if starts else 2 * i, j if ends else 2 * j

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return merge(piece, self.ranks)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, piece: bytes) -> list[int]:
        """One match of the pattern; a piece that is itself a token is that token."""
        return [r] if (r := self.ranks.get(piece)) is not None else self.tree(piece)

    def packed(self, piece: str) -> bytes:
        ids = self.piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        """The ids' bytes, concatenated up a tree of halves. Unknown ids raise KeyError."""
        if len(ids) <= SPAN:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decoded(self, ids: bytes | None) -> bytes | None:
        """The bytes of packed ids; None where an id is unknown or the packing is broken."""
        try:
            return self.decode(np.frombuffer(ids or b"", "<u4").tolist())
        except (KeyError, ValueError):
            return None


def _encoded(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[pa.RecordBatch]:
    for b in common.parts(batches):
        ids = [codec.encode(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[pa.RecordBatch]:
    for b in common.parts(batches):
        out = [codec.decoded(v) for v in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])


def _codec(spark: SparkSession, path: str | None, pattern: str | None):
    """A function that gives each Python worker its codec. The table is that of a published tokenizer, of fixed size, so it is broadcast."""
    import public_tokenizers

    with open(path or public_tokenizers.path(NAME), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    pattern = pattern or public_tokenizers.PATTERN
    made: dict[str, Codec] = {}
    return lambda: made.get("codec") or made.setdefault("codec", Codec(load_ranks(sent.value), pattern))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row's whole text; null and empty texts have no ids."""
    codec = _codec(df.sparkSession, path, pattern)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encoded(it, codec()), "doc_id long, ids binary")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes (decoded) that they stand for; null ids decode to no bytes; where an id
    is unknown or the packing is broken, decoded is null."""
    codec = _codec(df.sparkSession, path, None)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return rows.mapInArrow(lambda it: _decoded(it, codec()), "doc_id long, ids binary, decoded binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode and decode in one pass of one Python worker: doc_id, ids, decoded, a row for every row (repeated rows stay repeated)."""
    codec = _codec(df.sparkSession, path, pattern)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _decoded(_encoded(it, codec()), codec()), "doc_id long, ids binary, decoded binary")


def digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(common.read(spark, sf_dir, "documents")))
