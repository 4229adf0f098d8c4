"""Media columns: bytes as the coefficients of a baseline JPEG, and a reader of baseline JPEGs.

The format's unit is the quantised DCT coefficient. Sixty-four payload bytes make one 8x8 block; byte b is the coefficient b + 1, so
no coefficient is zero, and with all quantisers at 1 nothing is lost. Each block is a restart interval of its own. The reader parses
the markers of any baseline file, decodes all restart intervals of many files in step (one symbol of each at a time, in numpy),
and takes the luminance thumbnail from the DC coefficients alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 64
#: Blocks that are coded or decoded together; bounds a worker's memory whatever the length of a text.
STEP = 16_384
#: Bit lengths of the codes by coefficient size: ASCII letters (7) and blanks, digits and points (6) are the shortest.
CODE_BITS = {7: 1, 6: 2, 8: 3, 4: 4, 1: 5, 2: 8, 3: 8, 5: 8, 9: 8}
NOTE = b"payload-blocks:"


def codes(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """The canonical code and its length of each symbol, from the counts by length of a DHT segment."""
    out, code, i = {}, 0, 0
    for length, count in enumerate(bits, 1):
        for _ in range(count):
            out[symbols[i]] = (code, length)
            code, i = code + 1, i + 1
        code <<= 1
    return out


def lookup(bits: list[int], symbols: list[int]) -> np.ndarray:
    """length * 256 + symbol by the next 16 bits; 0 where no code begins."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in codes(bits, symbols).items():
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


SYMBOLS = sorted(CODE_BITS, key=lambda s: (CODE_BITS[s], s))
BITS = [sum(b == n for b in CODE_BITS.values()) for n in range(1, 17)]
_CODES = codes(BITS, SYMBOLS)
_V = np.arange(256) + 1
_SIZE = np.array([int(v).bit_length() for v in _V])
#: For each byte, its Huffman code followed by the coefficient's bits, and the length of both.
CODE = np.array([_CODES[s][0] << s | int(v) for s, v in zip(_SIZE.tolist(), _V)], np.int64)
LENGTH = np.array([_CODES[s][1] + s for s in _SIZE.tolist()], np.int64)


def padded(text: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(n: int) -> tuple[bytes, int]:
    """What stands before the scan of n payload blocks, and the number of blocks with those that fill the last row."""
    cols = max(-(-n // 8191), int(np.ceil(np.sqrt(n))))
    rows = -(-n // cols)
    head = b"\xff\xd8" + _segment(0xFE, NOTE + str(n).encode()) + _segment(0xDB, b"\0" + b"\1" * 64)
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * cols, 1, 1, 0x11, 0))
    for kind in (0x00, 0x10):
        head += _segment(0xC4, bytes([kind, *BITS, *SYMBOLS]))
    return head + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])), rows * cols


def _scan(blocks: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n, 64), each closed by a restart marker, and where each block ends; number: a block's place in its file."""
    n = len(blocks)
    size = LENGTH[blocks]
    start = np.cumsum(size, axis=1)
    total = start[:, -1].copy()
    start -= size
    n_bytes = (total + 7) >> 3
    base = np.cumsum(n_bytes) - n_bytes
    out = np.zeros(int(n_bytes.sum()) + 3, np.uint8)
    word = CODE[blocks] << (32 - size - (start & 7))
    at = base[:, None] + (start >> 3)
    for k in range(BLOCK):  # no two blocks share a byte
        for shift, i in ((24, 0), (16, 1), (8, 2)):
            out[at[:, k] + i] |= (word[:, k] >> shift & 255).astype(np.uint8)
    out = out[:-3]
    out[base + n_bytes - 1] |= ((1 << (n_bytes * 8 - total)) - 1).astype(np.uint8)
    full = out == 255
    after = np.repeat(np.arange(n), n_bytes) * 2
    place = np.arange(len(out)) + np.cumsum(full) - full + after
    scan = np.zeros(len(out) + int(full.sum()) + 2 * n, np.uint8)
    scan[place] = out
    last = base + n_bytes - 1
    end = place[last] + 1 + full[last]
    scan[end], scan[end + 1] = 0xFF, 0xD0 + number % 8
    return scan, end + 2


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """The JPEG of each payload, whose length is a positive multiple of 64. Blocks of many payloads are coded together."""
    heads = [_head(len(p) // BLOCK) for p in payloads]
    out: list[list[bytes]] = [[head] for head, _ in heads]
    parts, waiting = [], 0  # (payload, first block, blocks)

    def flush() -> None:
        if parts:
            raw = b"".join(payloads[i][BLOCK * a : BLOCK * (a + n)].ljust(BLOCK * n, b"\0") for i, a, n in parts)
            number = np.concatenate([np.arange(a, a + n) for _, a, n in parts])
            scan, end = _scan(np.frombuffer(raw, np.uint8).reshape(-1, BLOCK), number)
            data, at = scan.tobytes(), 0
            for (i, _, _), stop in zip(parts, end[np.cumsum([n for _, _, n in parts]) - 1].tolist()):
                out[i].append(data[at:stop])
                at = stop
            parts.clear()

    for i, (_, blocks) in enumerate(heads):
        for a in range(0, blocks, STEP):
            n = min(STEP, blocks - a)
            parts.append((i, a, n))
            waiting += n
            if waiting >= STEP:
                flush()
                waiting = 0
    flush()
    return [b"".join(x)[:-2] + b"\xff\xd9" for x in out]


@dataclass
class Jpeg:
    """The markers of a baseline file. components: id -> (horizontal, vertical, quantiser); scan: (component, DC table, AC table)."""

    width: int = 0
    height: int = 0
    interval: int = 0
    quantisers: dict = field(default_factory=dict)
    components: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    scan: list = field(default_factory=list)
    note: bytes = b""
    data: bytes = b""


def parse(media: bytes) -> Jpeg:
    """Reads the markers up to the first scan; raises ValueError for what is no baseline JPEG."""
    j, at = Jpeg(), 2
    if media[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at + 4 <= len(media):
        mark, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                j.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif mark in (0xC0, 0xC1):
            _, j.height, j.width, n = struct.unpack(">BHHB", body[:6])
            j.components = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                j.tables[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            j.interval = int.from_bytes(body[:2], "big")
        elif mark == 0xFE:
            j.note = body
        elif mark == 0xDA:
            j.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = media.rfind(b"\xff\xd9")
            j.data = media[at : end if end >= at else len(media)]
            return j
    raise ValueError("no scan")


def _layout(j: Jpeg) -> tuple[int, list[int], int, int]:
    """Number of MCUs, the scan's component index of each block of an MCU, and the luminance grid's rows and columns of blocks."""
    hs, vs = max(c[0] for c in j.components.values()), max(c[1] for c in j.components.values())
    if len(j.scan) == 1:
        h, v, _ = j.components[j.scan[0][0]]
        cols, rows = -(-(-(-j.width * h // hs)) // 8), -(-(-(-j.height * v // vs)) // 8)
        return rows * cols, [0], rows, cols
    across, down = -(-j.width // (8 * hs)), -(-j.height // (8 * vs))
    pattern = [i for i, (c, _, _) in enumerate(j.scan) for _ in range(j.components[c][0] * j.components[c][1])]
    h, v, _ = j.components[j.scan[0][0]]
    return across * down, pattern, down * v, across * h


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _table(spec: bytes) -> np.ndarray:
    if spec not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[spec] = lookup(list(spec[:16]), list(spec[16:]))
    return _LOOKUPS[spec]


def _unstuffed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and restart markers, and where each restart interval begins in them."""
    d = np.frombuffer(data, np.uint8)
    full = np.flatnonzero(d[:-1] == 255) if len(d) else np.zeros(0, int)
    follow = d[full + 1]
    keep = np.ones(len(d), bool)
    keep[full[follow == 0] + 1] = False
    marks = full[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    return d[keep], np.concatenate([[0], np.cumsum(keep)[marks]])


def _symbols(bytes_: np.ndarray, start: np.ndarray, blocks: np.ndarray, pattern: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Coefficients (all blocks, 64) in zigzag order: each interval begins at byte `start` and has `blocks` blocks. dc, ac: a lookup per scan component."""
    b = np.concatenate([bytes_, np.full(8, 255, np.uint8)]).astype(np.int64)
    windows = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]
    coefficients = np.zeros(int(blocks.sum()) * BLOCK, np.int32)
    first = np.cumsum(blocks) - blocks
    n_comp = len(dc)
    live = np.arange(len(start))
    pos, k, done, place = start * 8, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), first * BLOCK
    predicted = np.zeros((len(start), n_comp), np.int64)
    tables = np.concatenate([dc, ac]).ravel()
    limit = len(windows) - 1
    while len(live):
        comp = pattern[done % len(pattern)]
        opening = k == 0
        w = windows[np.minimum(pos >> 3, limit)]
        left = 40 - (pos & 7)
        entry = tables[(np.where(opening, comp, comp + n_comp) << 16) + (w >> (left - 16) & 0xFFFF)]
        length, size, run = entry >> 8, entry & 15, entry >> 4 & 15
        if not length.all():
            raise ValueError("no such code")
        extra = w >> (left - length - size) & (1 << size) - 1
        value = np.where((size > 0) & (extra < (1 << size >> 1)), extra - (1 << size) + 1, extra)
        pos = pos + length + size
        if opening.any():
            rows = np.flatnonzero(opening)
            predicted[rows, comp[rows]] += value[rows]
            value[rows] = predicted[rows, comp[rows]]
            run[rows] = 0
            at = np.where(opening, 0, k + run)
        else:
            at = k + run
        filled = opening | (size > 0)
        if (at[filled] >= BLOCK).any():
            raise ValueError("a block has over 64 coefficients")
        coefficients[(place + at)[filled]] = value[filled]
        k = np.where(filled, at + 1, np.where(run == 15, k + 16, BLOCK))
        over = k >= BLOCK
        if over.any():
            done, k, place = done + over, np.where(over, 0, k), place + BLOCK * over
            open_ = done < blocks
            if not open_.all():
                live, pos, k, done, place, blocks, predicted = (x[open_] for x in (live, pos, k, done, place, blocks, predicted))
    return coefficients.reshape(-1, BLOCK)


def decode_all(media: list[bytes]) -> Iterator[tuple[Jpeg, np.ndarray, int, int]]:
    """Markers, coefficients in zigzag order, and rows and columns of luminance blocks of each file. Files that share tables are decoded in step."""
    jpegs = [parse(m) for m in media]
    i = 0
    while i < len(jpegs):
        group, total = [], 0
        like = lambda j: (tuple(j.tables.get(d) for _, d, _ in j.scan), tuple(j.tables.get(16 + a) for _, _, a in j.scan), tuple(_layout(j)[1]))
        while i < len(jpegs) and (not group or total < STEP and like(jpegs[i]) == like(group[0])):
            group.append(jpegs[i])
            total += _layout(jpegs[i])[0] * len(_layout(jpegs[i])[1])
            i += 1
        datas, starts, counts, shift = [], [], [], 0
        for j in group:
            d, s = _unstuffed(j.data)
            mcus, pattern, _, _ = _layout(j)
            each = j.interval or mcus
            if len(s) != -(-mcus // each):
                raise ValueError("restart markers are missing")
            n = np.full(len(s), each)
            n[-1] = mcus - each * (len(s) - 1)
            datas.append(d)
            starts.append(s + shift)
            counts.append(n * len(pattern))
            shift += len(d)
        dc, ac = (np.stack([_table(t) for t in like(group[0])[x]]) for x in (0, 1))
        pattern = np.array(like(group[0])[2])
        data, start, count = np.concatenate(datas), np.concatenate(starts), np.concatenate(counts)
        parts = []
        for a in range(0, len(start), STEP):
            lo, hi = start[a], start[a + STEP] if a + STEP < len(start) else len(data)
            parts.append(_symbols(data[lo:hi], start[a : a + STEP] - lo, count[a : a + STEP], pattern, dc, ac))
        whole, at = np.concatenate(parts), 0
        for j, c in zip(group, counts):
            n = int(c.sum())
            yield j, whole[at : at + n], *_layout(j)[2:]
            at += n


def thumbnail(j: Jpeg, coefficients: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """A luminance sample (0 to 255) for each 8x8 block, from its DC coefficient alone."""
    _, pattern, _, _ = _layout(j)
    own = [i for i, c in enumerate(pattern) if c == 0]
    dc = coefficients[:, 0].reshape(-1, len(pattern))[:, own]
    h, v, quantiser = j.components[j.scan[0][0]]
    if len(pattern) > 1:
        dc = dc.reshape(rows // v, cols // h, v, h).transpose(0, 2, 1, 3)
    return np.clip(dc.reshape(rows, cols) * j.quantisers[quantiser][0] / 8 + 128, 0, 255)


def thumbnail_hash(image: np.ndarray) -> str:
    """16 hex digits: which cells of an 8x8 grid of means lie above their mean."""
    rows, cols = image.shape
    cell = lambda n: [(i * n // 8, max(i * n // 8 + 1, (i + 1) * n // 8)) for i in range(8)]
    sums = np.zeros((rows + 1, cols + 1))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    grid = np.array([[(sums[b, d] - sums[a, d] - sums[b, c] + sums[a, c]) / ((b - a) * (d - c)) for c, d in cell(cols)] for a, b in cell(rows)])
    return f"{int(''.join('01'[int(x)] for x in (grid > grid.mean()).ravel()), 2):016x}"


def payload_of(j: Jpeg, coefficients: np.ndarray) -> bytes | None:
    """The payload that encode stored, None for any other picture."""
    if not j.note.startswith(NOTE):
        return None
    return (coefficients[: int(j.note[len(NOTE) :])] - 1).astype(np.uint8).tobytes()


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.parts(batches):
        raw = common.texts(b)
        columns = [b.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(encode_all([padded(t) for t in raw]), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])


FEATURES = "width int, height int, thumb_hash string, payload binary, problem string"


def described(media: list[bytes | None]) -> list[tuple]:
    """(width, height, thumbnail hash, payload, problem) of each file; a file that cannot be read has a problem and nothing else."""
    try:
        return [(j.width, j.height, thumbnail_hash(thumbnail(j, c, r, k)), payload_of(j, c), None) for j, c, r, k in decode_all(media)]
    except (ValueError, IndexError, KeyError, TypeError, ZeroDivisionError) as e:
        if len(media) > 1:  # halves are tried until the broken files stand alone
            half = len(media) // 2
            return described(media[:half]) + described(media[half:])
        return [(None, None, None, None, "no media" if media[0] is None else f"no baseline JPEG: {e}")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for b in common.parts(batches):
        out = described(b.column("media").to_pylist())
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
        columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *names])


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the JPEG of each whole text (null: empty; an empty text is one block of zeros)."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, media, width, height, thumb_hash and payload of each baseline JPEG; media that is null or no baseline JPEG has nulls
    and says why in problem."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(_read, f"doc_id long, media binary, {FEATURES}")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column written as a table in the shared folder, read back, and its features, a row for every row."""
    stored = common.stored(store_texts(df, id_col, text_col), "media")
    return stored.mapInArrow(_read, f"doc_id long, n_bytes long, media binary, {FEATURES}")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(common.read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat_ws("x", "width", "height"), "thumb_hash").alias("feature"),
        "width",
        "height",
    )
