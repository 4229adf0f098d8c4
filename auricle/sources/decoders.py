"""Decoders of compressed audio: a registry, a bound on what is decoded, and a decoder of FLAC.

A decoder takes a file's bytes and gives its samples. Files whose decoded audio would pass CEILING are not decoded, since a cell holds it; neither are codings that nobody
registered. Both are told with a reason, as is a file that its decoder cannot read. Decoded files take the place of the coded ones as plain samples, so that levels,
loudness and spectra read them as they read any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.sources import containers

c = F.col
#: Bytes of decoded audio at most.
CEILING = 256 << 20


class Audio(NamedTuple):
    """Decoded audio: frames by channels of whole numbers of `bits` bits, and the MD5 that the file states of them."""

    samples: np.ndarray
    rate: int
    bits: int
    md5: str | None = None


class Decoder(NamedTuple):
    """name; coding, the codec that sources.containers.formats names; decode, which raises ValueError for what it cannot read."""

    name: str
    coding: str
    decode: Callable[[bytes], Audio]


DECODERS: dict[str, Decoder] = {}


def register(decoder: Decoder) -> None:
    """Adds a decoder; one of the same coding that was there before is replaced."""
    DECODERS[decoder.coding] = decoder


# --------------------------------------------------------------------------------------------------------------- FLAC

# Fixed values of the format: sizes of blocks and sample rates by code (0 where the header says otherwise), depths by code.
BLOCKS = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]
DEPTHS = [0, 8, 12, 0, 16, 20, 24, 32]
#: No sample of 33 bits is larger.
MOST = 1 << 33


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for b in range(256):
        r = b << bits - 8
        for _ in range(8):
            r = (r << 1 ^ poly if r >> bits - 1 else r << 1) & (1 << bits) - 1
        out.append(r)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(raw: bytes) -> int:
    r = 0
    for b in raw:
        r = _CRC8[r ^ b]
    return r


def crc16(raw: bytes) -> int:
    r = 0
    for b in raw:
        r = (r << 8 & 0xFFFF) ^ _CRC16[r >> 8 ^ b]
    return r


class Short(ValueError):
    """There are fewer bytes than what is read needs."""


class _Bits:
    """Bits of a frame from the front. Runs of coded numbers are taken at once: where the next 1 is, is known for every place."""

    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        ones = np.flatnonzero(self.bits)
        after = np.searchsorted(ones, np.arange(len(self.bits) + 1))
        self.next = np.append(ones, len(self.bits))[after].tolist()  # the first 1 at or behind a place
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise Short("a frame ends early")
        value = int("".join(map(str, self.bits[self.at : self.at + n].tolist())) or "0", 2)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def unary(self) -> int:
        n, self.at = self.next[self.at] - self.at, self.next[self.at] + 1
        if self.at > len(self.bits):
            raise Short("a frame ends early")
        return n

    def fields(self, start: np.ndarray, width: int) -> np.ndarray:
        """Unsigned numbers of a width at the places."""
        out = np.zeros(len(start), np.int64)
        for i in range(width):
            out = out << 1 | self.bits[start + i]
        return out

    def plain(self, n: int, width: int) -> np.ndarray:
        """Signed numbers of a width, one after another."""
        if self.at + n * width > len(self.bits):
            raise Short("a frame ends early")
        v = self.fields(self.at + width * np.arange(n), width)
        self.at += n * width
        return np.where(v >> max(width - 1, 0) & 1, v - (1 << width), v) if width else v

    def rice(self, n: int, k: int) -> np.ndarray:
        """Numbers in a Rice code: a count of zeros up to a 1, then k bits."""
        start, at, following, limit = [], self.at, self.next, len(self.bits)
        for _ in range(n):
            start.append(at)
            at = following[at] + 1 + k
            if at > limit:
                raise Short("a frame ends early")
        start = np.array(start, np.int64)
        one = np.array(self.next)[start] if n > 4000 else np.array([following[s] for s in start.tolist()], np.int64)
        self.at = at
        v = (one - start) << k | self.fields(one + 1, k)
        return v >> 1 ^ -(v & 1)


def _residual(bits: _Bits, size: int, order: int) -> np.ndarray:
    method = bits.take(2)
    if method > 1:
        raise ValueError("an unknown coding of residuals")
    width, parts = 4 + method, 1 << bits.take(4)
    if size % parts or size // parts < order:
        raise ValueError("parts of residuals that do not fit a frame")
    out = []
    for i in range(parts):
        n, k = size // parts - (order if i == 0 else 0), bits.take(width)
        out.append(bits.plain(n, bits.take(5)) if k == (1 << width) - 1 else bits.rice(n, k))
    return np.concatenate(out)


def _integrated(warm: list[int], residual: np.ndarray) -> np.ndarray:
    """The signal whose differences of the order of the warm-up are the residual."""
    heads, own = [], np.array(warm, np.int64)
    for _ in warm:
        heads.append(int(own[-1]))
        own = np.diff(own)
    for head in reversed(heads):
        residual = head + np.cumsum(residual)
    return np.concatenate([np.array(warm, np.int64), residual])


def _predicted(warm: list[int], residual: np.ndarray, weights: list[int], shift: int) -> np.ndarray:
    """The signal of a linear predictor; each sample needs those before it."""
    out, order = list(warm), len(warm)
    back = weights[::-1]
    for r in residual.tolist():
        v = r + (sum(map(int.__mul__, back, out[-order:])) >> shift)
        if not -MOST <= v <= MOST:
            raise ValueError("a predictor runs away")
        out.append(v)
    return np.array(out, np.int64)


def _subframe(bits: _Bits, size: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("a subframe without its padding")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    depth -= wasted
    if depth < 1:
        raise ValueError("more wasted bits than there are")
    if kind == 0:
        x = np.full(size, bits.signed(depth), np.int64)
    elif kind == 1:
        x = bits.plain(size, depth)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > size:
            raise ValueError("a predictor longer than its frame")
        warm = [bits.signed(depth) for _ in range(order)]
        if kind < 32:
            x = _integrated(warm, _residual(bits, size, order))
        else:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("a predictor that the format does not allow")
            weights = [bits.signed(precision) for _ in range(order)]
            x = _predicted(warm, _residual(bits, size, order), weights, shift)
    else:
        raise ValueError(f"a subframe of the reserved kind {kind}")
    return x << wasted


def _frame(raw: bytes, depth: int) -> tuple[np.ndarray, int]:
    """The samples of the frame that begins here, frames by channels, and its length in bytes. Both of its checksums must hold."""
    if len(raw) < 6 or raw[0] != 0xFF or raw[1] & 0xFE != 0xF8:
        raise ValueError("no frame begins where one should")
    size, rate, how, code = raw[2] >> 4, raw[2] & 15, raw[3] >> 4, raw[3] >> 1 & 7
    lead = 8 - (raw[4] ^ 0xFF).bit_length()  # ones that begin the number of the frame
    at = 4 + max(lead, 1)
    own = BLOCKS[size]
    if size in (6, 7):
        own = int.from_bytes(raw[at : at + size - 5], "big") + 1
        at += size - 5
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not own or how > 10 or crc8(raw[: at + 1]):
        raise ValueError("a frame's header does not hold")
    depth = DEPTHS[code] or depth
    bits = _Bits(raw[at + 1 :])
    channels = how + 1 if how < 8 else 2
    side = {8: 1, 9: 0, 10: 1}.get(how)
    x = [_subframe(bits, own, depth + (i == side)) for i in range(channels)]
    length = at + 1 + (bits.at + 7) // 8 + 2
    if len(raw) < length:
        raise Short("a frame ends early")
    if crc16(raw[:length]):
        raise ValueError("a frame's checksum does not hold")
    if how == 8:
        x[1] = x[0] - x[1]
    elif how == 9:
        x[0] = x[0] + x[1]
    elif how == 10:
        middle, apart = x[0] << 1 | x[1] & 1, x[1]
        x = [middle + apart >> 1, middle - apart >> 1]
    return np.stack(x, axis=1), length


def flac(content: bytes) -> Audio:
    """All samples of a FLAC file. Every checksum must hold, and as many samples be there as are stated."""
    at = containers.tag_length(content) if content[:3] == b"ID3" else 0
    if content[at : at + 4] != b"fLaC" or len(content) < at + 42:
        raise ValueError("no stream of FLAC")
    at += 4
    info = content[at + 4 : at + 38]
    while True:
        last, at = content[at] & 0x80, at + 4 + int.from_bytes(content[at + 1 : at + 4], "big")
        if last or at + 4 > len(content):
            break
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, depth, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    window = int.from_bytes(info[7:10], "big") or 1 << 14  # bytes of the longest frame, or a guess where it is not stated
    out, count = [], 0
    while at < len(content) and not (total and count >= total):
        try:
            x, length = _frame(content[at : at + window], depth)
        except Short:
            if at + window >= len(content):
                raise
            window *= 2
            continue
        if x.shape[1] != channels:
            raise ValueError("a frame of other channels than the stream's")
        out.append(x)
        at, count = at + length, count + len(x)
    if total and count != total:
        raise ValueError(f"{count} samples of {total} are there")
    md5 = info[18:34]
    return Audio(np.concatenate(out) if out else np.zeros((0, channels), np.int64), rate, depth, md5.hex() if any(md5) else None)


register(Decoder("flac", "flac", flac))


def packed(samples: np.ndarray, bits: int) -> bytes:
    """Whole numbers as little-endian bytes, as many as their bits need."""
    width = (bits + 7) // 8
    return np.ascontiguousarray(samples.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width]).tobytes()


# -------------------------------------------------------------------------------------------------------------- tables

DECODED = "report_id string, content binary, decoder string, reason string, rate long, channels long, bits long, frames long, md5_stated string, md5_holds boolean"


def plan(described: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """report_id, coding, decoder and reason of each file that is not plain samples: which decoder takes it, or why none does. A file whose length is unknown is decoded
    only if its coding is registered and nothing says that it is too long."""
    names = F.create_map(*(F.lit(x) for d in DECODERS.values() for x in (d.coding, d.name))) if DECODERS else F.create_map().cast("map<string,string>")
    size = c("frames") * c("channels") * F.ceil(c("bit_depth") / 8)
    name = F.try_element_at(names, c("codec"))
    reason = F.when(c("codec").isNull(), "The coding is not known.").when(name.isNull(), F.concat(F.lit("Nothing here decodes "), c("codec"), F.lit("."))).when(
        size > ceiling, F.concat(F.lit("Decoded, it would take "), size.cast("string"), F.lit(f" bytes; {ceiling} are decoded at most.")))
    return described.where("codec IS NULL OR codec <> 'pcm'").select("report_id", c("codec").alias("coding"), F.when(reason.isNull(), name).alias("decoder"), reason.alias("reason"))


def decoded(found: DataFrame, described: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """A row (DECODED) for each file that is not plain samples: its samples in whole bytes, little-endian, shifted up to them, or the reason why there are none; the MD5
    that the file states of its samples, and whether it holds."""
    decoders = dict(DECODERS)
    asked = plan(described, ceiling)
    names = [x.split()[0] for x in DECODED.split(", ")]
    kinds = [pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def one(row: dict) -> list:
        try:
            a = decoders[row["coding"]].decode(row["content"])
        except (ValueError, IndexError) as e:
            return [row["report_id"], None, row["decoder"], f"It could not be decoded: {e}.", None, None, None, None, None, None]
        frames, channels = a.samples.shape
        if frames * channels * ((a.bits + 7) // 8) > ceiling:
            return [row["report_id"], None, row["decoder"], f"Decoded, it takes more than {ceiling} bytes.", a.rate, channels, a.bits, frames, a.md5, None]
        holds = hashlib.md5(packed(a.samples, a.bits)).hexdigest() == a.md5 if a.md5 else None
        up = -a.bits % 8
        return [row["report_id"], packed(a.samples << up, a.bits), row["decoder"], None, a.rate, channels, a.bits + up, frames, a.md5, holds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from containers.together((tuple(one(b.to_pylist()[0])) for b in containers.single(batches)), kinds, names)

    taken = found.select("report_id", "content").join(asked.where("decoder IS NOT NULL"), "report_id").mapInArrow(run, DECODED)
    left = asked.where("decoder IS NULL").select("report_id", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) if x.split()[0] != "reason" else c("reason") for x in DECODED.split(", ")[1:]))
    return taken.unionByName(left)


def opened(found: DataFrame, described: DataFrame, ceiling: int = CEILING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files with decoded samples in place of coded ones, their formats as plain samples, and what decoding told (DECODED without content)."""
    told = shared.stored(decoded(found, described, ceiling), "decoded")
    good = told.where("content IS NOT NULL")
    plain = described.where("codec = 'pcm'")
    # as samples of signed bytes, whatever their number
    new = good.select("report_id", c("rate").alias("sample_rate"), "channels", c("bits").alias("bit_depth"), "frames", F.length("content").cast("long").alias("data_bytes"))
    values = {"kind": F.lit("decoded"), "codec": F.lit("pcm"), "codec_family": F.lit("pcm-int"), "is_float": F.lit(False), "little": F.lit(True), "data_offset": F.lit(0).cast("long")}
    new = new.withColumns(values)
    new = new.select(*((c(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in described.schema))
    contents = found.select("report_id", "content").join(plain.select("report_id"), "report_id", "left_semi").unionByName(good.select("report_id", "content"))
    return contents, plain.unionByName(new), told.drop("content")
