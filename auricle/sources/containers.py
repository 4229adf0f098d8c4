"""Audio containers as tables: files -> chunks -> formats -> samples' partial sums.

A small walker lists the chunks of a file of any of the families from one description of their headers; what the chunks say is read
by column expressions over their first bytes. Files come from Spark's binaryFile source (or any column of bytes), so a cluster reads
them in parallel, and a damaged file yields fewer rows, never a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.functions.texts import file_kind

#: Chunks of a file at most, bytes of a chunk that are kept for reading its fields, frames of a block of samples.
MAX_CHUNKS, HEAD, BLOCK = 4096, 64, 1 << 16
#: Rows, and their bytes (about), that leave a task at once.
ROWS, BYTES = 1000, 2 << 20
EXTENSIONS = ["wav", "bwf", "rf64", "aif", "aiff", "aifc", "mp4", "m4a", "flac", "caf", "ogg", "oga", "opus", "mp3"]


@dataclass(frozen=True)
class Layout:
    """first: where chunks begin; id, size: their places and widths in a header; whole: the size counts the header; even: padded to even."""

    first: int
    id: tuple[int, int]
    size: tuple[int, int]
    header: int
    order: str = "big"
    whole: bool = False
    even: bool = False
    enter: tuple[bytes, ...] = ()
    #: Boxes whose children begin after some bytes of their own.
    skip: tuple[tuple[bytes, int], ...] = ()


# How the families lay out their chunk headers.
LAYOUTS = {
    "wav": Layout(12, (0, 4), (4, 4), 8, "little", even=True),
    "aiff": Layout(12, (0, 4), (4, 4), 8, even=True),
    "caf": Layout(8, (0, 4), (4, 8), 12),
    "mp4": Layout(0, (4, 4), (0, 4), 8, whole=True, enter=(b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"meta", b"ilst"), skip=((b"meta", 4),)),
    "flac": Layout(4, (0, 1), (1, 3), 4),
}


def order_of(content: bytes, kind: str) -> str:
    """Byte order of the numbers in a file's chunk headers."""
    return "little" if kind == "wav" and content[:4] != b"RIFX" else "big"


def wide_sizes(body: bytes) -> dict[bytes, int]:
    """Sizes of over 32 bits that a ds64 chunk states, by chunk id."""
    number = lambda at, n: int.from_bytes(body[at : at + n], "little")
    out = {b"data": number(8, 8)} if len(body) >= 16 else {}
    return {body[28 + 12 * i : 32 + 12 * i]: number(32 + 12 * i, 8) for i in range(min(number(24, 4), (len(body) - 28) // 12))} | out


#: Families in the order in which they are asked.
FAMILIES = ("wav", "aiff", "mp4", "flac", "caf", "ogg", "mp3")


def sniffed(content: bytes) -> str | None:
    """The family of a file as kind_of tells it, of bytes or of anything that is sliced like them."""
    head = bytes(content[0:32])
    if len(head) < 4:
        return None
    four, form = head[:4], head[8:12]
    tests = (four in (b"RIFF", b"RF64", b"BW64", b"RIFX") and form == b"WAVE", four == b"FORM" and form in (b"AIFF", b"AIFC"), head[4:8] in (b"ftyp", b"moov", b"mdat"), four == b"fLaC", four == b"caff", four == b"OggS", head[:3] == b"ID3" or head[0] == 255 and head[1] >= 0xE0)
    kind = next((k for k, test in zip(FAMILIES, tests) if test), None)
    if head[:3] == b"ID3" and kind == "mp3":
        after = tag_length(head) - (10 if head[5] & 16 else 0)
        return "flac" if bytes(content[after : after + 4]) == b"fLaC" else kind
    return kind


def walk(content: bytes, kind: str) -> Iterator[tuple[bytes, int, int, int]]:
    """(id, offset of the body, declared size, size that is there) of the chunks of a file, in order. What the generator returns says why it stopped early."""
    if kind == "ogg":
        yield from _pages(content)
        return
    if kind == "mp3":
        yield from _mpeg(content)
        return
    layout, order, wide, short = LAYOUTS.get(kind), order_of(content, kind), {}, None
    at, n = (layout.first if layout else len(content)), 0
    if kind == "flac":
        at += tag_length(content)
    skips = dict(layout.skip) if layout else {}
    while at + (layout.header if layout else 0) <= len(content) and at < len(content) and n < MAX_CHUNKS:
        name = content[at + layout.id[0] : at + sum(layout.id)]
        size = int.from_bytes(content[at + layout.size[0] : at + sum(layout.size)], order)
        body = at + layout.header
        if kind == "caf" and size == 2**64 - 1 or kind == "mp4" and size == 0:
            size = len(content) - (body if kind == "caf" else at)
        if kind == "mp4" and size == 1:
            size, body = int.from_bytes(content[body : body + 8], "big"), body + 8
        if kind == "wav" and size == 2**32 - 1:
            size = wide.get(name, size)
        declared = size - (body - at) if layout.whole else size
        if declared < 0 or not all(32 <= b < 127 or b == 169 and kind == "mp4" for b in name) and kind != "flac":
            return f"no chunk header at byte {at}"
        yield name, body, declared, max(0, min(declared, len(content) - body))
        n += 1
        if body + declared > len(content):
            short = f"the chunk at byte {at} states {declared} bytes, {len(content) - body} are there"
        if name == b"ds64":
            wide = wide_sizes(content[body : body + declared])
        if name in layout.enter:
            at = body + skips.get(name, 0)
            continue
        at = body + declared + (declared % 2 if layout.even else 0)
        if kind == "flac" and name[0] & 128:
            yield b"\xff", at, len(content) - at, len(content) - at
            return
    if n >= MAX_CHUNKS and at < len(content):
        return f"{MAX_CHUNKS} chunks were read, more follow at byte {at}"
    return short


def tag_length(content: bytes) -> int:
    """Bytes of an ID3v2 tag in front of a file: its size is in seven bits of each of four bytes; a footer adds ten."""
    if content[:3] != b"ID3" or len(content) < 10:
        return 0
    size = sum((b & 127) << 7 * (3 - i) for i, b in enumerate(content[6:10]))
    return 10 + size + (10 if content[5] & 16 else 0)


# Fixed values of the MPEG audio frame header: kilobits a second by (version 1 or not, layer) and index; rates of version 1; samples of a frame.
KILOBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = (44100, 48000, 32000)
#: Frames that are walked at most, and bytes in which the first frame must begin.
MAX_FRAMES, SYNC_BYTES = 400_000, 1 << 18


def mpeg_header(h: bytes) -> tuple[int, int, int, int, int] | None:
    """(bytes of the frame, rate, channels, samples, kilobits a second) from a frame header; None for free format and what is no header."""
    if len(h) < 4 or h[0] != 255 or h[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, bits = h[1] >> 3 & 3, 4 - (h[1] >> 1 & 3), h[2] >> 2 & 3, h[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or bits in (0, 15):
        return None
    first = version == 3
    hz = MPEG_RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    kilobits = KILOBITS[first, layer][bits]
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    padding = h[2] >> 1 & 1
    size = (12 * kilobits * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kilobits * 1000 // hz + padding
    return size, hz, 1 if h[3] >> 6 == 3 else 2, samples, kilobits


def walk_head(content: bytes) -> Iterator[tuple[int, int, tuple[int, int, int, int, int]]]:
    """MP3: where the frame stands that a like one follows, where the frames' bytes end, and its header; nothing if there is none."""
    at = tag_length(content[0:10])
    limit = min(len(content), at + SYNC_BYTES)
    while (at := content.find(b"\xff", at, limit)) >= 0:
        if (own := mpeg_header(content[at : at + 4])) and ((following := mpeg_header(content[at + own[0] : at + own[0] + 4])) and following[1:3] == own[1:3] or at + own[0] == len(content)):
            yield at, len(content) - (128 if content[-128:-125] == b"TAG" else 0), own
            return
        at += 1


def _mpeg(content: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """MP3: the frame that a like one follows, as b'mpeg' (declared: the bytes of its stream), then b'Xing' or b'VBRI' where its first frame
    states the number of frames; else b'walk', whose declared size is the number of frames that follow each other."""
    found = next(walk_head(content), None)
    if not found:
        return
    at, end, own = found
    yield b"mpeg", at, end - at, end - at
    side = 4 + (32 if own[3] == 1152 and own[2] == 2 else 9 if own[3] == 576 and own[2] == 1 else 17)
    if content[at + side : at + side + 4] in (b"Xing", b"Info") and content[at + side + 7] & 1:
        yield b"Xing", at + side, 12, 12
    elif content[at + 36 : at + 40] == b"VBRI":
        yield b"VBRI", at + 36, 18, 18
    else:
        frames, here = 0, at
        while frames < MAX_FRAMES and here + 4 <= end and (h := mpeg_header(content[here : here + 4])):
            frames, here = frames + 1, here + h[0]
        yield b"walk", at, frames, frames


def _pages(content: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """Ogg: the first page and the last one of its stream that ends a packet, as id b'page', with the header as the body."""
    serial, last, at, n = content[14:18], None, 0, 0
    while (at := content.find(b"OggS", at)) >= 0 and at + 27 <= len(content):
        size = 27 + content[at + 26] + sum(content[at + 27 : at + 27 + content[at + 26]])
        page = (b"page", at, size, min(size, len(content) - at))
        if n == 0:
            yield page
        if content[at + 14 : at + 18] == serial and content[at + 6 : at + 14] != b"\xff" * 8 and page[2] == page[3]:
            last = page
        at, n = at + max(size, 4), n + 1
    if last and last[1]:
        yield last


CHUNKS = "report_id string, kind string, ord int, id binary, offset long, declared long, available long, head binary, big boolean, track int, audio boolean, stopped string"


def tracked(content: bytes, kind: str) -> list[tuple]:
    """The chunks with the number of the MP4 track that they stand in, and whether they belong to the first audio track (all of other families do)."""
    return tracked_until(content, kind)[0]


def tracked_until(content: bytes, kind: str, walker: Callable[[bytes], Iterator[tuple[bytes, int, int, int]]] | None = None) -> tuple[list[tuple], str | None]:
    """As tracked, and why the walk stopped before the end of the file, an error in a walker included; None if it did not. A walker of one's own takes the place of walk."""
    out, track, sound, reason = [], 0, None, None

    def steps() -> Iterator[tuple[bytes, int, int, int]]:
        nonlocal reason
        try:
            reason = yield from (walker(content) if walker else walk(content, kind))
        except Exception as e:  # what was read until then stands
            reason = f"{type(e).__name__} behind {len(out)} chunks: {e}"

    for name, body, declared, there in steps():
        if kind == "mp4" and name == b"trak":
            track += 1
        if kind == "mp4" and name == b"hdlr" and content[body + 8 : body + 12] == b"soun" and sound is None:
            sound = track
        out.append((name, body, declared, there, content[body : body + min(HEAD, there)], order_of(content, kind) == "big", track))
    return [(*c, kind != "mp4" or c[-1] == sound) for c in out], reason


def listing(report_id: str, kind: str, content: bytes) -> list[tuple]:
    """The rows of a file's chunks; a file without any has one row without a chunk. Every row has why the walk stopped early, if it did."""
    return listed(report_id, kind, *tracked_until(content, kind))


def listed(report_id: str, kind: str, out: list[tuple], reason: str | None) -> list[tuple]:
    return [(report_id, kind, i, *c, reason) for i, c in enumerate(out)] or [(report_id, kind, *[None] * 9, reason or "no chunks")]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
    found = ((b.column(c)[0].as_py() for c in ("report_id", "kind", "content")) for b in single(batches))
    yield from together((x for r, k, content in found if k and content for x in listing(r, k, content)), kinds, names)


def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file at a time, so that no more than one is unpacked."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1)


def together(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most ROWS of them, or as many as have BYTES (an element of a list counts a hundred): many small files share the cost of a batch, a large one has its own."""
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
    for row in rows:
        own = sum(len(x) if isinstance(x, (bytes, str)) else 100 * len(x) for x in row if isinstance(x, (bytes, str, list)))
        if held and (len(held) >= ROWS or size + own > BYTES):
            yield batch()
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield batch()


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """report_id (the path) and content of the files below a path whose extension is that of a known container."""
    pattern = "*.{" + ",".join(e for x in EXTENSIONS for e in (x, x.upper())) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("report_id"), "content")


def synchsafe(head: Column, at: int) -> Column:
    """A number in seven bits of each of four bytes."""
    return sum((unsigned(head, at + i, 1) % 128 * F.lit(1 << 7 * (3 - i)) for i in range(1, 4)), unsigned(head, at, 1) % 128 * F.lit(1 << 21))


def kind_of(content: Column) -> Column:
    """The family of a file: by its first bytes, then, behind an ID3 tag, by what follows the tag; NULL below four bytes."""
    head = F.substring(content, 1, 32)
    behind = F.substring(content, (synchsafe(head, 6) + 11).cast("int"), F.lit(4))
    tagged = (F.substring(head, 1, 3) == F.lit(b"ID3")) & (behind == F.lit(b"fLaC"))
    return F.when(F.length(head) >= 4, F.when(tagged, "flac").otherwise(file_kind(head)))


def chunks(found: DataFrame) -> DataFrame:
    """A row for each chunk of each file (report_id, content)."""
    rows = found.select("report_id", kind_of(F.col("content")).alias("kind"), "content")
    return rows.mapInArrow(_listed, CHUNKS)


def unsigned(head: Column, at: int, width: int, little: bool = False) -> Column:
    """An unsigned integer of up to seven bytes in a column of bytes."""
    part = F.substring(head, at + 1, width)
    digits = F.hex(part)
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))))
    return F.when(F.length(part) == width, F.conv(digits, 16, 10).cast("long"))


def extended(head: Column, at: int) -> Column:
    """The 80-bit floating point number in which AIFF keeps its rate."""
    mantissa = unsigned(head, at + 2, 4) * F.lit(2.0**32) + unsigned(head, at + 6, 4)
    return mantissa * F.pow(F.lit(2.0), (unsigned(head, at, 2) % 32768) - 16383 - 63)


def double(head: Column, at: int) -> Column:
    """A positive big-endian 64-bit floating point number."""
    top = unsigned(head, at, 2)
    fraction = (top % 16) * F.lit(2.0**48) + unsigned(head, at + 2, 6)
    return (1 + fraction / F.lit(2.0**52)) * F.pow(F.lit(2.0), F.floor(top / 16) % 2048 - 1023)


def formats(listed: DataFrame) -> DataFrame:
    """kind, codec, codec_family, sample_rate, channels, bit_depth, byte_rate, block_align, frames, seconds, exact, data_offset, data_bytes, declared
    and shortfall of the audio data, float and little-endian flags of each file.

    Fields come from the chunk that has them (of an MP4 file, from its first audio track); a file without one has NULL there. A WAV file that is not PCM
    has a length only if its fact chunk states frames. One aggregation by file."""
    h, kind, name, big = F.col("head"), F.col("kind"), F.decode(F.col("id"), "ISO-8859-1"), F.col("big")
    of = lambda k, n, x: F.first(F.when((kind == k) & (name == n) & F.col("audio"), x), ignorenulls=True)
    # the stream's description is a block of type 0; others say nothing of the format
    flac = (kind == "flac") & (F.col("ord") == 0) & (unsigned(F.col("id"), 0, 1) % 128 == 0)
    info = lambda x: F.first(F.when(flac, x), ignorenulls=True)
    page = (kind == "ogg") & (F.col("ord") == 0)
    vorbis, opus = F.substring(h, 30, 6) == F.lit(b"vorbis"), F.substring(h, 29, 8) == F.lit(b"OpusHead")
    le = lambda at, w: F.when(big & (kind == "wav"), unsigned(h, at, w)).otherwise(unsigned(h, at, w, True))
    data = (kind.isin("wav", "caf") & (name == "data")) | ((kind == "aiff") & (name == "SSND"))
    # sound data of an AIFF file begin after two numbers, of which the first says how many more bytes come before them
    skip = F.when(kind == "aiff", 8 + F.coalesce(unsigned(h, 0, 4), F.lit(0))).when(kind == "caf", 4).otherwise(0)
    four = lambda at: F.decode(F.substring(h, at + 1, 4), "ISO-8859-1")
    tag = le(0, 2)
    # the extensible tag has the true one at the beginning of its subformat
    tag = F.when((tag == 65534) & (F.length(h) >= 26), le(24, 2)).otherwise(tag)
    version = unsigned(h, 0, 1)
    mpeg = lambda x: F.first(F.when((kind == "mp3") & (name == "mpeg"), x), ignorenulls=True)
    first = F.floor(unsigned(h, 1, 1) / 8) % 4 == 3
    hz = F.get(F.array(*map(F.lit, MPEG_RATES)), (F.floor(unsigned(h, 2, 1) / 4) % 4).cast("int"))
    hz = F.floor(hz / F.when(first, 1).when(F.floor(unsigned(h, 1, 1) / 8) % 4 == 2, 2).otherwise(4))
    per_frame = F.when(F.floor(unsigned(h, 1, 1) / 2) % 4 == 3, 384).when((F.floor(unsigned(h, 1, 1) / 2) % 4 == 1) & ~first, 576).otherwise(1152)
    g = listed.where("id IS NOT NULL").groupBy("report_id").agg(
        F.first("kind").alias("kind"),
        F.coalesce(of("wav", "fmt ", le(4, 4)), of("aiff", "COMM", F.floor(extended(h, 8) + 0.5)), of("caf", "desc", F.floor(double(h, 0) + 0.5)), info(F.floor(unsigned(h, 10, 3) / 16)), of("mp4", "stsd", unsigned(h, 40, 2)), of("mp4", "mdhd", F.when(version == 1, unsigned(h, 20, 4)).otherwise(unsigned(h, 12, 4))), mpeg(hz), F.first(F.when(page & opus, 48000).when(page & vorbis, le(40, 4)), ignorenulls=True)).cast("long").alias("sample_rate"),
        F.coalesce(of("wav", "fmt ", le(2, 2)), of("aiff", "COMM", unsigned(h, 0, 2)), of("caf", "desc", unsigned(h, 24, 4)), info(F.floor(unsigned(h, 12, 1) / 2) % 8 + 1), of("mp4", "stsd", unsigned(h, 32, 2)), mpeg(F.when(F.floor(unsigned(h, 3, 1) / 64) == 3, 1).otherwise(2)), F.first(F.when(page & opus, le(37, 1)).when(page & vorbis, le(39, 1)), ignorenulls=True)).cast("long").alias("channels"),
        F.coalesce(of("wav", "fmt ", le(14, 2)), of("aiff", "COMM", unsigned(h, 6, 2)), of("caf", "desc", unsigned(h, 28, 4)), info((unsigned(h, 12, 1) % 2) * 16 + F.floor(unsigned(h, 13, 1) / 16) + 1)).cast("long").alias("bit_depth"),
        of("wav", "fmt ", le(8, 4)).alias("byte_rate"),
        of("wav", "fmt ", F.when((le(0, 2) == 65534) & (F.length(h) >= 24), le(18, 2))).alias("valid_bits"),
        of("wav", "fmt ", F.when((le(0, 2) == 65534) & (F.length(h) >= 24), le(20, 4))).alias("channel_mask"),
        F.coalesce(of("wav", "fmt ", le(12, 2)), of("caf", "desc", unsigned(h, 16, 4))).alias("block_align"),
        of("wav", "fmt ", tag).alias("tag"),
        of("aiff", "COMM", F.nullif(four(18), F.lit(""))).alias("compression"),
        of("caf", "desc", four(8)).alias("coding"),
        of("mp4", "stsd", four(12)).alias("entry"),
        of("caf", "desc", unsigned(h, 12, 4)).alias("flags"),
        of("wav", "fact", le(0, 4)).alias("fact"),
        F.first(F.when(kind == "wav", big), ignorenulls=True).alias("wav_big"),
        F.coalesce(
            of("aiff", "COMM", unsigned(h, 2, 4)), of("caf", "pakt", unsigned(h, 9, 7)), info((unsigned(h, 13, 1) % 16) * F.lit(2**32) + unsigned(h, 14, 4)),
            F.max(F.when((kind == "ogg") & (F.col("ord") > 0), le(6, 7))) - F.max(F.when(page & opus, le(38, 2)).when(page, 0)),
            of("mp3", "Xing", unsigned(h, 8, 4)) * mpeg(per_frame), of("mp3", "VBRI", unsigned(h, 14, 4)) * mpeg(per_frame), of("mp3", "walk", F.col("declared")) * mpeg(per_frame),
        ).cast("long").alias("stated_frames"),
        F.try_divide(of("mp4", "mdhd", F.when(version == 1, unsigned(h, 25, 7)).otherwise(unsigned(h, 16, 4))).cast("double"), of("mp4", "mdhd", F.when(version == 1, unsigned(h, 20, 4)).otherwise(unsigned(h, 12, 4)))).alias("track_seconds"),
        F.first(F.when(data, F.col("offset") + skip), ignorenulls=True).alias("data_offset"),
        F.first(F.when(data, F.greatest(F.col("available") - skip, F.lit(0))), ignorenulls=True).alias("data_bytes"),
        F.first(F.when(data, F.col("declared") - skip), ignorenulls=True).alias("declared_data"),
        F.first(F.when(data, F.col("declared") - F.col("available")), ignorenulls=True).alias("shortfall"),
    )
    c = F.col
    floating = (F.coalesce("tag", F.lit(0)) == 3) | ((c("coding") == "lpcm") & (c("flags") % 2 == 1)) | F.coalesce(c("compression").isin("fl32", "FL32", "fl64", "FL64"), F.lit(False))
    pcm = F.coalesce(c("tag").isin(1, 3), c("coding") == "lpcm", F.when(c("kind") == "aiff", c("compression").isNull() | c("compression").isin("NONE", "twos", "sowt", "fl32", "FL32", "fl64", "FL64")), F.lit(False))
    codec = F.coalesce(F.when(pcm, "pcm"), F.concat(F.lit("tag "), c("tag").cast("string")), F.trim("compression"), F.trim("coding"), F.trim("entry"), F.when(c("kind").isin("flac", "mp3", "ogg"), c("kind")))
    width = F.floor((F.col("bit_depth") + 7) / 8) * F.col("channels")
    counted = F.when(pcm & (width > 0), F.floor(F.try_divide(F.col("data_bytes"), width)))
    # a header that states more frames than there are is not believed
    frames = F.when(pcm, F.least(counted, F.coalesce("stated_frames", counted))).otherwise(F.coalesce("stated_frames", F.when(c("fact") > 0, c("fact"))))
    seconds = F.coalesce(F.try_divide(frames.cast("double"), F.col("sample_rate")), c("track_seconds"))
    little = F.when(c("kind") == "wav", ~c("wav_big")).when(c("kind") == "aiff", F.coalesce(c("compression") == "sowt", F.lit(False))).otherwise(F.floor(F.coalesce("flags", F.lit(0)) / 2) % 2 == 1)
    out = g.withColumns({
        "codec": codec,
        "codec_family": F.when(pcm & floating, "pcm-float").when(pcm, "pcm-int").when(codec.isNotNull(), "compressed"),
        "frames": frames,
        "seconds": seconds,
        "exact": F.when(seconds.isNotNull(), ~F.coalesce(pcm & ((c("data_bytes") % width != 0) | (c("shortfall") > 0)), F.lit(False))),
        "is_float": floating,
        "little": little,
    })
    return out.drop("tag", "flags", "stated_frames", "compression", "coding", "entry", "fact", "wav_big", "track_seconds")


def decode(raw: bytes, bits: int, is_float: bool, little: bool, unsigned8: bool) -> np.ndarray | None:
    """Samples in [-1, 1]; None for widths that are not decoded."""
    e = "<" if little else ">"
    if is_float:
        return np.frombuffer(raw, f"{e}f{bits // 8}").astype(float) if bits in (32, 64) else None
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        b = b if not little else b[:, ::-1]
        v = b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2]
        return (v - ((v & 0x800000) << 1)) / float(1 << 23)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128 if unsigned8 else np.frombuffer(raw, np.int8) / 128.0
    return np.frombuffer(raw, f"{e}i{bits // 8}") / float(1 << bits - 1) if bits in (16, 32) else None


def block_sums(report_id: str, content: bytes, f: dict) -> Iterator[tuple]:
    """Partial sums of every channel of every block of a file's samples; none where they are not decoded."""
    width = (f["bit_depth"] + 7) // 8 * f["channels"]
    end = f["data_offset"] + min(f["data_bytes"] // width, f["frames"] if f["frames"] is not None else f["data_bytes"]) * width
    for k, at in enumerate(range(f["data_offset"], end, BLOCK * width)):
        x = decode(content[at : min(end, at + BLOCK * width)], f["bit_depth"], f["is_float"], f["little"], f["kind"] == "wav")
        if x is None:
            return
        for channel, own in enumerate(x.reshape(-1, f["channels"]).T):
            good = np.isfinite(own)
            v = own[good]
            top = int(np.argmax(np.abs(v))) if len(v) else None
            # runs of samples at full scale: within the block, and at its edges, where they may go on
            loud = np.flatnonzero(np.diff(np.concatenate([[0], (np.abs(np.nan_to_num(own)) >= FULL_SCALE).astype(np.int8), [0]])))
            runs = loud[1::2] - loud[::2]
            head = int(runs[0]) if len(runs) and loud[0] == 0 else 0
            tail = int(runs[-1]) if len(runs) and loud[-1] == len(own) else 0
            peak = None if top is None else float(abs(v[top]))
            yield report_id, channel, k, len(own), len(v), peak, None if top is None else k * BLOCK + int(np.flatnonzero(good)[top]), float((v * v).sum()), float(v.sum()), int(runs.sum()), int(runs.max(initial=0)), head, tail


SUMS = "report_id string, channel int, block int, frames long, finite long, peak double, peak_frame long, sum_squares double, total double, full long, run long, run_head long, run_tail long"
#: Samples from this size on stand at full scale (the largest 16-bit number does).
FULL_SCALE = 32767 / 32768


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SUMS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    yield from together((x for b in single(batches) for r in b.to_pylist() for x in block_sums(r["report_id"], r["content"], r)), kinds, names)


def channel_levels(found: DataFrame, described: DataFrame) -> DataFrame:
    """Levels of each channel of each file whose samples can be decoded, from the partial sums of its blocks. Runs at full scale go on over blocks."""
    pcm = described.where("codec = 'pcm' AND data_offset IS NOT NULL AND bit_depth % 8 = 0 AND bit_depth > 0 AND channels > 0 AND data_bytes > 0")
    rows = found.join(pcm, "report_id").select("report_id", "content", "kind", *(F.col(c).cast("long") for c in ("bit_depth", "channels", "data_offset", "data_bytes", "frames")), "is_float", "little")
    sums = rows.mapInArrow(_summed, SUMS)
    # a run that fills whole blocks joins the tail before it with the head after it: group the blocks by the last one that it does not fill
    w = Window.partitionBy("report_id", "channel").orderBy("block")
    filled = F.col("run") == F.col("frames")
    sums = sums.withColumn("chain", F.coalesce(F.last(F.when(~filled, F.col("block")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    chains = sums.groupBy("report_id", "channel", "chain").agg(F.sum(F.when(filled, F.col("run")).otherwise(F.col("run_head"))).alias("onward"), F.max("run").alias("inside"))
    tails = sums.select("report_id", "channel", F.col("block").alias("chain"), F.when(~filled, F.col("run_tail")).alias("tail"))
    runs = chains.join(tails, ["report_id", "channel", "chain"], "left").groupBy("report_id", "channel").agg(F.max(F.greatest("inside", F.col("onward") + F.coalesce("tail", F.lit(0)))).alias("longest_run"))
    out = sums.groupBy("report_id", "channel").agg(
        F.sum("frames").alias("frames"),
        (F.sum("frames") - F.sum("finite")).alias("non_finite"),
        F.max("peak").alias("peak"),
        F.max_by("peak_frame", F.struct("peak", -F.col("peak_frame"))).alias("peak_frame"),
        F.sqrt(F.try_divide(F.sum("sum_squares"), F.sum("finite"))).alias("rms"),
        F.try_divide(F.sum("total"), F.sum("finite")).alias("dc_offset"),
        F.sum("full").alias("full_scale"),
        F.when(F.sum("finite") == F.sum("frames"), F.max("peak") == 0).alias("digital_silence"),
    )
    return out.join(runs, ["report_id", "channel"])
