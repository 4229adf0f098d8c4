"""Metadata of audio files as rows: file -> (scheme, key, place, value), and one value of each field by scheme.

Each scheme has a short reader of its own records; a damaged record ends its scheme's list and nothing else. Fields of all schemes meet
in one table of codes, so that a title is a title whatever the container.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.sources import containers, ogg

# What the schemes call the common fields. (field, ID3 2.3 and 2.4, ID3 2.2, RIFF INFO, iTunes, Vorbis, AIFF)
FIELDS = [
    ("title", "TIT2", "TT2", "INAM", "©nam", "TITLE", "NAME"),
    ("artist", "TPE1", "TP1", "IART", "©ART", "ARTIST", "AUTH"),
    ("album", "TALB", "TAL", "IPRD", "©alb", "ALBUM", None),
    ("comment", "COMM", "COM", "ICMT", "©cmt", "COMMENT", "ANNO"),
    ("genre", "TCON", "TCO", "IGNR", "©gen", "GENRE", None),
    ("date", "TDRC", "TYE", "ICRD", "©day", "DATE", None),
    ("track", "TRCK", "TRK", "ITRK", "trkn", "TRACKNUMBER", None),
    ("tempo", "TBPM", "TBP", None, "tmpo", "BPM", None),
    ("isrc", "TSRC", "TRC", "ISRC", None, "ISRC", None),
    ("key", "TKEY", "TKE", None, None, "INITIALKEY", None),
    ("copyright", "TCOP", "TCR", "ICOP", "cprt", "COPYRIGHT", "(c) "),
    ("software", "TSSE", "TSS", "ISFT", "©too", "ENCODER", None),
    ("encoded_by", "TENC", "TEN", "ITCH", "©enc", "ENCODED-BY", None),
    ("composer", "TCOM", "TCM", "IMUS", "©wrt", "COMPOSER", None),
    ("publisher", "TPUB", "TPB", None, None, "ORGANIZATION", None),
]
# The order in which schemes are believed, and which of a repeated key counts.
SCHEMES = ["id3v2", "itunes", "vorbis", "info", "aiff", "caf", "id3v1"]
# Text fields of a broadcast extension chunk (name, offset, bytes) and where its numbers are.
BEXT_TEXT = [("description", 0, 256), ("originator", 256, 32), ("originator_reference", 288, 32), ("origination_date", 320, 10), ("origination_time", 330, 8)]
BEXT_TIME, BEXT_VERSION, BEXT_LOUDNESS, BEXT_HISTORY = 338, 346, 412, 602
# How a manifest shows itself, the bytes in which it does and in which its claims are read, and the kinds of source that claims name.
MANIFEST_BYTES, CLAIM_BYTES = 512, 1 << 16
SOURCE_TYPES = ["trainedalgorithmicmedia", "compositewithtrainedalgorithmicmedia", "algorithmicmedia", "digitalcapture", "algorithmicallyenhanced", "compositecapture", "humanedits"]
ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}

Found = Iterator[tuple[str, str, str]]


def cut(raw: bytes) -> str:
    """Text up to the first zero byte, as UTF-8 if it is, else as Latin-1, without outer blanks."""
    raw = raw.split(b"\0", 1)[0]
    try:
        return raw.decode().strip()
    except UnicodeDecodeError:
        return raw.decode("latin-1").strip()


def info_list(body: bytes, order: str) -> Found:
    """Fields of a LIST chunk of the INFO kind, and labels of the adtl kind as (adtl, cue id, text)."""
    kind, at = body[:4], 4
    while at + 8 <= len(body):
        name, size = body[at : at + 4].decode("latin-1"), int.from_bytes(body[at + 4 : at + 8], order)
        value = body[at + 8 : at + 8 + size]
        if kind == b"INFO" and cut(value):
            yield "info", name, cut(value)
        elif kind == b"adtl" and name in ("labl", "note") and len(value) > 4:
            yield "adtl", str(int.from_bytes(value[:4], order)), cut(value[4:])
        at += 8 + size + size % 2


def bext(body: bytes, order: str) -> Found:
    """A broadcast extension: its texts, sample count since midnight, version, loudness figures from version 2 on, coding history."""
    if len(body) < BEXT_VERSION + 2:
        return
    for name, at, size in BEXT_TEXT:
        if value := cut(body[at : at + size]):
            yield "bext", name, value
    version = int.from_bytes(body[BEXT_VERSION : BEXT_VERSION + 2], order)
    yield "bext", "time_reference", str(int.from_bytes(body[BEXT_TIME : BEXT_TIME + 8], order))
    yield "bext", "version", str(version)
    if version >= 2 and len(body) >= BEXT_LOUDNESS + 10:
        for i, name in enumerate(("loudness_value", "loudness_range", "max_true_peak", "max_momentary", "max_short_term")):
            number = int.from_bytes(body[BEXT_LOUDNESS + 2 * i : BEXT_LOUDNESS + 2 * i + 2], order, signed=True)
            if number != 0x7FFF:  # stated as unknown
                yield "bext", name, f"{number / 100:.2f}"
    if history := cut(body[BEXT_HISTORY:]):
        yield "bext", "coding_history", history


def cues(body: bytes, order: str) -> Found:
    """Cue points as (cue, id, sample)."""
    n = int.from_bytes(body[:4], order)
    for at in range(4, min(4 + 24 * n, len(body) - 23), 24):
        yield "cue", str(int.from_bytes(body[at : at + 4], order)), str(int.from_bytes(body[at + 20 : at + 24], order))


def sampler(body: bytes, order: str) -> Found:
    """A sampler chunk: the note that it plays unchanged, the length of a sample in nanoseconds, and each loop as (loop, id, start-end)."""
    number = lambda at: int.from_bytes(body[at : at + 4], order)
    if len(body) >= 36:
        yield "smpl", "sample_ns", str(number(8))
        yield "smpl", "unity_note", str(number(12))
        for at in range(36, min(36 + 24 * number(28), len(body) - 23), 24):
            yield "loop", str(number(at)), f"{number(at + 8)}-{number(at + 12)}"


def acid(body: bytes, order: str) -> Found:
    """A loop's beats, metre, tempo, root note and whether it is played once."""
    number = lambda at, n: int.from_bytes(body[at : at + n], order)
    if len(body) >= 24:
        yield "acid", "one_shot", str(bool(number(0, 4) & 1)).lower()
        if number(0, 4) & 2:
            yield "acid", "root_note", str(number(4, 2))
        yield "acid", "beats", str(number(12, 4))
        yield "acid", "metre", f"{number(18, 2)}/{number(16, 2)}"
        tempo = struct.unpack("<f" if order == "little" else ">f", body[20:24])[0]
        if 0 < tempo < float("inf"):
            yield "acid", "tempo", f"{tempo:.6g}"


def chna(body: bytes, order: str) -> Found:
    """Tracks of an audio definition model: (chna, unique id, track, reference and pack)."""
    for k in range(min(int.from_bytes(body[2:4], order), (len(body) - 4) // 40)):
        own = body[4 + 40 * k : 44 + 40 * k]
        yield "chna", cut(own[2:14]), f"{int.from_bytes(own[:2], order)} {cut(own[14:28])} {cut(own[28:39])}".strip()


_GENERATOR = re.compile(rb'claim_generator"?\s*[:=]?\s*"([^"]{1,120})"', re.I)


def manifest(body: bytes) -> Found:
    """Signs of a provenance manifest: evidence, the kinds of source that its claims name, and what made the claim. Its signature is not checked."""
    head = body[:MANIFEST_BYTES]
    if b"c2pa" not in head:
        return
    if b"jumb" in head or b"jumd" in head:
        yield "c2pa", "evidence", "labelled box"
    elif any(sign in head for sign in (b"c2pa.assertions", b"c2pa.claim", b"urn:uuid")):
        yield "c2pa", "evidence", "claim structure"
    else:
        return
    claims = body[:CLAIM_BYTES]
    low = claims.lower().decode("latin-1")
    yield from (("c2pa", "source_type", kind) for kind in SOURCE_TYPES if kind in low)
    if made := _GENERATOR.search(claims):
        yield "c2pa", "generator", made[1].decode("latin-1").strip()


def synchronised(raw: bytes) -> bytes:
    """Bytes without the zeros that keep players from seeing frames in a tag."""
    return raw.replace(b"\xff\0", b"\xff")


def id3_text(raw: bytes) -> str:
    """The text of a frame that begins with its encoding; several values are joined by slashes."""
    text = raw[1:].decode(ENCODINGS.get(raw[0], "latin-1"), "replace") if raw else ""
    return "/".join(t.strip() for t in text.split("\0") if t.strip())


def id3v2(content: bytes) -> Found:
    """Frames of an ID3v2 tag (versions 2.2 to 2.4): texts, comments, and user texts as TXXX:description."""
    length = containers.tag_length(content)
    if not length or content[3] not in (2, 3, 4):
        return
    version, flags = content[3], content[5]
    safe = lambda b: sum((x & 127) << 7 * (len(b) - 1 - i) for i, x in enumerate(b))
    body = content[10 : min(length, len(content))]
    if flags & 128 and version < 4:
        body = synchronised(body)
    at = 0
    if flags & 64 and version > 2:  # an extended header
        at = safe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at] > 32:
        name = body[at : at + name_size].decode("latin-1")
        raw_size = body[at + name_size : at + 2 * name_size]
        size = safe(raw_size) if version == 4 else int.from_bytes(raw_size, "big")
        value = body[at + head : at + head + size]
        if version == 4 and body[at + 9] & 2:
            value = synchronised(value)
        if version == 4 and body[at + 9] & 1:  # its length stands in front
            value = value[4:]
        at += head + size
        if name in ("COMM", "COM") and len(value) > 4:  # a language, a description, then the text
            parts = id3_text(value[:1] + value[4:]).split("/", 1)
            yield "id3v2", name, parts[-1]
        elif name in ("TXXX", "TXX") and "/" in (text := id3_text(value)):
            key, text = text.split("/", 1)
            yield "id3v2", f"TXXX:{key}", text
        elif name.startswith("T") and (text := id3_text(value)):
            yield "id3v2", name, text


def id3v1(content: bytes) -> Found:
    """The 128 bytes at a file's end."""
    tag = content[-128:]
    if len(tag) == 128 and tag[:3] == b"TAG":
        for name, at, size in (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("date", 93, 4), ("comment", 97, 28 if tag[125] == 0 and tag[126] else 30)):
            if value := tag[at : at + size].split(b"\0")[0].decode("latin-1").strip():
                yield "id3v1", name, value
        if tag[125] == 0 and tag[126]:
            yield "id3v1", "track", str(tag[126])


def vorbis(body: bytes) -> Found:
    """Vorbis comments: keys in upper case, repeated ones each."""
    size = int.from_bytes(body[:4], "little")
    if vendor := cut(body[4 : 4 + size]):
        yield "vorbis", "VENDOR", vendor
    at = 8 + size
    for _ in range(int.from_bytes(body[4 + size : at], "little")):
        if at + 4 > len(body):
            return
        size = int.from_bytes(body[at : at + 4], "little")
        key, _, value = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        at += 4 + size
        if value.strip():
            yield "vorbis", key.upper(), value.strip()


def itunes(content: bytes, chunks: list[tuple]) -> Found:
    """Items of an ilst box: text, whole numbers, and pairs of track and total; free-form items by their name."""
    inside = next(((body, body + there) for name, body, _, there, *_ in chunks if name == b"ilst"), None)
    for name, body, _, there, *_ in chunks:
        if not inside or not inside[0] <= body <= inside[1] or name == b"ilst":
            continue
        key, at, end = name.decode("latin-1"), body, body + there
        while at + 8 <= end:
            size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
            if size < 8:
                return
            if kind == b"name":
                key = content[at + 12 : at + size].decode("utf-8", "replace")
            if kind == b"data" and size >= 16:
                code, value = int.from_bytes(content[at + 8 : at + 12], "big") & 0xFFFFFF, content[at + 16 : at + size]
                if code == 1 and value.strip():
                    yield "itunes", key, value.decode("utf-8", "replace").strip()
                elif key in ("trkn", "disk") and len(value) >= 6:
                    yield "itunes", key, "/".join(str(x) for x in struct.unpack(">HH", value[2:6]) if x)
                elif code in (0, 21) and 0 < len(value) <= 8:
                    yield "itunes", key, str(int.from_bytes(value, "big"))
            at += size


def caf_info(body: bytes) -> Found:
    """Pairs of zero-ended texts behind their number."""
    parts = body[4:].split(b"\0")
    for i in range(min(int.from_bytes(body[:4], "big"), len(parts) // 2)):
        yield "caf", parts[2 * i].decode("utf-8", "replace"), parts[2 * i + 1].decode("utf-8", "replace").strip()


def of_file(content: bytes, kind: str, chunks: list[tuple] | None = None) -> Found:
    """All metadata of a file, in the order in which it stands there. chunks: those of containers.tracked, where they are known."""
    yield from id3v2(content)
    chunks, order = containers.tracked(content, kind) if chunks is None else chunks, containers.order_of(content, kind)
    for name, at, _, there, *_ in chunks:
        body = lambda at=at, there=there: content[at : at + there]
        if kind == "wav" and name == b"LIST":
            yield from info_list(body(), order)
        elif kind == "wav" and name == b"bext":
            yield from bext(body(), order)
        elif kind == "wav" and name == b"cue ":
            yield from cues(body(), order)
        elif kind == "wav" and name == b"smpl":
            yield from sampler(body(), order)
        elif kind == "wav" and name == b"acid":
            yield from acid(body(), order)
        elif kind == "wav" and name == b"chna":
            yield from chna(body(), order)
        elif kind in ("wav", "aiff") and name == b"C2PA" or kind == "mp4" and name in (b"uuid", b"jumb") or kind == "flac" and name and name[0] & 127 == 2:
            yield from manifest(body())
        elif kind == "wav" and name in (b"iXML", b"axml", b"_PMX"):
            yield name.decode().strip().lower(), "xml", cut(body())
        elif kind in ("wav", "aiff") and name.lower() in (b"id3 ", b"id32"):
            yield from id3v2(body())
        elif kind == "aiff" and name in (b"NAME", b"AUTH", b"ANNO", b"(c) "):
            yield "aiff", name.decode(), cut(body())
        elif kind == "flac" and name and name[0] & 127 == 4:
            yield from vorbis(body())
        elif kind == "caf" and name == b"info":
            yield from caf_info(body())
        elif kind == "ogg" and name == b"page" and at == 0:
            # the second packet of the first stream, over as many pages as it takes
            comments = ogg.packet(content, int.from_bytes(content[14:18], "little"), 1) or b""
            for mark in (b"\x03vorbis", b"OpusTags"):
                if comments.startswith(mark):
                    yield from vorbis(comments[len(mark) :])
    if kind == "mp4":
        yield from itunes(content, chunks)
    yield from id3v1(content)


TAGS = "report_id string, scheme string, ord int, key string, value string"


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    found = ((b.column(x)[0].as_py() for x in ("report_id", "kind", "content")) for b in containers.single(batches))
    out = ((r, scheme, i, key, value) for r, k, content in found if k and content for i, (scheme, key, value) in enumerate(of_file(content, k)))
    yield from containers.together(out, kinds, [x.split()[0] for x in TAGS.split(", ")])


def tags(found: DataFrame) -> DataFrame:
    """A row for each piece of metadata of each file (report_id, content)."""
    rows = found.select("report_id", containers.kind_of(F.col("content")).alias("kind"), "content")
    return rows.mapInArrow(_tagged, TAGS)


def inventory(found: DataFrame) -> DataFrame:
    """Chunks, metadata and size of each file (report_id, content) in one pass over the contents, kept in the shared folder: rows of containers.chunks (what = 'chunk'), of tags ('tag'), and one
    with length and head, its first eight bytes ('file')."""
    schema = f"what string, {containers.CHUNKS}, scheme string, key string, value string, length long"
    chunk = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
    kinds, names = [pa.string(), *chunk, pa.string(), pa.string(), pa.string(), pa.int64()], [x.split()[0] for x in schema.split(", ")]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        nothing = [None] * 4
        for b in containers.single(batches):
            r, k, content = (b.column(x)[0].as_py() for x in ("report_id", "kind", "content"))
            yield "file", r, k, *[None] * 5, content[:8] if content else None, *nothing, None, None, None, len(content) if content is not None else None
            if k and content:
                chunks, reason = containers.tracked_until(content, k)
                yield from (("chunk", *x, *nothing) for x in containers.listed(r, k, chunks, reason))
                yield from (("tag", r, k, i, *[None] * 9, scheme, key, value, None) for i, (scheme, key, value) in enumerate(of_file(content, k, chunks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from containers.together(told(batches), kinds, names)

    rows = found.select("report_id", containers.kind_of(F.col("content")).alias("kind"), "content")
    return shared.stored(rows.mapInArrow(run, schema), "inventory")


def codes(spark: SparkSession) -> DataFrame:
    """field, scheme and key of the common fields."""
    schemes = ("id3v2", "id3v2", "info", "itunes", "vorbis", "aiff")
    rows = [(field, s, key) for field, *keys in FIELDS for s, key in zip(schemes, keys) if key] + [(field, "id3v1", field) for field in ("title", "artist", "album", "date", "comment", "track")] + [(field, "caf", key) for field, key in (("title", "title"), ("artist", "artist"), ("album", "album"), ("comment", "comments"), ("genre", "genre"))]
    return spark.createDataFrame(rows, "field string, scheme string, key string")


def fields(found: DataFrame) -> DataFrame:
    """report_id, field and value: of each field, what the first scheme in order says that says anything. Of a repeated ID3 frame the last counts; repeated
    Vorbis comments are joined; of others the first counts."""
    named = found.join(F.broadcast(codes(found.sparkSession)), ["scheme", "key"])
    scheme = F.col("scheme")
    per = named.groupBy("report_id", "field", "scheme").agg(
        F.when(scheme == "id3v2", F.max_by("value", "ord")).when(scheme == "vorbis", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "; ")).otherwise(F.min_by("value", "ord")).alias("value")
    )
    rank = F.array_position(F.array(*map(F.lit, SCHEMES)), scheme)
    return per.groupBy("report_id", "field").agg(F.min_by("value", rank).alias("value"))


def labelled_cues(found: DataFrame) -> DataFrame:
    """report_id, cue, sample and label of each cue point; of several labels of a cue the last counts, a cue without one has NULL."""
    points = found.where("scheme = 'cue'").select("report_id", F.col("key").alias("cue"), F.col("value").cast("long").alias("sample"))
    labels = found.where("scheme = 'adtl'").groupBy("report_id", F.col("key").alias("cue")).agg(F.max_by("value", "ord").alias("label"))
    return points.join(labels, ["report_id", "cue"], "left")
