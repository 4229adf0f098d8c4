"""Files by byte ranges: their headers are walked and their audio is read without any file in one cell.

Listing is Spark's own binaryFile source without its content column, so it opens nothing. What is inside is read by tasks that seek, with
any file system that pyarrow knows. Families are a registry: a family has a name, a test of the first bytes and a walker, and users add their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.sources import containers

#: Bytes that are fetched at once while headers are walked, and windows of a file that are kept.
WINDOW, KEPT = 1 << 16, 4
#: Largest range that is read at once.
LARGEST = 16 << 20


class Ranged:
    """A file that answers len, slices and find like its bytes, and fetches windows of them."""

    def __init__(self, handle: pa.NativeFile, size: int):
        self.handle, self.size, self.fetched, self.windows = handle, size, 0, {}

    def __len__(self) -> int:
        return self.size

    def _window(self, k: int) -> bytes:
        if k not in self.windows:
            if len(self.windows) >= KEPT:
                self.windows.pop(next(iter(self.windows)))
            self.handle.seek(k * WINDOW)
            self.windows[k] = self.handle.read(WINDOW)
            self.fetched += len(self.windows[k])
        return self.windows[k]

    def __getitem__(self, at: slice | int) -> bytes | int:
        if isinstance(at, int):
            at = at + self.size if at < 0 else at
            return self._window(at // WINDOW)[at % WINDOW]
        lo, hi, _ = at.indices(self.size)
        if hi - lo > LARGEST:
            raise ValueError(f"{hi - lo} bytes asked for at once; {LARGEST} is the most")
        if hi - lo > WINDOW:
            self.handle.seek(lo)
            self.fetched += hi - lo
            return self.handle.read(hi - lo)
        out = b"".join(self._window(k) for k in range(lo // WINDOW, (max(lo, hi - 1)) // WINDOW + 1))
        return out[lo % WINDOW : lo % WINDOW + max(0, hi - lo)]

    def find(self, what: bytes, start: int = 0, stop: int | None = None) -> int:
        stop = self.size if stop is None else min(stop, self.size)
        while start + len(what) <= stop:
            hi = min(stop, (start // WINDOW + 1) * WINDOW + len(what) - 1)
            at = self[start:hi].find(what)
            if at >= 0:
                return start + at
            start = max(start + 1, hi - len(what) + 1)
        return -1


def opened(path: str, size: int | None = None) -> Ranged:
    """A file by its path or URI."""
    if "://" in path or path.startswith("file:"):
        where = urlparse(path)
        system, inner = (fs.LocalFileSystem(), unquote(where.path)) if where.scheme == "file" else fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return Ranged(system.open_input_file(inner), system.get_file_info(inner).size if size is None else size)


@dataclass(frozen=True)
class Family:
    """name; sniff(head, content) tells whether a file is of the family; walk(content) lists (id, offset, declared size, size that is there) of its chunks."""

    name: str
    sniff: Callable[[bytes, Ranged | bytes], bool]
    walk: Callable[[Ranged | bytes], Iterator[tuple[bytes, int, int, int]]]


#: Families that users have added, asked before the engine's own.
FAMILIES: dict[str, Family] = {}


def register(family: Family) -> None:
    """Adds a family (or puts it in place of one of the same name). Jobs defined afterwards know it."""
    if not family.name or family.name in containers.LAYOUTS:
        raise ValueError("a family needs a name of its own")
    FAMILIES[family.name] = family


def registered() -> list[str]:
    """All families in the order in which they are asked."""
    return [*FAMILIES, *containers.FAMILIES]


def family_of(content: Ranged | bytes, families: dict[str, Family]) -> str | None:
    """The family of a file; one whose test fails with an error is not it. Files below four bytes have none."""
    head = bytes(content[0:32])
    if len(head) < 4:
        return None
    for family in families.values():
        try:
            if family.sniff(head, content):
                return family.name
        except Exception:  # a foreign test must not stop the others
            continue
    return containers.sniffed(content)


def listed(spark: SparkSession, path: str | list[str], recursive: bool = True, every: bool = False) -> DataFrame:
    """report_id (the path) and length of the files below one path or several (folders or files); those with the extension of a known container, unless `every`."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(path).select(F.col("path").alias("report_id"), "length")
    known = F.lower(F.element_at(F.split("report_id", r"\."), -1)).isin(containers.EXTENSIONS)
    return found if every else found.where(known)


def chunks(found: DataFrame) -> DataFrame:
    """A row for each chunk of each listed file (report_id, length), and, in `stopped`, why the walk ended before the end of the file; a file of no known family has one row without a
    chunk. Only windows around headers are read; `fetched` counts their bytes."""
    families = dict(FAMILIES)
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column("report_id").to_pylist(), b.column("length").to_pylist()):
                content = opened(path, size)
                kind = family_of(content, families)
                walker = families[kind].walk if kind in families else None
                out, reason = containers.tracked_until(content, kind, walker) if kind else ([], "no known family")
                out = [(path, kind, i, *c, reason, content.fetched) for i, c in enumerate(out)] or [(path, kind, *[None] * (len(names) - 4), reason, content.fetched)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return found.select("report_id", "length").mapInArrow(run, CHUNKS)


CHUNKS = containers.CHUNKS + ", fetched long"


def read(asked: DataFrame) -> DataFrame:
    """asked (report_id, offset, size and any other columns) with content, the bytes of the range."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in asked.schema)}, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, content = None, None
        for b in containers.single(batches):
            row = b.select(["report_id", "offset", "size"]).to_pylist()[0]
            if row["report_id"] != path:
                path, content = row["report_id"], opened(row["report_id"])
            content.handle.seek(row["offset"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([content.handle.read(row["size"])], pa.binary())], [*b.schema.names, "content"])

    return asked.mapInArrow(run, schema)
