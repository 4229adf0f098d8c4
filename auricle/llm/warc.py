"""Web archives: writing records as text rows, and reading them back by verifying the chain of record boundaries.

The reader splits every file at the magic words, wherever they stand, so each piece is a candidate record at a known offset
whose Content-Length names its successor's offset. Per file, pointer jumping from offset 0 marks the candidates that the chain
reaches; the others are magic words inside a payload and go back into the payload that they cut. A piece whose length already
agrees with its header is digested where it was read, so that only headers travel to the file's task. Pieces whose
length does not agree (of payloads that magic words cut) are kept with their text when the files are read, and put together afterwards.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What every record of either version begins with, what follows in those written here, and the end of a head and of a record.
MAGIC, VERSION, END = "WARC/1.", "1\r\n", "\r\n\r\n"
MIN_REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
#: Records of one archive file at most; a file's headers meet in one task.
FILE_RECORDS = 20_000
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long"
PARTS = "head_bytes long, parts array<struct<start: long, place: long>>"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a record for every row. Of equal payloads of `min_bytes` or more, the one with the largest id is the response and
    the others revisit it. Null html is an empty payload; a null id is an empty id (it revisits if a like payload has one);
    rows with the same id and payload are all responses."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20]+", "%20").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("body"),
    ).select("*", F.octet_length("body").cast("long").alias("n"), F.sha1(F.encode("body", "UTF-8")).alias("digest"))
    groups = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("id").alias("keeper"), F.count("*").alias("rows"))
    # stored, so that both sides of the join are plain scans: a very common body's pages are then split over tasks
    rows = rows.join(common.stored(groups.where("rows > 1").drop("rows"), "repeated-bodies"), ["digest", "n"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC + VERSION),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("keeper")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.col("body")))
    record_rows = rows.select(record.alias("value"))
    record_rows.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _reached(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates a chain from offset 0 reaches, by doubling the jumps; the last index stands for the file's end."""
    n = len(offset)
    at = np.searchsorted(offset, successor)
    at = np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n)
    jump, reached = np.append(at, n), np.zeros(n + 1, bool)
    if n and offset[0] == 0:
        reached[0] = True
    for _ in range(max(1, n).bit_length() + 1):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def _field(head: str, name: str) -> str:
    m = re.search(rf"^{name}: (.*?)\r?$", head, re.M)
    return m[1] if m else ""


def _id(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def _records(pieces: pd.DataFrame) -> pd.DataFrame:
    """The true records of one file from its pieces (start, place, size, head, length, digest); a cut one lists its pieces instead of a digest."""
    pieces = pieces.sort_values(["start", "place"], ignore_index=True)
    magic = len(MAGIC)
    # The first piece stands before the first magic and is empty in a sound file.
    offset = (np.cumsum(pieces["size"].to_numpy() + magic) - (pieces["size"].to_numpy() + magic)) - magic
    known, head_bytes = pieces["length"].to_numpy(), pieces["head_bytes"].to_numpy()
    successor = np.where(known >= 0, offset + magic + head_bytes + len(END) + known + len(END), -1)
    live = offset >= 0
    reached = np.zeros(len(pieces), bool)
    reached[live] = _reached(offset[live], successor[live])
    places = np.flatnonzero(reached)
    out = []
    for i, stop in zip(places, np.append(places[1:], len(pieces))):
        if known[i] < 0:
            continue  # not even a whole header before the file's end
        p = pieces.iloc[i]
        head, digest, n = p["head"], p["digest"], int(known[i])
        parts = None if digest is not None else list(zip(pieces["start"].iloc[i:stop].tolist(), pieces["place"].iloc[i:stop].tolist()))
        revisit = _field(head, "WARC-Type") == "revisit"
        if revisit:
            digest, n = _field(head, "WARC-Payload-Digest").removeprefix("sha1:"), int(_field(head, "X-Payload-Length") or 0)
        out.append((_id(_field(head, "WARC-Record-ID")), _field(head, "WARC-Type"), _id(_field(head, "WARC-Refers-To")) if revisit else None, n, digest, p["file"], int(offset[i]), int(head_bytes[i]), parts))
    names = [*(c.split()[0] for c in RECORDS.split(", ")), "head_bytes", "parts"]
    return pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a path: page_id, record_type, refers_to, the payload's bytes and SHA-1 as read (a revisit's
    as its header states), file, offset. An empty file has none; a record cut off at a file's end is left out."""
    parts = F.split("value", END, 2)
    rows = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), "value", F.get(parts, F.lit(0)).alias("head"), F.get(parts, F.lit(1)).alias("rest")
    )
    length = F.when(F.col("rest").isNotNull() & F.col("head").rlike(r"^[01]\r\n"), F.expr("try_cast(nullif(regexp_extract(head, '(?m)^Content-Length: ([0-9]+)\\\\r?$', 1), '') AS BIGINT)"))
    body = F.left("rest", F.greatest(F.char_length("rest") - len(END), F.lit(0)))
    whole = F.coalesce((F.octet_length("rest") == F.col("length") + len(END)) & F.endswith("rest", F.lit(END)), F.lit(False))
    read_again = rows.withColumn("length", F.coalesce(length, F.lit(-1))).withColumn("whole", whole)
    pieces = read_again.select(
        "file",
        "start",
        "place",
        F.octet_length("value").cast("long").alias("size"),
        F.when(F.col("length") >= 0, F.col("head")).alias("head"),
        F.octet_length("head").cast("long").alias("head_bytes"),
        "length",
        F.when(F.col("whole"), F.sha1(F.encode(body, "UTF-8"))).alias("digest"),
        F.when(~F.col("whole"), F.col("value")).alias("value"),
    )
    pieces = common.stored(pieces, "pieces")
    records = [c.split()[0] for c in RECORDS.split(", ")]
    found = common.stored(pieces.drop("value").groupBy("file").applyInPandas(_records, f"{RECORDS}, {PARTS}"), "records")
    whole, cut = found.where("parts IS NULL").select(records), found.where("parts IS NOT NULL")
    if cut.isEmpty():
        return whole
    place = ["file", "start", "place"]
    wanted = cut.select(*records, "head_bytes", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("nth", "part")).select("*", "part.start", "part.place").drop("part")
    kept = wanted.join(pieces.where("value IS NOT NULL").select(*place, "value"), place)
    # a record that stands whole inside a payload was not kept: it is read again, and must be the same piece as before
    again = wanted.join(pieces.where("value IS NULL").select(*place, "size", "digest"), place)
    if not again.isEmpty():
        whole_again = read_again.where("whole").select(*place, "value", F.octet_length("value").cast("long").alias("size"), F.sha1(F.encode(body, "UTF-8")).alias("digest"))
        kept = kept.unionByName(again.join(whole_again, [*place, "size", "digest"]).select(kept.columns))
    groups = kept.groupBy(*records, "head_bytes", "n_parts").agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("v"))
    text = F.encode(F.array_join(F.transform("v", lambda x: x["value"]), MAGIC), "UTF-8")
    found_all = F.when(F.size("v") == F.col("n_parts"), text).otherwise(F.raise_error(F.lit("a file was split in another way when its cut payloads were read again")).cast("binary"))
    joined = groups.withColumn("payload", F.substring(found_all, (F.col("head_bytes") + len(END) + 1).cast("int"), F.col("payload_bytes").cast("int")))
    joined = joined.where(F.length("payload") == F.col("payload_bytes")).withColumn("payload_digest", F.sha1("payload"))
    return whole.unionAll(joined.select(records))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    write(common.read(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id <> keeper THEN keeper END AS refers_to
FROM k"""
