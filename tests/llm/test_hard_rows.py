"""Columns with the operators' own names, empty tables, nulls in every column, and very long texts, for every operator."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.llm import bpe, decontaminate, licences, lines, media, mixing, near, substring, toxicity, warc

NAMES = ["t", "n", "runs", "gone", "rep", "key", "media", "ids", "block", "held_out", "word", "doc", "mini", "rows", "a", "b", "comp", "label", "batch", "pos", "line", "item_id", "license", "score"]
MODEL = toxicity.fit(["you idiot", "the house"] * 5, np.array([1, 0] * 5))
ITEMS = "item_id long, text string"


def crowded(spark, rows):
    """Documents with a column for every name that some operator uses inside."""
    out = spark.createDataFrame(rows, "doc_id long, text string")
    return out.withColumns({name: F.lit("own") for name in NAMES})


def items(spark):
    return spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "a b")], ITEMS)


#: name -> (what it does, whether it gives a row for every row)
OPERATORS = {
    "toxicity": (lambda s, d: toxicity.score(d, MODEL), True),
    "media": (lambda s, d: media.round_trip(d), True),
    "mixing": (lambda s, d: mixing.score(d, F.lit(False)), True),
    "leaks": (lambda s, d: decontaminate.leaks(d, items(s)), False),
    "clean": (lambda s, d: decontaminate.clean(d, items(s)), False),
    "lines": (lambda s, d: lines.drop_repeated_lines(d), True),
    "bpe": (lambda s, d: bpe.round_trip(d), True),
    "near": (lambda s, d: near.groups(d), True),
    "licences": (lambda s, d: licences.scan(d), False),
    "substring": (lambda s, d: substring.drop_repeated_passages(d), True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_nulls_and_empty_tables(spark, name):
    run, each = OPERATORS[name]
    rows = [(1, "one two three four five six seven"), (2, None), (3, ""), (None, "one two"), (None, None), (1, "one two three four five six seven"), (4, "Released under the MIT License"), (5, " \n\t ")]
    df = crowded(spark, rows)
    out = run(spark, df)
    if each:
        assert out.count() == len(rows)
    if name in ("toxicity", "clean", "lines"):  # these keep all columns
        assert set(df.columns) <= set(out.columns) and {r["rows"] for r in out.collect()} == {"own"}
    if name == "clean":
        assert sorted(out.select(F.coalesce("doc_id", F.lit(-1)).alias("i")).toPandas()["i"]) == [-1, -1, 2, 3, 4, 5]
    assert run(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_very_long_texts(spark, name):
    run, each = OPERATORS[name]
    long_ = " ".join(f"w{i % 977}" for i in range(200_000))
    many = "\n".join(f"a line of text that stands alone, number {i}" for i in range(20_000))
    out = run(spark, spark.createDataFrame([(1, long_), (2, many), (3, "x" * 400_000)], "doc_id long, text string"))
    assert out.count() == (3 if each or name == "clean" else 0)


def test_archives_of_an_empty_table_and_an_empty_folder(spark):
    folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, f"{folder}/w")
    assert warc.read(spark, f"{folder}/w").count() == 0


def test_older_archives(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    body = "héllo"
    with open(f"{folder}/a.warc", "wb") as f:
        f.write(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode())
    (r,) = warc.read(spark, f"file://{folder}").collect()
    assert (r["page_id"], r["record_type"], r["payload_bytes"]) == (7, "response", 6)


def test_broken_media_and_ids_say_so(spark):
    good = media.encode_all([media.padded(b"text")])[0]
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"no picture")), (4, bytearray(good[: len(good) // 2])), (5, bytearray(good))]
    got = {r["doc_id"]: r for r in media.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1]["problem"] is None and got[5]["payload"] == got[1]["payload"] and got[2]["problem"] == "no media"
    assert got[3]["payload"] is None and got[3]["problem"] and got[4]["problem"]
    ids = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f")), (2, bytearray(b"abc")), (3, None), (4, bytearray(b"\1\0\0\0"))], "doc_id long, ids binary")
    out = {r["doc_id"]: r["decoded"] for r in bpe.decode(ids).collect()}
    assert out[1] is None and out[2] is None and out[3] == b"" and len(out[4]) >= 1
