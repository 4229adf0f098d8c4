import hashlib
import tempfile

from auricle.llm import warc


def test_round_trip(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    long_, other = "é" * 700, "y" * 999
    rows = [(1, "http://a/ b", long_), (2, None, long_), (9, "u", long_), (3, "u", None), (4, "u", ""), (5, "u", other), (6, "u", other), (7, "u", magic * 3), (8, "u", magic + "z" * 2000 + magic), (None, "u", long_), (9, "u", long_), (10, "u", "\r\n\r\n"), (11, "u", "x" * 500_000 + magic)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/w"
    warc.write(df, path)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(spark, path).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == long_ and i != 9
        want.append((i, "revisit" if revisit else "response", 9 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest()))
    assert got == sorted(want, key=str)


def test_an_archive_cut_short_and_an_empty_table(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{0}>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    with open(f"{folder}/a.warc", "w", newline="") as f:
        f.write(record.format(1) + record.format(2) + record.format(3)[:-9])
    assert sorted(r["page_id"] for r in warc.read(spark, f"file://{folder}").collect()) == [1, 2]
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/w"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_pointer_jumping():
    import numpy as np

    offset = np.array([0, 10, 15, 30, 42])
    assert warc._reached(offset, np.array([10, 30, 22, 42, 99])).tolist() == [True, True, False, True, True]
    assert warc._reached(np.array([5]), np.array([9])).tolist() == [False]
