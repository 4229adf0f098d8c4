"""The library's document: unknown fields, migrations, versions, and writers that die."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from auricle.operators import document

OLD = [
    {"id": "1", "title": "A", "created": "2020", "colour": {"r": 1}, "projects": [{"id": "p", "name": "P", "mood": "x", "log": [{"id": "e", "status": "ok", "note": [1, 2.5, None]}], "todos": [{"id": "t", "text": "do", "done": True, "who": "me"}, "junk"]}]},
    {"id": "2", "name": "B", "title": "kept", "projects": "none", "created_at": None},
]


def lines(spark, rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def written(spark, path):
    return {r["id"]: json.loads(r["value"]) for r in document.load(spark, path).select("id", F.to_json(document.untyped(F.struct("id", "name", "created_at", "projects", "extras"))).alias("value")).collect()}


@pytest.fixture
def path():
    return f"file://{tempfile.mkdtemp(prefix='spark-')}/library"


def test_unknown_fields_stay_at_every_level_through_migration_and_publication(spark, path):
    document.publish(document.migrated(lines(spark, [*OLD, "no json", "[1]", "7"]), 0), path)
    for _ in range(2):
        got = written(spark, path)
        assert got["1"] == {"id": "1", "name": "A", "created_at": "2020", "colour": {"r": 1}, "projects": [{"id": "p", "name": "P", "mood": "x", "log": [{"id": "e", "status": "ok", "note": [1, 2.5, None]}], "todos": [{"id": "t", "text": "do", "done": True, "who": "me"}]}]}
        # a name that is there is not overwritten by the old one, which is kept
        assert got["2"] == {"id": "2", "name": "B", "title": "kept", "projects": []}
        document.publish(document.load(spark, path), path)


def test_a_writer_that_dies_or_comes_second_leaves_the_document(spark, path, monkeypatch):
    clients = document.migrated(lines(spark, OLD), 0)
    assert document.load(spark, path).count() == 0
    assert document.publish(clients, path) == 1
    broken = clients.withColumn("name", F.raise_error(F.lit("dies")).cast("string"))
    with pytest.raises(Exception, match="dies"):
        document.publish(broken, path)
    assert set(written(spark, path)) == {"1", "2"}
    # another writer has published meanwhile
    monkeypatch.setattr(document, "_pointers", lambda *_: {})
    with pytest.raises(Exception, match="exist"):
        document.publish(clients.where("id = '1'"), path)
    monkeypatch.undo()
    assert set(written(spark, path)) == {"1", "2"}


def test_newer_and_foreign_documents_are_refused(spark, path):
    document.publish(document.migrated(lines(spark, OLD), 0), path)
    with pytest.raises(ValueError, match="version 3"):
        document.migrated(lines(spark, OLD), document.VERSION + 1)
    folder = path.removeprefix("file://")
    with open(f"{folder}/pointer-9", "w") as f:
        f.write(json.dumps({"kind": "other", "version": 1, "place": "x"}))
    with pytest.raises(ValueError, match="other"):
        document.load(spark, path)
