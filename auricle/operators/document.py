"""The library as a document on shared storage: clients as JSON lines, each with its projects, their log and to-dos.

Known fields are columns; what a newer or foreign writer has put beside them is kept, at every level, as variants in `extras`, and written back. Older documents go
through a chain of migrations, newer ones are refused. A document is published by writing all of it to a new folder and then creating the next
numbered pointer, which fails if another writer has done so: a writer that dies leaves the document as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KIND, VERSION = "auricle-library", 2
#: Known fields of each level with their types, and the levels below.
FIELDS = {
    "client": {"id": "string", "name": "string", "created_at": "string"},
    "project": {"id": "string", "name": "string", "created_at": "string", "updated_at": "string"},
    "entry": {"id": "string", "checked_at": "string", "file_name": "string", "status": "string"},
    "todo": {"id": "string", "text": "string", "done": "boolean"},
}
BELOW = {"client": {"projects": "project"}, "project": {"log": "entry", "todos": "todo"}, "entry": {}, "todo": {}}
MAP = "map<string,variant>"


def _renamed(fields: Column, old: str, new: str) -> Column:
    """A map of fields with one of them under a new name, where that is not taken."""
    return F.transform_keys(fields, lambda k, _: F.when((k == old) & ~F.map_contains_key(fields, new), new).otherwise(k))


#: From each version to the next: what happens to a client's fields.
MIGRATIONS: dict[int, Callable[[Column], Column]] = {
    0: lambda fields: _renamed(fields, "title", "name"),
    1: lambda fields: _renamed(fields, "created", "created_at"),
}


def _each(what: Callable[[Column, str], Column], level: str) -> Callable[[Column], Column]:
    return lambda x: what(x, level)


def typed(fields: Column, level: str = "client") -> Column:
    """A map of variants as a struct of the level's known fields, its lists of the levels below, and extras. A field of another type than is known is NULL, a list that is none is empty."""
    known, below = FIELDS[level], BELOW[level]
    own = [F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", kind).alias(name) for name, kind in known.items()]
    lists = []
    for name, kind in below.items():
        items = F.coalesce(F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", "array<variant>"), F.array().cast("array<variant>"))
        maps = F.filter(F.transform(items, lambda v: F.try_variant_get(v, "$", MAP)), lambda m: m.isNotNull())
        lists.append(F.transform(maps, _each(typed, kind)).alias(name))
    names = [*known, *below]
    return F.struct(*own, *lists, F.map_filter(fields, lambda k, _: ~k.isin(*names)).alias("extras"))


def untyped(row: Column, level: str = "client") -> Column:
    """A struct of typed() as the map of variants that it came from; fields that are NULL are left out."""
    pairs = [F.struct(F.lit(name).alias("key"), F.when(row[name].isNotNull(), F.to_variant_object(F.array(row[name]))).alias("v")) for name in FIELDS[level]]
    out = F.map_from_entries(F.transform(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()), lambda p: F.struct(p["key"], F.variant_get(p["v"], "$[0]", "variant").alias("value"))))
    for name, kind in BELOW[level].items():
        items = F.transform(row[name], _each(untyped, kind))
        out = F.map_concat(out, F.create_map(F.lit(name), F.parse_json(F.to_json(items))))
    return F.map_concat(out, F.map_filter(F.coalesce(row["extras"], F.create_map().cast(MAP)), lambda k, _: ~F.map_contains_key(out, k)))


def _system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, path: str) -> dict[int, str]:
    """Numbers and paths of all pointers of a document."""
    found = _system(spark, path).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointer-*"))
    places = [s.getPath().toString() for s in (found or [])]
    return {int(p.rsplit("-", 1)[1]): p for p in places if p.rsplit("-", 1)[1].isdigit()}


def publish(clients: DataFrame, path: str) -> int:
    """Writes a document of clients (the columns of typed()) and makes it the current one; the number of its pointer. Fails, and changes nothing, if another writer came first."""
    spark = clients.sparkSession
    number, place = max(_pointers(spark, path), default=0) + 1, f"{path}/version-{uuid.uuid4().hex}"
    clients.select(F.to_json(untyped(F.struct(*clients.columns))).alias("value")).write.text(place)
    jvm = spark._jvm
    out = _system(spark, path).create(jvm.org.apache.hadoop.fs.Path(f"{path}/pointer-{number}"), False)
    try:
        out.write(bytearray(json.dumps({"kind": KIND, "version": VERSION, "place": place.rsplit("/", 1)[1]}).encode()))
    finally:
        out.close()
    return number


def migrated(lines: DataFrame, version: int, migrations: dict[int, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Clients from lines (value: a client as JSON) of a version. A line that is no object is left out."""
    steps = MIGRATIONS if migrations is None else migrations
    if version > VERSION:
        raise ValueError(f"the document is of version {version}, this reads up to {VERSION}")
    rows = lines.select(F.try_variant_get(F.try_parse_json("value"), "$", MAP).alias("f")).where("f IS NOT NULL")
    for v in range(version, VERSION):
        rows = rows.select(steps[v](F.col("f")).alias("f"))
    return rows.select(typed(F.col("f")).alias("c")).select("c.*")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The clients of the current document; none if nothing has been published."""
    pointers = _pointers(spark, path)
    if not pointers:
        return migrated(spark.createDataFrame([], "value string"), VERSION)
    (head,) = spark.read.text(pointers[max(pointers)], wholetext=True).collect()
    about = json.loads(head["value"])
    if about.get("kind") != KIND:
        raise ValueError(f"{path} holds a document of kind {about.get('kind')}")
    return migrated(spark.read.text(f"{path}/{about['place']}"), about["version"])
