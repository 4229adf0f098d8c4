"""Merkle manifest of a dataset: a content-addressed store of digest -> children, and proofs that come from descending it.

Leaves of a tree are numbered in order. Runs of FANOUT neighbours become the digest of their own digests, level by level, until one is left. All that
happens within SPAN neighbouring nodes is made in one step and kept as one pack of records, found by the digest at its top; the packs' tops are the nodes of the next step.
A proof starts at the root: the digits of a leaf's number choose the way down, the children that are not chosen are its siblings. Requests that share
a pack travel together, so the upper levels, which all leaves share, are descended once for a pack and not once for a leaf. What was
collected from the top is reversed into the order from leaf to root.

Trees stand in groups (one for each source); the roots of the groups are the leaves of the dataset's own tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, order

FANOUT, DEPTH = 3, 5
#: Nodes below a pack's top, and levels between.
SPAN = FANOUT**DEPTH
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "struct<position:int,siblings:array<string>>"
RAISED, DESCENDED = "struct<top:string,records:array<struct<digest:string,children:array<string>>>>", f"array<struct<digest:string,path:array<{STEP}>>>"
_STEP = pa.struct([("position", pa.int32()), ("siblings", pa.list_(pa.string()))])
_RECORD = pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts, one behind the other."""
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows run together alike; null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def _hash(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _raised(nodes: pa.Array, levels: pa.Array) -> pa.Array:
    """The top of some neighbouring nodes after a number of levels, and the records between."""
    out = []
    for row, n in zip(nodes, levels.to_pylist()):
        row, records = row.as_py(), []
        for _ in range(n):
            runs = [row[i : i + FANOUT] for i in range(0, len(row), FANOUT)]
            row = [_hash(run) for run in runs]
            records += [{"digest": d, "children": run} for d, run in zip(row, runs)]
        out.append({"top": row[0], "records": records})
    return pa.array(out, pa.struct([("top", pa.string()), ("records", pa.list_(_RECORD))]))


def way(children: dict[str, list[str]], top: str, place: int, levels: int) -> tuple[str, list[tuple[int, list[str]]]]:
    """The node at a place below a top, and the siblings met, from the node up."""
    node, path = top, []
    for level in reversed(range(levels)):
        run, position = children[node], place // FANOUT**level % FANOUT
        path.append((position, run[:position] + run[position + 1 :]))
        node = run[position]
    return node, path[::-1]


def _descended(top: pa.Array, count: pa.Array, levels: pa.Array, records: pa.Array) -> pa.Array:
    """The nodes below a pack's top, in order, with their ways up to it."""
    out = []
    for t, n, depth, own in zip(top.to_pylist(), count.to_pylist(), levels.to_pylist(), records):
        children = {r["digest"]: r["children"] for r in own.as_py()}
        ways = [way(children, t, place, depth) for place in range(n)]
        out.append([{"digest": node, "path": [{"position": p, "siblings": s} for p, s in path]} for node, path in ways])
    return pa.array(out, pa.list_(pa.struct([("digest", pa.string()), ("path", pa.list_(_STEP))])))


def _levels(count: Column) -> Column:
    """Levels that a pack of a tree of so many nodes spans."""
    return sum((F.when(count > FANOUT**k, 1).otherwise(0) for k in range(1, DEPTH)), F.when(count > 1, 1).otherwise(0))


def build(nodes: DataFrame) -> list[DataFrame]:
    """Stored steps from nodes (tree, place, digest, count: nodes of the tree, row: what to keep of a node) up to the roots; in the last step each tree has one pack, whose top is its root."""
    steps = []
    while True:
        kept = F.array_sort(F.collect_list(F.struct("place", "digest", "row")))
        pack = F.floor(F.col("place") / SPAN).alias("pack")
        packs = nodes.groupBy("tree", pack, "count").agg(kept.alias("nodes")).withColumn("levels", _levels(F.col("count")))
        packs = packs.withColumn("up", F.arrow_udf(_raised, RAISED)(F.col("nodes.digest"), F.col("levels")))
        step = common.stored(packs.select("tree", "pack", "count", "levels", "nodes.row", F.size("nodes").alias("n"), "up.top", "up.records"), "packs")
        steps.append(step)
        if (step.agg(F.max("count")).first()[0] or 0) <= SPAN:
            return steps
        nodes = step.select("tree", F.col("pack").alias("place"), F.col("top").alias("digest"), F.ceil(F.col("count") / SPAN).alias("count"), F.lit(None).cast("int").alias("row"))


def descend(steps: list[DataFrame], asked: DataFrame) -> DataFrame:
    """(tree, place, digest, path, row) of every node of the first step. asked: (tree, digest, path) of the roots, where a path leads further up.

    A step's packs are found in the store by digest; equal packs of several trees are one record there."""
    asked = asked.withColumn("pack", F.lit(0).cast("long"))
    for i, step in reversed(list(enumerate(steps))):
        store = step.select("top", "records").dropDuplicates(["top"])
        groups = step.select(F.col("tree").alias("t"), F.col("pack").alias("p"), "levels", "n", "row")
        known = asked.join(groups, F.col("tree").eqNullSafe(F.col("t")) & (F.col("pack") == F.col("p"))).join(store, F.col("digest") == F.col("top"))
        found = known.select("tree", "pack", "path", "row", F.posexplode(F.arrow_udf(_descended, DESCENDED)("digest", "n", "levels", "records")).alias("at", "down"))
        below = found.select("tree", (F.col("pack") * SPAN + F.col("at")).alias("pack"), "down.digest", F.concat("down.path", "path").alias("path"), F.get("row", F.col("at")).alias("row"))
        asked = common.stored(below.drop("row"), "paths") if i else below
    return asked.withColumnRenamed("pack", "place")


def proofs(df: DataFrame, leaf_col: str = "leaf", group_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The columns of df with subroot, root and path, an array of (position, siblings) from the leaf to the root.

    Leaves of a group stand in the order of the id (null first; equal ids by leaf, and equal leaves are interchangeable); groups in the order of their name (null first). A lone leaf is
    its group's root, a lone group's root the root. An empty table gives an empty one. Columns subroot, root and path of df are replaced; columns that begin with __ are the operator's own."""
    own = [c for c in df.columns if c not in ("subroot", "root", "path")]
    rows = common.stored(df.select(*own, F.col(group_col).cast("string").alias("__tree"), F.col(leaf_col).alias("__leaf"), F.monotonically_increasing_id().alias("__row")), "leaves")
    at = [F.col("__tree").asc_nulls_first(), F.col(id_col).asc_nulls_first(), F.col("__leaf"), F.col("__row")]
    placed = order.ranked(rows, ["__tree"], at, "__place")
    counts = common.stored(rows.groupBy(F.col("__tree").alias("__of")).agg(F.count("*").alias("__count")), "counts")
    counts = order.small(counts)
    nodes = placed.join(counts, placed["__tree"].eqNullSafe(counts["__of"]))
    nodes = nodes.select(F.col("__tree").alias("tree"), F.col("__place").alias("place"), F.col("__leaf").alias("digest"), F.col("__count").alias("count"), F.struct(*own).alias("row"))
    steps = build(nodes)
    roots = steps[-1].select(F.col("tree").alias("name"), F.col("top").alias("digest"))
    groups = order.ranked(roots, [], [F.col("name").asc_nulls_first()], "place")
    groups = common.stored(groups, "groups")
    above = build(groups.select(F.lit("").alias("tree"), "place", "digest", F.lit(groups.count()).alias("count"), F.struct("name").alias("row")))
    none = F.array().cast(f"array<{STEP}>")
    ways = descend(above, above[-1].select("tree", F.col("top").alias("digest"), none.alias("path")))
    ways = common.stored(ways.select(F.col("row.name").alias("tree"), "digest", "path"), "groups-paths")
    root = above[-1].select(F.col("top").alias("root"))
    subroots = order.small(common.stored(ways.select(F.col("tree").alias("g"), F.col("digest").alias("subroot")), "subroots"))
    out = descend(steps, ways)
    out = out.join(subroots, out["tree"].eqNullSafe(subroots["g"])).join(F.broadcast(root))  # one row
    return out.select("row.*", "subroot", "root", "path")


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""

    def up(node: Column, step: Column) -> Column:
        before = F.slice(step["siblings"], 1, step["position"])
        after = F.slice(step["siblings"], step["position"] + 1, F.size(step["siblings"]))
        return digest(F.array_join(before, ""), node, F.array_join(after, ""))

    return F.aggregate(path, leaf_digest, up)


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf's level up and left to right."""
    return F.flatten(F.transform(path, lambda s: s["siblings"]))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf and proof; half of the documents are tampered with (their \\n are deleted) and folded again."""
    docs = common.read(spark, sf_dir, "documents")
    values = [F.col(c) for c in FIELDS[:-1]]
    changed = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    text = F.when(changed, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf(*values, F.col("text")).alias("leaf"), leaf(*values, text).alias("shown"))
    out = proofs(rows).withColumn("folded_root", fold(F.col("shown"), F.col("path")))
    proof = digest(F.array_join(siblings(F.col("path")), ""))
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of a list of bytes, from the table of its polynomial (fixed value).
CRC_SQL = """ctable AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"""


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of a text's UTF-8 bytes, where ctable is joined."""
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: xor(ctable.t[(xor(c, b) & 255) + 1], c >> 8)))"


def _levels_sql(source: str) -> str:
    return f"""SELECT k, 0 AS level, nodes FROM {source} UNION ALL
  SELECT k, level + 1, list_transform(range((len(nodes) + {FANOUT - 1}) // {FANOUT}), lambda i: sha256(array_to_string(nodes[({FANOUT} * i + 1)::INT:({FANOUT} * i + {FANOUT})::INT], '')))"""


def _siblings_sql(place: str) -> str:
    return f"list_transform(list_filter(range({FANOUT} * ({place} // {FANOUT}), {FANOUT} * ({place} // {FANOUT}) + {FANOUT}), lambda i: i <> {place} AND i < len(nodes)), lambda i: nodes[(i + 1)::INT])"


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
c AS (SELECT *, doc_id IS NOT NULL AND {crc_sql("doc_id::VARCHAR")} % 2 = 0 AS hit FROM documents, ctable),
h AS (SELECT doc_id, source, {' || '.join(f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f}::VARCHAR)) || ':' || {f} END" for f in FIELDS[:-1])} AS head, text,
  CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS shown FROM c),
l AS (SELECT doc_id, source, {', '.join(f"sha256(head || CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c})) || ':' || {c} END) AS {a}" for c, a in (('text', 'leaf'), ('shown', 'forged')))} FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
s AS (SELECT source AS k, list(leaf ORDER BY place) AS nodes FROM p GROUP BY source),
t AS ({_levels_sql('s')} FROM t WHERE len(nodes) > 1),
g AS (SELECT k AS name, nodes[1] AS subroot, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
gs AS (SELECT '' AS k, list(subroot ORDER BY place) AS nodes FROM g),
gt AS ({_levels_sql('gs')} FROM gt WHERE len(nodes) > 1),
r AS (SELECT nodes[1] AS root FROM gt WHERE len(nodes) = 1),
low AS (SELECT p.*, t.level, {_siblings_sql(f"(place // ({FANOUT} ** t.level)::BIGINT)")} AS sib, ((place // ({FANOUT} ** t.level)::BIGINT) % {FANOUT})::INT AS pos FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.k AND len(t.nodes) > 1),
high AS (SELECT g.name, g.place, gt.level, {_siblings_sql(f"(place // ({FANOUT} ** gt.level)::BIGINT)")} AS sib, ((place // ({FANOUT} ** gt.level)::BIGINT) % {FANOUT})::INT AS pos FROM g JOIN gt ON len(gt.nodes) > 1),
lp AS (SELECT source, place, list({{'pos': pos, 'sib': sib}} ORDER BY level) AS path FROM low GROUP BY source, place),
hp AS (SELECT name, list({{'pos': pos, 'sib': sib}} ORDER BY level) AS path FROM high GROUP BY name),
f AS (SELECT p.doc_id, p.leaf, p.forged, g.subroot, r.root, list_concat(coalesce(lp.path, []), coalesce(hp.path, [])) AS path FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.name CROSS JOIN r
  LEFT JOIN lp ON p.source IS NOT DISTINCT FROM lp.source AND p.place = lp.place LEFT JOIN hp ON p.source IS NOT DISTINCT FROM hp.name),
o AS (SELECT *, list_reduce(list_prepend({{'pos': 0, 'sib': [forged]}}, path), lambda a, b: {{'pos': 0, 'sib': [sha256(array_to_string(list_concat(b.sib[1:b.pos], [a.sib[1]], b.sib[b.pos + 1:]), ''))]}}).sib[1] AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(flatten(list_transform(path, lambda x: x.sib)), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o"""
