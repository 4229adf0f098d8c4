"""Connected components of a table of links: forests of a task's links, merged by node, and pointers that jump."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Nodes that a task holds at once; beyond, it sends on what they are joined to and begins anew.
NODES = 1 << 20
EDGE = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node that a task's links join to a smaller one, with the smallest of its part: (u, v), v < u."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def flush() -> pa.RecordBatch:
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            if (a := root(u)) != (c := root(v)):
                parent[max(a, c)] = min(a, c)
        if len(parent) > NODES:
            yield flush()
    yield flush()


def _met(edges: DataFrame) -> DataFrame:
    """The links of every larger end meet in one task, so all it is linked to is joined. Each task sends one link for a node, so no node has more
    of them than there were tasks; a smaller end that many nodes have is no key here."""
    return common.stored(edges.mapInArrow(_forest, EDGE).repartition("u").mapInArrow(_forest, EDGE), "forest")


def components(links: DataFrame) -> DataFrame:
    """id and comp, the smallest id reachable, of every node of the links (a, b). In a step, every node's link jumps to what its smaller end
    is linked to (a join, whose hot keys are those of one plain scan, so that they can be split), then the links of a node meet. Both keep what is
    connected. Links that stay as they are lead from each node to one that has none. About log2 of the longest path steps follow."""
    edges, state = _met(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 32)))).first()
        if now == state or not now[0]:
            break
        state = now
        up = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
        edges = _met(edges.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v")))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("comp"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(roots).distinct()
