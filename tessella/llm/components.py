"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import shared

#: Edges that one local contraction takes at once.
AT_ONCE = 200_000


def spanning(batches):
    """Edges replaced by a star for each of their components, centre at the least node, AT_ONCE edges at a time."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        out = [(x, r) for x in parent if (r := root(parent, x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    parent: dict[int, int] = {}
    n = 0
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rx, ry = root(parent, x), root(parent, y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
        n += b.num_rows
        if n >= AT_ONCE:
            yield stars(parent)
            parent, n = {}, 0
    if parent:
        yield stars(parent)


def root(parent: dict[int, int], x: int) -> int:
    top = parent.setdefault(x, x)
    while parent[top] != top:
        top = parent[top]
    while parent[x] != top:
        parent[x], x = top, parent[x]
    return top


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node that has an edge to another one; component is the least node reachable.

    `edges` has two long columns in either direction; repeats and loops do no harm, an empty table gives none. No
    node's neighbours meet in one task: their minimum is combined before the shuffle, and the joins have one row for
    each node on one side.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").mapInArrow(spanning, "u long, v long")
    e = shared(e.distinct())  # u > v
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        e = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        hung = e.join(low, F.col("u") == F.col("w"))
        e = shared(hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
