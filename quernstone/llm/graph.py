"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import _run


def spanning(n: int, linked) -> list[tuple[int, int]]:
    """A spanning forest of n items; ``linked(i, others)`` says which of ``others`` link to i.

    Items that have been reached are never compared with each other again, so
    a tight group costs about as many comparisons as it has items.
    """
    edges: list[tuple[int, int]] = []
    left = np.arange(n)
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = linked(i, left)
            if hit.any():
                found = left[hit].tolist()
                edges += [(i, j) for j in found]
                stack += found
                left = left[~hit]
    return edges


def _contract(it):
    """Union-find over the links of one partition: a star for each of its components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def out():
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])

    for b in it:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > 500_000:  # bounded: pass on what is known and start afresh
            yield out()
            parent.clear()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u long, v long)``; the root is its smallest node.

    Rounds of hooking (a node's other neighbours are linked to its smallest
    one) and shortcutting (a node points to what its target points to), each a
    partial aggregation and joins on single nodes, until nothing moves.
    """
    e = links.where("u != v").selectExpr("greatest(u, v) u", "least(u, v) v").mapInArrow(_run.tidy(_contract), "u long, v long")
    e = _run.cut(e.distinct().withColumn("live", F.lit(True)), "links")
    while e.where("live").limit(1).count():
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        hooks = e.join(low, "u").where("v != m").selectExpr("greatest(v, m) u", "least(v, m) v", "true live")
        jump = low.join(low.selectExpr("u m", "m m2"), "m", "left").selectExpr("u", "coalesce(m2, m) v", "m2 is not null live")
        before, e = e, _run.cut(hooks.distinct().unionByName(jump), "links")
        _run.drop_cut(links.sparkSession, before)
    low = e.groupBy("u").agg(F.min("v").alias("root"))
    return low.selectExpr("u node", "root").unionByName(low.select(F.col("root").alias("node"), "root").distinct())
