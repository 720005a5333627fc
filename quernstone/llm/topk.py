"""Exact top-k by inner product with KD-trees per shard.

The space is cut into at most ``CELLS`` cells by median splits of a bounded
sample on the widest dimension; vectors of a cell that are too many for one
shard are dealt out within it by hash.  Each shard gets one KD-tree: median
splits on the widest dimension, and the tight bounding box of the rows below
each node.  The inner product of a query with anything in a box is at most the
sum over dimensions of the larger of query times low and query times high; a
best-first traversal opens the node with the highest bound until no bound
reaches the k-th best score so far.  A query is first searched in its home
shard; the k-th score found there goes with it to the shards of those cells
whose bounding box, of all their vectors, can reach it.  The table of cell
boxes is small whatever the input is, and every task has it.

Components are quantised to ``floor(256 * x)``, so scores are exact integers.

Defined results: vectors that are null or empty, or hold null or non-finite
components, or have a null id, take no part; vectors of different lengths don't
meet; a query's own row is every row with its vec_id, and a query that repeats
is answered once; ties go to the smaller vec_id, rows that repeat fill as many
ranks; scores beyond 64 bits are set to the nearest 64-bit number; further
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quernstone.llm import _run

#: Vectors of a shard, queries of a block, and vectors of a leaf.
SHARD, BLOCK, LEAF = 4096, 8192, 64
#: Cells that the space is cut into at most, and vectors of the sample that the cuts are made from.
CELLS, SAMPLE = 256, 1 << 14
EXACT = 2.0**53


class Tree:
    """A KD-tree in arrays: rows in leaf order, a box and two children for each node."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.arange(len(ids))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.part: list[tuple[int, int]] = []

        def build(i: int, j: int) -> int:
            at = len(self.low)
            own = rows[order[i:j]]
            lo, hi = own.min(0), own.max(0)
            self.low.append(lo)
            self.high.append(hi)
            self.part.append((i, j))
            self.kids.append(None)
            wide = int((hi - lo).argmax())
            if j - i > LEAF and hi[wide] > lo[wide]:
                half = (j - i) // 2
                order[i:j] = order[i:j][np.argpartition(own[:, wide], half)]
                self.kids[at] = (build(i, i + half), build(i + half, j))
            return at

        build(0, len(ids))
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.greatest = float(np.abs(rows).max(initial=0))

    def search(self, queries: np.ndarray, own: np.ndarray, kth: list[float], k: int):
        """For each query its k best (score, id), best first, none below its ``kth``."""
        small = self.greatest * float(np.abs(queries).max(initial=0)) * queries.shape[1] < EXACT
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        for q, me, bar, bound in zip(queries, own.tolist(), kth, bounds):
            best: list[tuple[float, int]] = []  # a heap of (score, -id): the worst first
            todo = [(-bound[0], 0)]
            while todo:
                reach, node = heapq.heappop(todo)
                if small and -reach < bar:
                    break  # nothing left can reach the k-th score
                if self.kids[node]:
                    for kid in self.kids[node]:
                        if not small or bound[kid] >= bar:
                            heapq.heappush(todo, (-bound[kid], kid))
                    continue
                i, j = self.part[node]
                if small:
                    scores = self.rows[i:j] @ q
                    good = np.flatnonzero(scores >= bar)
                    pairs = zip(scores[good].tolist(), self.ids[i:j][good].tolist())
                else:
                    exact = [int(x) for x in q]
                    pairs = ((sum(int(a) * b for a, b in zip(r, exact)), n) for r, n in zip(self.rows[i:j], self.ids[i:j].tolist()))
                for s, n in pairs:
                    if n == me:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -n))
                    elif (s, -n) > best[0]:
                        heapq.heapreplace(best, (s, -n))
                if len(best) == k:
                    bar = max(bar, best[0][0])
            yield sorted(best, reverse=True)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


class Cells:
    """Median splits of a sample, for vectors of each length: a full binary tree of cells."""

    def __init__(self, sample: dict[int, np.ndarray], depth: int) -> None:
        self.depth, self.cuts = depth, {}
        for dim, rows in sample.items():
            where, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
            held = {0: rows}
            for node in range((1 << depth) - 1):
                own = held.pop(node)
                if len(own):
                    where[node] = int((own.max(0) - own.min(0)).argmax())
                    value[node] = np.median(own[:, where[node]])
                below = own[:, where[node]] < value[node]
                held[2 * node + 1], held[2 * node + 2] = own[below], own[~below]
            self.cuts[dim] = where, value

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        node = np.zeros(len(rows), np.int64)
        if rows.shape[1] in self.cuts:
            where, value = self.cuts[rows.shape[1]]
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[np.arange(len(rows)), where[node]] >= value[node])
            node -= (1 << self.depth) - 1
        return node


def _by_length(batch: pa.RecordBatch, column: str):
    """(rows, matrix) of the vectors of each length in a batch."""
    v = batch.column(batch.schema.get_field_index(column))
    n = v.value_lengths().to_numpy()
    for dim in np.unique(n).tolist():
        rows = np.flatnonzero(n == dim)
        yield rows, _matrix(v.take(pa.array(rows)))


def with_cells(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(vec_id, v, dim, cell)."""
    shared = vectors.sparkSession.sparkContext.broadcast(cells)

    def run(it):
        for b in it:
            cell = np.zeros(b.num_rows, np.int64)
            for rows, m in _by_length(b, "v"):
                cell[rows] = shared.value.of(m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["vec_id", "v", "dim", "cell"])

    return vectors.select("vec_id", "v", "dim").mapInArrow(_run.tidy(run), "vec_id long, v array<double>, dim int, cell long")


def boxes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vectors: cells, and the low and high corners of their bounding boxes."""

    def part(it):
        for b in it:
            cell = b.column(b.schema.get_field_index("cell")).to_numpy()
            for rows, m in _by_length(b, "v"):
                for c in np.unique(cell[rows]).tolist():
                    own = m[cell[rows] == c]
                    yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([c]), pa.array([own.min(0)]), pa.array([own.max(0)])], ["dim", "cell", "low", "high"])

    rows = vectors.mapInArrow(_run.tidy(part), "dim int, cell long, low array<double>, high array<double>")
    sides = rows.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("dim", "cell", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    whole = sides.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("x"))  # a vector's length
    found: dict[int, list] = {}
    for r in whole.collect():  # at most CELLS rows for each length of vectors
        found.setdefault(r.dim, []).append((r.cell, [s.low for s in r.x], [s.high for s in r.x]))
    return {d: tuple(np.array(c) for c in zip(*x)) for d, x in found.items()}


def reachable(queries: DataFrame, corners: dict) -> DataFrame:
    """The queries (vec_id, v, dim, kth, ...) with ``cells``: those that can hold a score of at least ``kth``."""
    shared = queries.sparkSession.sparkContext.broadcast(corners)
    names = queries.columns

    def run(it):
        for b in it:
            kth = b.column(names.index("kth")).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            out: list[list[int]] = [[] for _ in range(b.num_rows)]
            for rows, m in _by_length(b, "v"):
                if m.shape[1] not in shared.value:
                    continue
                cell, low, high = shared.value[m.shape[1]]
                reach = np.maximum(m, 0) @ high.T + np.minimum(m, 0) @ low.T
                exact = (np.abs(m) @ np.maximum(np.abs(low), np.abs(high)).T).max(initial=0) < EXACT  # beyond that, rounding could hide a cell
                for i, r, q in zip(rows.tolist(), reach, kth[rows]):
                    out[i] = cell[r >= q].tolist() if exact else cell.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*names, "cells"])

    return queries.mapInArrow(_run.tidy(run), T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))]))


_OUT = "query_id long, vec_id long, score long, block long, dim int"


def _search(k: int, home: bool):
    names = ["query_id", "vec_id", "score", "block", "dim"]

    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows and queries.num_rows:
            ids, rows = vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v"))
            order = np.argsort(ids, kind="stable")
            tree = Tree(ids[order], rows[order])
            own = queries.column("vec_id").to_numpy()
            bars = [-np.inf] * len(own) if home else [-np.inf if x is None else float(x) for x in queries.column("kth").to_pylist()]
            block = queries.column("block").to_pylist()
            for me, b, found in zip(own.tolist(), block, tree.search(_matrix(queries.column("v")), own, bars, k)):
                out += [(me, -n, max(min(int(s), 2**63 - 1), -(2**63)), b, rows.shape[1]) for s, n in found]
        kinds = [pa.int64()] * 4 + [pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows of ``vectors`` for each row of ``queries``.

    Both have (vec_id long, v array<double>) with whole numbers in ``v``.  Each
    task has one shard and one block of queries that can reach its cell.
    """
    dim = F.size("v").alias("dim")
    usable = vectors.select("vec_id", "v", dim).where("dim > 0")
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().combine_chunks()
    found = {m.shape[1]: m for b in sample.to_batches() for _, m in _by_length(b, "v")}
    shards = max(1, -(-usable.count() // SHARD))
    cells = Cells(found, min(shards, CELLS).bit_length() - 1)
    subs = max(1, -(-shards // (1 << cells.depth)))
    sub = F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(subs))
    rows = _run.cut(with_cells(usable, cells).select("vec_id", "v", "dim", "cell", (F.col("cell") * subs + sub).alias("shard")), "vectors")
    queries = queries.select("vec_id", "v", dim).where("dim > 0").dropDuplicates(["vec_id"])
    asked = with_cells(queries, cells).select("vec_id", "v", "dim", (F.col("cell") * subs + sub).alias("home"))
    asked = _run.cut(asked, "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)))

    def search(vs, qs, keys, home):
        return vs.groupBy(*keys).cogroup(qs.groupBy(*keys)).applyInArrow(_search(k, home), _OUT)

    wide = rows.drop("cell").withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    first = _run.cut(search(wide, asked.withColumnRenamed("home", "shard"), ["shard", "block", "dim"], True), "home")
    least = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k)
    asked = asked.join(least.select(F.col("query_id").alias("vec_id"), "kth"), "vec_id", "left")
    asked = reachable(asked, boxes(rows)).withColumn("shard", F.explode(F.expr(f"flatten(transform(cells, c -> sequence(c * {subs}, c * {subs} + {subs - 1})))")))
    asked = asked.where("shard != home").drop("home", "cells")
    found = first if shards == 1 else first.unionByName(search(wide, asked, ["shard", "block", "dim"], False))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def quantised(table: DataFrame) -> DataFrame:
    """(vec_id, v): ``floor(256 * x)`` of each component, usable vectors only."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor() gives a bigint, which large components exceed: round and correct instead
    near = F.transform(v, lambda x: F.rint(x * 256.0))
    whole = F.zip_with(v, near, lambda x, r: F.when(r > x * 256.0, r - 1.0).otherwise(r))
    return table.where("vec_id is not null and embedding is not null").where(~bad).select("vec_id", whole.alias("v"))


def op6_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best for each vector whose id is divisible by 50."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


OP6_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM (SELECT * FROM e WHERE vec_id % 50 = 0) q JOIN e ON e.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
