"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set gets a signature of ``COORDINATES`` values, each
made of ``WIDTH`` minwise hashes so that one frequent passage does not make a
long posting list.  Sets are posted under each (coordinate, value) pair of the
first ``COORDINATES - MATCHES + 1`` coordinates: two sets that agree on at
least ``MATCHES`` coordinates meet there (prefix rule).  Within a posting list
collisions over the whole signature are counted, a pair already connected is
skipped, and pairs at the threshold are retained.  Links are then confirmed on
full sets.

At Jaccard 0.8 two sets agree on a coordinate with probability 0.512 and on
fewer than 4 of 32 with probability under 1e-6; all else is exact.

Long lists and large candidate groups are cut into blocks, and each pair of
blocks is looked at in its own task, so no task holds an unbounded group.

Defined results: null and empty texts have no shingles and link with nothing;
a document with fewer words than a shingle has its whole sequence as its one
shingle; equal texts share a class whatever their ids; ties and repeated rows
give repeated rows; a null doc_id never is the smallest of a class that has
others; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import _run, _text, graph

COORDINATES, WIDTH, MATCHES = 32, 3, 4
PREFIX = COORDINATES - MATCHES + 1
#: Documents of a posting list, and shingles of a candidate group, that one task takes.
LIST_ROWS, GROUP_SHINGLES = 2048, 4_000_000
#: A join side of at most so many rows of 24 bytes is sent to every executor.
BROADCAST_ROWS = 200_000

_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, (COORDINATES * WIDTH, 2), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingle hashes of each text, and how many."""
    data, off = _text.flat(column)
    data = _text.LOWER[data]
    starts, ends, counts = _text.word_spans(data, off)
    h, before = _text.shingle_hashes(_text.span_hashes(data, starts, ends), counts, words)
    sets = []
    for i, j in zip(before[:-1].tolist(), before[1:].tolist()):
        s = np.sort(h[i:j])
        if j - i > 1:
            keep = np.empty(j - i, bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        sets.append(s)
    return sets, np.array([len(s) for s in sets], np.int64)


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """What equal sets are known by; 0 for the empty one."""
    return np.array([_text.mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def signatures(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """COORDINATES values for each non-empty set; zeros for the empty ones."""
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    where = np.cumsum(sizes[full]) - sizes[full]
    low = np.empty_like(flat)
    for c in range(COORDINATES):
        value = np.full(len(full), c + 1, np.uint64)
        for a, b in _SEEDS[c * WIDTH : (c + 1) * WIDTH]:
            np.multiply(flat, a, out=low)
            low ^= low >> np.uint64(32)
            value = _text.mix(value * b + np.minimum.reduceat(low, where))
        out[full, c] = value
    return out


def row_key():
    """What a row is found by again: rows that share an id may have different texts."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, rid, node, n_shingles, coords) of each row; rows of equal sets have equal nodes."""

    def run(it):
        for b in _text.batches(it, 2 << 20):
            sets, n = shingle_sets(b.column(2), words)
            sig = signatures(sets, n).view(np.int64).ravel()
            coords = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) + 1, COORDINATES, dtype=np.int32)), pa.array(sig))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes_of(sets)), pa.array(n), coords], ["doc_id", "rid", "node", "n_shingles", "coords"])

    _run.small_batches(docs.sparkSession, 500)
    rows = docs.select("doc_id", row_key().alias("rid"), "text")
    return rows.mapInArrow(_run.tidy(run), "doc_id long, rid long, node long, n_shingles long, coords array<long>")


def _block_pairs(df: DataFrame, blocks, key: str, node: str) -> DataFrame:
    """Repeat each row for the pairs of blocks that its own block takes part in."""
    own = F.pmod(F.xxhash64(node, F.lit(7)), F.col("blocks"))
    df = df.withColumn("blocks", blocks).withColumn("own", own)
    df = df.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return df.withColumn("run", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"), F.lit(3))).drop("blocks", "own", "other")


def _meet(it):
    """Spanning links of every posting list at the collision threshold."""
    for t, at in _text.runs(it, "run"):
        node = t.column("node").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.int16).reshape(-1, COORDINATES)
        size = np.diff(at)
        two = at[:-1][size == 2]
        hit = two[(sig[two] == sig[two + 1]).sum(1) >= MATCHES]
        us, vs = [node[hit]], [node[hit + 1]]
        for i, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
            m = sig[i : i + n]
            for a, b in graph.spanning(n, lambda k, others: (m[others] == m[k]).sum(1) >= MATCHES):
                us.append(node[i + a : i + a + 1])
                vs.append(node[i + b : i + b + 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect all sets agreeing on MATCHES coordinates, from (node, coords)."""
    posts = nodes.select("node", F.explode(F.slice("coords", 1, PREFIX)).alias("post"))
    lists = posts.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    short = F.transform("coords", lambda x: F.hex(F.shiftrightunsigned(x, 48).cast("int")))
    sketch = F.unhex(F.array_join(F.transform(short, lambda x: F.lpad(x, 4, "0")), ""))
    meet = posts.join(lists, "post").join(nodes.select("node", sketch.alias("sketch")), "node")
    meet = _block_pairs(meet, F.ceil(F.col("n") / LIST_ROWS), "post", "node").select("run", "node", "sketch")
    return meet.repartition("run").sortWithinPartitions("run").mapInArrow(_run.tidy(_meet), "u long, v long")


def _confirm(percent: int):
    def run(it):
        for t, at in _text.runs(it, "run"):
            node = t.column("node").to_numpy()
            data = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                sets = data[i:j]
                size = np.array([len(s) for s in sets], np.int64)
                flat, inv = np.unique(np.concatenate(sets), return_inverse=True)
                off = np.cumsum(size) - size
                mark = np.zeros(len(flat), np.int64)

                def linked(k, others):
                    own = inv[off[k] : off[k] + size[k]]
                    mark[own] = 1
                    if 2 * len(others) < len(size):
                        lens = size[others]
                        cut = np.cumsum(lens) - lens
                        pick = np.repeat(off[others] - cut, lens) + np.arange(int(lens.sum()))
                        both = np.add.reduceat(mark[inv[pick]], cut)
                    else:
                        both = np.add.reduceat(mark[inv], off)[others]
                    mark[own] = 0
                    return 100 * both >= percent * (size[k] + size[others] - both)

                edges = graph.spanning(j - i, linked)
                yield pa.RecordBatch.from_arrays([pa.array([int(node[i + a]) for a, _ in edges], pa.int64()), pa.array([int(node[i + b]) for _, b in edges], pa.int64())], ["u", "v"])

    return run


def confirmed_links(docs: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning links on full sets within the candidate groups (rid, node, root, n_shingles)."""

    def sets_of(it):
        for b in _text.batches(it, 2 << 20):
            sets, _ = shingle_sets(b.column(2), words)
            own = np.flatnonzero(nodes_of(sets) == b.column(1).to_numpy())  # a key is a hash: another row's text may have it
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own)), _text.binaries([sets[i] for i in own])], ["run", "node", "shingles"])

    total = groups.groupBy("root").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("members")).where("members > 1")
    side = groups.join(total, "root")
    side = _block_pairs(side, F.ceil(F.col("total") / GROUP_SHINGLES), "root", "node").select("rid", "run", "node")
    if groups.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    rows = docs.select(row_key().alias("rid"), "text").join(side, "rid").select("run", "node", "text")
    rows = rows.mapInArrow(_run.tidy(sets_of), "run long, node long, shingles binary")
    return rows.repartition("run").sortWithinPartitions("run").mapInArrow(_run.tidy(_confirm(percent)), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``.

    Two documents link if ``100 * |intersection| >= percent * |union|`` of
    their sets of ``words``-word shingles; a class is what links connect.
    """
    spark = docs.sparkSession
    all_rows = _run.cut(sketches(docs, words), "sketches")
    nodes = all_rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("label"), F.min("rid").alias("rid"), F.first("coords").alias("coords"), F.first("n_shingles").alias("n_shingles"))
    nodes = _run.cut(nodes, "nodes")
    groups = graph.components(candidate_links(nodes))
    groups = _run.cut(groups.join(nodes.select("node", "rid", "n_shingles"), "node"), "groups")
    _run.small_batches(spark, 500)
    classes = graph.components(confirmed_links(docs, groups, words, percent))
    named = classes.join(nodes.select("node", "label"), "node")
    names = named.groupBy("root").agg(F.min("label").alias("component_id"))
    named = named.join(names, "root").select("node", "component_id")
    alone = nodes.select("node", "label").join(named, "node", "left").select("node", F.coalesce("component_id", "label").alias("component_id"))
    out = all_rows.select("doc_id", "n_shingles", "node").join(alone, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that another one of their class stands for.

    Of rows that repeat a kept doc_id one stays.  Rows without an id stay.
    """
    with _run.tables() as made:
        near = near_duplicates(docs.select("doc_id", "text"), words, percent)
    marks = near.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    marks = _run.cut(marks.where("not kept or n > 1"), "marks")
    _run.drop_cut(docs.sparkSession, *made)
    out = docs.join(marks.select("doc_id").hint("merge"), "doc_id", "left_anti")
    again = marks.where("kept").select("doc_id")
    if again.limit(1).count():
        out = out.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*docs.columns)


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` by 4-word shingles at Jaccard 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4)
