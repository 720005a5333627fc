"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies,
target words over words there.  Whole copies are kept; the fractions are
rounded in pairs: words are moved at random from one document of a pair to the
other, with the right expectation for both, until one has a whole number of
copies, and the other goes on to the next pair.  Thus a source's words change
only by what the last document left over is rounded.  Documents are paired
within hashed buckets; the one left of each bucket is paired on the next level
with those of other buckets, a reduction tree up to one per source.

All chance comes from hashes of ids, so reruns agree whatever the partitioning.

Defined results: null and empty texts have size 0 and take 0 words; a null
source is a source of its own, the last; ties and repeated rows are told apart
by nothing and need not be, repeats may take unequal copies; further columns
are ignored; an empty table gives an empty table; sources without words have
target 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import _run

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of a bucket, and buckets that meet on a level of the tree.
BUCKET, FAN_IN = 4096, 64


def ranked(sources: DataFrame) -> DataFrame:
    """The rows of (source, ...) with ``pos``, their place by code point, null last, from 0; sorted in many tasks."""
    key = [F.col("source").isNull(), F.col("source")]
    rows = sources.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("task", F.spark_partition_id()).withColumn("own", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = _run.cut(rows, "ranked")  # tasks and places are fixed from here on
    before, found = 0, []
    for task, n in sorted((r.task, r.n) for r in rows.groupBy("task").agg(F.count("*").alias("n")).collect()):  # a row for each task
        found.append((task, before))
        before += n
    offsets = _run.local_rows(rows.sparkSession, found, "task int, before long")
    return rows.join(F.broadcast(offsets), "task").withColumn("pos", F.col("before") + F.col("own")).drop("task", "own", "before")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows).

    ``share`` of all sizes is split by weight, none above ``most`` times its
    size; what a source can't take is shared anew by weight until none is above.
    A source is full as soon as the words that come to a unit of weight exceed
    ``most`` times its size by weight, so each round is one sum over the table.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = _run.cut(ranked(sources).withColumn("weight", F.get(table, (F.col("pos") % len(weights)).cast("int"))), "sources")
    open_ = weighted.where("source_size > 0")
    total = open_.agg(F.sum("source_size")).first()[0] or 0
    unit, before = 0.0, None
    while before != unit and total:
        before = unit
        full = F.col("source_size") * most < F.col("weight") * unit
        gone, left = open_.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not left:
            unit = float("inf")
            break
        unit = (share * total - most * (gone or 0)) / left
    most_of = F.col("source_size") * F.lit(float(most))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(most_of, F.col("weight") * F.lit(unit)))
    return weighted.select("source", "source_size", "rows", target.alias("target"))


def pivot(size: np.ndarray, share: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Round fractions (0 to 1) of documents in order; at most one is left fractional.

    A pair exchanges words, so that size * share keeps its sum: up to what fills
    or empties one of the two, either way with the probability that keeps both
    expectations.
    """
    out = share.astype(float).copy()
    held = -1
    for i in range(len(out)):
        if not 0.0 < out[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up = min((1.0 - out[held]) * a, out[i] * b)
        down = min(out[held] * a, (1.0 - out[i]) * b)
        move = up if chance[i] * (up + down) < down else -down
        x, y = out[held] + move / a, out[i] - move / b
        # one of the two has reached a bound, up to rounding
        near = min((abs(x), 0), (abs(1 - x), 1), (abs(y), 2), (abs(1 - y), 3))[1]
        x, y = (0.0 if near == 0 else 1.0 if near == 1 else x), (0.0 if near == 2 else 1.0 if near == 3 else y)
        x, y = (v if 1e-12 < v < 1 - 1e-12 else float(round(v)) for v in (x, y))
        out[held], out[i] = x, y
        if not 0.0 < x < 1.0:
            held = i if 0.0 < y < 1.0 else -1
    return out


def _round_bucket(rows: pa.Table) -> pa.Table:
    """Arrow throughout: pandas would make numbers with a decimal point of ids as soon as one is null."""
    rows = rows.sort_by([(c, "ascending") for c in ("chance", "doc_id", "size")])
    size, share, chance = (rows.column(c).to_numpy() for c in ("size", "share", "chance"))
    return rows.set_column(rows.column_names.index("share"), "share", pa.array(pivot(size.astype(float), share, chance)))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies, taken)`` of each row of (doc_id, text, source)."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = _run.cut(docs.select("doc_id", "source", size.alias("size")), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    table = _run.cut(targets(found, weights, share, most).select(F.col("source").alias("origin"), "source_size", "target", F.ceil(F.col("rows") / BUCKET).cast("long").alias("buckets")), "targets")
    fraction = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.when(F.col("size") > 0, F.floor(fraction)).otherwise(F.lit(0)).cast("long")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(1 << 40)) / float(1 << 40)
    rows = sized.join(table, F.col("source").eqNullSafe(F.col("origin"))).drop("origin")
    rows = rows.select("doc_id", "source", "size", "source_size", "target", whole.alias("whole"), chance.alias("chance"), F.when(F.col("size") > 0, fraction - whole).otherwise(0.0).alias("share"), F.pmod(F.xxhash64("doc_id", "size", F.lit("bucket")), F.col("buckets")).alias("bucket"))
    kind = rows.schema
    rows = _run.cut(rows.groupBy("source", "bucket").applyInArrow(_round_bucket, kind), "rounded")
    done, level = [rows.where("share in (0, 1)")], 0
    left = rows.where("share not in (0, 1)")
    most_buckets = table.agg(F.max("buckets")).first()[0] or 1
    while most_buckets > 1:
        most_buckets, level = -(-most_buckets // FAN_IN), level + 1
        left = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        left = left.withColumn("chance", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(1 << 40)) / float(1 << 40))
        left = _run.cut(left.groupBy("source", "bucket").applyInArrow(_round_bucket, kind), "rounded")
        done.append(left.where("share in (0, 1)"))
        left = left.where("share not in (0, 1)")
    last = F.pmod(F.xxhash64("doc_id", F.lit("last")), F.lit(1 << 40)) / float(1 << 40)
    done.append(left.withColumn("share", F.when(last < F.col("share"), 1.0).otherwise(0.0)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.col("whole") + F.col("share").cast("long")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each as often as it has copies.

    Rows that share a doc_id are each taken as often as the one with the most copies.
    """
    with _run.tables() as made:
        copies = mix(docs)
    taken = copies.groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("copies").alias("copies")).where("copies > 0")
    taken = _run.cut(taken, "taken")
    _run.drop_cut(docs.sparkSession, *made)
    out = docs.join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(*docs.columns)


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` with source weights 5, 2, 1, repeating."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
