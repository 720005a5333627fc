"""Ledgers: work that is done is never done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(*parts: str | Column) -> Column:
    """A ledger key from its parts; null parts differ from empty ones."""
    return F.sha2(F.to_json(F.struct(*[F.col(p).alias(f"k{i}") if isinstance(p, str) else p.alias(f"k{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def missing(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that no ledger row has; put before whatever is costly."""
    return work.join(done.select(*keys), keys, "left_anti")


def incomplete(work: DataFrame, artefacts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Work that lacks at least one of several artefacts."""
    done = artefacts[0].select(*keys)
    for a in artefacts[1:]:
        done = done.join(a.select(*keys), keys, "left_semi")
    return missing(work, done, keys)


def merged(ledger: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger with new rows added; what it has already stays."""
    return ledger.unionByName(fresh.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti"))


def memoize(work: DataFrame, ledger_path: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute only keys that the Parquet ledger lacks, append them, and return all of ``work``'s results.

    ``compute`` gets distinct keys and returns them with their results.
    """
    spark = work.sparkSession
    wanted = work.select(*keys).distinct()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        wanted = missing(wanted, spark.read.parquet(ledger_path), keys)
    compute(wanted).write.mode("append").parquet(ledger_path)
    return work.join(spark.read.parquet(ledger_path), keys, "left")
