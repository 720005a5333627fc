"""What several operators need from the session: shared tables and settings."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and there is one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs a re-read of the table, never a rerun of what made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}):
        writer = df.write.mode("error")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    for made in _MADE:
        made.append(table)
    return table


#: Lists that tables written by :func:`cut` go on, while they are wanted.
_MADE: list[list[DataFrame]] = []


@contextmanager
def tables():
    """A list of the tables that are written in a block, so that they can be dropped after their last reader."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE[:] = [x for x in _MADE if x is not made]


def names(schema: str) -> list[str]:
    """The column names of a schema of plain types."""
    return [x.split()[0] for x in schema.split(", ")]


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as part of the plan, of a size that the optimizer knows."""
    kind = spark.createDataFrame([], schema).schema
    columns = zip(*rows) if rows else [[] for _ in kind]
    return spark.createDataFrame(pa.table({f.name: pa.array(list(c), to_arrow_type(f.dataType)) for f, c in zip(kind, columns)}), kind)


def drop_cut(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables written by :func:`cut` that nothing reads any more."""
    for t in tables:
        for f in t.inputFiles()[:1]:
            root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
            root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Set session settings for a block and put the old ones back."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def release() -> None:
    """Give free memory back: workers live on, and what one task has freed would stay theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


#: Functions that make a worker forget what an operator keeps between its tasks.
FORGET: list[Callable[[], None]] = []


def tidy(run: Callable, remember: bool = False) -> Callable:
    """``run`` for mapInArrow, with memory given back at a task's end.

    Unless it says so, it also forgets what tasks of other operators have kept.
    """

    def tidied(batches):
        if not remember:
            for forget in FORGET:
                forget()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
