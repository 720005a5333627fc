"""Small constant tables, part of the plan itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def constant_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A local relation: no job makes it, and its size is known to the optimizer."""
    kind = spark.createDataFrame([], schema).schema
    columns = zip(*rows) if rows else [[] for _ in kind]
    return spark.createDataFrame(pa.table({f.name: pa.array(list(c)) for f, c in zip(kind, columns)}), kind)
