"""Generations as a stream: each micro-batch adds only what the ledger lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators.ledger import missing


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def append_new(stream: DataFrame, ledger: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append rows with new keys to a Parquet ledger; a batch that is run again adds nothing."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.dropDuplicates(keys)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = missing(rows, spark.read.parquet(ledger), keys)
        rows.write.mode("append").parquet(ledger)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
