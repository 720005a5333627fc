"""The ledger stream: new keys once, however often batches come."""

from pyspark.sql import types as T

from quernstone.streaming import generations


def test_append_new(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    source, ledger, marks = (str(tmp_path / x) for x in ("source", "ledger", "marks"))
    for rows in ([(1, "a"), (2, "b"), (1, "a")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = generations.append_new(generations.read_stream(spark, source, schema), ledger, ["k"], marks)
        q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.read.parquet(ledger).collect()) == [(1, "a"), (2, "b"), (3, "c")]
