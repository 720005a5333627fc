"""Rejection sampling: attempts, the first that holds, and what it cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rejection_stats(attempts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """From (keys, attempt from 0, ok): the first good attempt below ``most``, attempts used and yield.

    An item without a good attempt has used as many as it has, ``most`` at most.
    """
    first = attempts.where(F.col("attempt") < most).groupBy(*keys).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("chosen"), F.count(F.lit(1)).alias("made"))
    used = F.coalesce(F.col("chosen") + 1, F.col("made")).cast("int")
    failed = (used - F.when(F.col("chosen").isNotNull(), 1).otherwise(0)).cast("int")
    return first.select(*keys, "chosen", used.alias("num_attempts"), (F.lit(1.0) - failed / F.lit(float(most))).alias("yield_rate"), F.format_string(f"1 - %d / {most}", failed).alias("yield_text"))


def best_of_attempts(attempts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """From (keys, attempt, rate, exclusive): the first attempt with rate >= threshold and an exclusive pass.

    Items without one stay, with nulls.
    """
    good = (F.col("rate") >= threshold) & (F.col("exclusive") > 0)
    return attempts.groupBy(*keys).agg(F.min(F.when(good, F.struct("attempt", "rate"))).alias("x")).select(*keys, F.col("x.attempt").alias("attempt"), F.col("x.rate").alias("rate"))


def accepted(reports: DataFrame, threshold: float = 0.7) -> DataFrame:
    return reports.where((F.col("rate") >= threshold) & (F.col("num_excl") > 0))


def checks_folded(checks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Ordered checks (name, ok, message) of each item up to the first that fails."""
    every = F.array_sort(F.collect_list(F.struct(order, "name", "ok", "message")))
    rows = checks.groupBy(*keys).agg(every.alias("c"))
    bad = F.array_min(F.transform(F.filter("c", lambda x: ~x["ok"]), lambda x: x[order]))
    upto = F.filter("c", lambda x: F.col("stop").isNull() | (x[order] <= F.col("stop")))
    rows = rows.withColumn("stop", bad).withColumn("c", upto)
    return rows.select(*keys, F.transform(F.filter("c", lambda x: x["ok"]), lambda x: x["name"]).alias("passed"), F.get(F.transform(F.filter("c", lambda x: ~x["ok"]), lambda x: x["name"]), F.lit(0)).alias("failed"))
