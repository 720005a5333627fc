"""From outcomes of unit tests, with and without an update, to metrics of problems.

One row of outcomes is a test of a program: ``w`` whether it passes with the
update, ``o`` whether it passes without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.metrics import pass_at_k, pass_at_ks, share_percent

KS = (1, 2, 5, 10)


def program_reports(outcomes: DataFrame, keys: list[str], expected: Column | None = None) -> DataFrame:
    """A row for each program: counts, rates and whether all tests passed.

    With ``expected`` (a column that is constant in a program) ``finished`` says
    whether that many outcomes are there; rates of unfinished programs are null.
    """
    w, o = F.coalesce("w", F.lit(False)), F.coalesce("o", F.lit(False))
    n = F.count(F.lit(1))
    out = outcomes.groupBy(*keys).agg(
        n.alias("num_tests"),
        F.count_if(w).alias("num_w"),
        F.count_if(o).alias("num_o"),
        F.count_if(w & ~o).alias("num_excl"),
        F.count_if(w & o).alias("num_incl"),
        (n == F.max(expected) if expected is not None else F.lit(True)).alias("finished"),
    )
    return (
        out.withColumn("all_w", F.col("num_w") == F.col("num_tests"))
        .withColumn("all_o", F.col("num_o") == F.col("num_tests"))
        .withColumn("rate", F.when(F.col("finished"), F.col("num_w") / F.col("num_tests")))
        .withColumn("rate_o", F.when(F.col("finished"), F.col("num_o") / F.col("num_tests")))
    )


def default_criterion() -> Column:
    """All tests pass with the update and not all without."""
    return F.col("all_w") & ~F.col("all_o")


def problem_metrics(programs: DataFrame, keys: list[str], ks: tuple[int, ...] = KS, digits: int | None = 6, criterion: Column | None = None) -> DataFrame:
    """A row for each problem from rows of ``program_reports`` that carry its keys.

    ``criterion`` says which programs count as solved through the update (``c_new_excl``, ``upass``).

    ``unsolved_pct`` counts programs that pass neither exclusively: those that
    pass both ways are unsolved too.
    """
    w, o = F.col("all_w"), F.col("all_o")
    counts = programs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(w).alias("c_new"),
        F.count_if(o).alias("c_old"),
        F.count_if(default_criterion() if criterion is None else criterion).alias("c_new_excl"),
        F.count_if(o & ~w).alias("c_old_excl"),
        (F.avg("rate") * 100).alias("accuracy_mean"),
        (F.stddev_pop("rate") * 100).alias("accuracy_std"),
        (F.avg((F.col("num_w") == F.col("num_o")).cast("double")) * 100).alias("unaffected_pct"),
        (F.avg((F.col("num_w") != F.col("num_o")).cast("double")) * 100).alias("affected_pct"),
    )
    out = counts.withColumn("unsolved_pct", share_percent(F.col("n") - F.col("c_old_excl") - F.col("c_new_excl"), F.col("n")))
    names = (("pass_{}_new", "c_new"), ("upass_{}", "c_new_excl"), ("pass_{}_old", "c_old"), ("pass_{}_old_excl", "c_old_excl"))
    for name, c in names:
        out = out.withColumn(f"_{c}", pass_at_ks(F.col("n"), F.col(c), ks))
    out = out.select(*counts.columns, "unsolved_pct", *[(F.col(f"_{c}")[i] * 100).alias(name.format(k)) for i, k in enumerate(ks) for name, c in names])
    if digits is not None:
        whole = {*keys, "n", "c_new", "c_old", "c_new_excl", "c_old_excl"}
        out = out.select(*[c if c in whole else F.round(c, digits).alias(c) for c in out.columns])
    return out


def completion_metrics(outcomes: DataFrame, key: str, ks: tuple[int, ...] = (1, 2, 5), digits: int = 6) -> DataFrame:
    """Pass@k (not in percent) of each task from rows of (key, passed, is_empty)."""
    counts = outcomes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"), F.count_if("is_empty").alias("n_empty"))
    return counts.select(key, "n", "c", "n_empty", *[F.round(pass_at_k(F.col("n"), F.col("c"), k), digits).alias(f"pass_{k}") for k in ks])


def rollup_by(metrics_rows: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Means by grouping sets of the keys: an extension for summaries."""
    return metrics_rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(v), digits).alias(v) for v in values])
