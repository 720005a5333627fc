"""The evaluation pipelines end to end: programs from generations and tests, their outcomes, metrics with metadata.

A pipeline never runs a model: generations are a table.  ``exec`` makes programs
and gets their outcomes from a function that is handed in, ``eval`` turns
outcomes into metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import execution, reports, splits

Run = Callable[[DataFrame], DataFrame]


def with_generations(problems: DataFrame, generations: DataFrame, key: str, missing: str = "skip") -> DataFrame:
    """Problems with their generations; one without any is left out, or ends the job with ``missing="fail"``."""
    if missing == "skip":
        return problems.join(generations, key)
    found = F.lit(True).alias("_found")
    rows = problems.join(generations.select("*", found), key, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no generations for "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(checked).drop("_found")


def fan_out(rows: DataFrame, key: str, texts: str, tests: str, imports: Column, implementation: Column, enforcement: Column, first: int | None = None) -> DataFrame:
    """(key, decode_idx, test_idx, variant, program): each generated text with each test, with and without the update."""
    some = F.col(tests) if first is None else F.slice(tests, 1, first)
    out = rows.select(key, some.alias("_tests"), imports.alias("_imports"), implementation.alias("_new"), enforcement.alias("_force"), F.posexplode(texts).alias("decode_idx", "_text"))
    out = out.select("*", F.posexplode("_tests").alias("test_idx", "_test"))
    name = F.regexp_extract("_test", r"def\s++(\w++)", 1)
    parts = (F.col("_imports"), F.col("_new"), F.col("_force"), text.solution(F.col("_text")), F.col("_test"), name)
    both = F.array(*[F.struct(F.lit(v).alias("variant"), text.program(*parts, with_update=v == "w").alias("program")) for v in ("w", "wo")])
    return out.select(key, "decode_idx", "test_idx", F.explode(both).alias("x")).select(key, "decode_idx", "test_idx", "x.*")


def realigned(inputs: DataFrame, outputs: DataFrame, n: int) -> DataFrame:
    """Inputs (pos, ...) with the outputs (pos, output) of their slice: input i has outputs i*n to i*n+n-1."""
    own = outputs.select(F.floor(F.col("pos") / n).cast("int").alias("pos"), (F.col("pos") % n).cast("int").alias("decode_idx"), "output")
    return inputs.join(own, "pos")


def matched_tasks(texts: DataFrame, tasks: DataFrame, key: str, order: str) -> DataFrame:
    """Texts with the first task of their key; those without one are left out."""
    first = tasks.groupBy(key).agg(F.min(F.struct(order, *[c for c in tasks.columns if c not in (key, order)])).alias("x"))
    return texts.join(first.select(key, "x.*"), key)


def with_metadata(metrics: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Metrics with what is known of their problem; of a column in both the metadata's counts."""
    return metrics.drop(*[c for c in metadata.columns if c != key]).join(metadata, key, "left")


def longest_text(rows: DataFrame, column: str) -> DataFrame:
    """(tokens): the most blank-separated tokens that a training text has."""
    return rows.agg(F.max(F.regexp_count(F.col(column), F.lit(r"\S+"))).alias("tokens"))


def concatenated(lists: list[DataFrame], pos: str, item: str) -> DataFrame:
    """(pos, item) of ordered lists put one after the other."""
    out = None
    for k, rows in enumerate(lists):
        part = rows.select(F.lit(k).alias("_list"), F.col(pos).cast("long").alias("_own"), item)
        out = part if out is None else out.unionByName(part)
    sizes = out.groupBy("_list").agg(F.count(F.lit(1)).alias("_n"))  # a row for each list
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._list") < F.col("a._list"), "left").groupBy(F.col("a._list").alias("_list")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return out.join(F.broadcast(before), "_list").select((F.col("_before") + F.col("_own")).alias(pos), item)


def outcomes_of(programs: DataFrame, key: str, run: Run) -> DataFrame:
    """Paired outcomes of programs made by :func:`fan_out`; ``run`` adds ``result`` to each."""
    return execution.paired_outcomes(run(programs), [key, "decode_idx", "test_idx"])


def metrics_of(outcomes: DataFrame, key: str, metadata: DataFrame, decode: str = "decode_idx", criterion: Column | None = None) -> DataFrame:
    """Metrics of each problem with its metadata."""
    programs = reports.program_reports(outcomes, [key, decode])
    return with_metadata(reports.problem_metrics(programs, [key], criterion=criterion), metadata, key)


def prepending(usage: str, key: str, *, programs: DataFrame | None = None, run: Run | None = None, outcomes: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """Updates in the prompt: ``exec`` gives outcomes of programs, ``eval`` metrics of outcomes."""
    if usage == "exec":
        return outcomes_of(programs, key, run)
    if usage == "eval":
        return metrics_of(outcomes, key, metadata)
    raise ValueError(f"usage {usage}")


def tuning(usage: str, key: str, group: str, order: str, *, problems: DataFrame, n_train: int = 2, partners: DataFrame | None = None, sample: DataFrame | None = None, first: int = 25, programs: DataFrame | None = None, run: Run | None = None, outcomes: DataFrame | None = None, metadata: DataFrame | None = None, completions: DataFrame | None = None) -> DataFrame:
    """Models tuned on updates.

    ``exec`` and ``rand_exec`` give outcomes of the programs of problems that a
    split tests, by the group's own examples or the partner group's first;
    ``eval`` and ``rand_eval`` metrics of those problems; ``specificity`` the
    pass rates of completion tasks for models tuned on sampled groups.
    """
    if usage == "specificity":
        tuned = splits.sampled_first(problems, sample, group, order, key, first).select(group)
        return reports.completion_metrics(completions.join(tuned, group, "left_semi"), "task_id")
    if usage.startswith("rand_"):
        tested = splits.partner_first(problems.select(group, order, key), partners, group, order, key).select(key)
    else:
        tested = splits.circular_splits(problems, group, order, key, n_train).where("enough").select(key)
    if usage.endswith("exec"):
        return outcomes_of(programs.join(tested, key, "left_semi"), key, run)
    if usage.endswith("eval"):
        return metrics_of(outcomes.join(tested, key, "left_semi"), key, metadata)
    raise ValueError(f"usage {usage}")
