"""Readers and writers, and the evaluation pipelines that have no query of their own."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import codecheck, execution
from quernstone.plans import testbeds
from quernstone.sources import arena
from quernstone.sources.constants import constant_rows


def test_id_map_and_list(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"a": "b", "b": "a"}))
    (tmp_path / "list.json").write_text(json.dumps(["x", "y", "z"]))
    assert sorted(map(tuple, arena.read_id_map(spark, str(tmp_path / "map.json")).collect())) == [("a", "b"), ("b", "a")]
    assert sorted(map(tuple, arena.read_id_list(spark, str(tmp_path / "list.json")).collect())) == [(0, "x"), (1, "y"), (2, "z")]


def test_list_files(spark, tmp_path):
    for name in ("a.json", "b.json", ".hidden"):
        (tmp_path / name).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in arena.list_files(spark, str(tmp_path)).collect()) == ["a.json", "b.json"]


def test_writers(spark, tmp_path):
    rows = constant_rows(spark, [("p1", "m1", 0.5), ("p2", "m2", 1.0)], "id string, model string, rate double")
    arena.write_by_model(rows, str(tmp_path / "by"))
    arena.write_by_model(rows, str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").glob("model=*")) == ["model=m1", "model=m2"]
    assert spark.read.parquet(str(tmp_path / "by")).count() == 4
    arena.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(r.id for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["p1", "p2"]
    arena.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    arena.write_text(rows, F.concat_ws(": ", "id", "model"), str(tmp_path / "text"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["p1: m1", "p2: m2"]


def test_outcomes_long_form(spark, tmp_path):
    rows = constant_rows(spark, [("p", 0, 1, "w", "passed"), ("p", 0, 1, "wo", "failed: x"), ("p", 0, 2, "w", "timed out")], "prog_syn_id string, decode_idx int, test_idx int, variant string, result string")
    out = execution.paired_outcomes(rows, ["prog_syn_id", "decode_idx", "test_idx"]).withColumn("model", F.lit("m"))
    arena.write_outcomes(out, str(tmp_path / "outcomes"))
    got = spark.read.schema(arena.OUTCOMES).parquet(str(tmp_path / "outcomes"))
    assert sorted((r.test_idx, r.w, r.o, r.result_wo) for r in got.collect()) == [(1, True, False, "failed: x"), (2, False, None, None)]


def test_ledgers_and_records(spark, tmp_path):
    failed = constant_rows(spark, [("u1", "no memory")], "id string, reason string")
    for _ in range(2):
        arena.append_record(failed, str(tmp_path / "failed"), "failed_work")
    got = spark.read.parquet(str(tmp_path / "failed"))
    assert [tuple(r) for r in got.select("id", "kind").collect()] == [("u1", "failed_work")] * 2
    with pytest.raises(ValueError):
        arena.append_record(failed, str(tmp_path / "failed"), "other")
    prompts = constant_rows(spark, [("u1", "train_prompt", "t")], "id string, kind string, text string")
    arena.write_records(prompts, str(tmp_path / "content"), with_tests=True)
    assert (tmp_path / "content-w_ut").exists() and arena.read_saved(spark, str(tmp_path / "content"), with_tests=True).count() == 1


def test_saved_updates_validated(spark):
    kind = ", ".join(f"{k} string" for k in ("description", "rationale", "docstring", "signature", "implementation", "api_path", "update_type")) + ", imports array<string>, unit_tests array<string>"
    good = ("d", "r", "doc", "m.f(a)", "def f(a): return a", "m.f", "modify-output-semantics", ["import m"], ["def test_a(): pass"])
    bad = (None, "r", "doc", "m.f(a)", "def f(a): return a", "m.f", "modify-x", ["import m"], ["def test_a(): pass"])
    a, b = sorted(arena.checked_updates(constant_rows(spark, [good, bad], kind)).collect(), key=lambda r: len(r.broken))
    assert a.broken == [] and a.enforcement == "m.f = f" and a.tests[0].name == "test_a" and a.wrapped.startswith("########## Start: Updated API implementation")
    assert b.broken == ["description", "update_type"]


def test_keyed_metadata(spark, tmp_path):
    (tmp_path / "m.f.json").write_text(json.dumps({"api_path": "m.f", "arguments_str": "a", "imports": ["import m"]}))
    items = constant_rows(spark, [("m.f",), ("m.g",)], "api_path string")
    got = {r.api_path: r.arguments_str for r in arena.with_api(items, arena.read_records(spark, str(tmp_path), arena.API, multi_line=True)).collect()}
    assert got == {"m.f": "a", "m.g": None}
    (tmp_path / "one.txt").write_text(json.dumps({"update": {"a": "x"}, "package": "p"}))
    assert arena.read_one(spark, str(tmp_path / "one.txt"), "update struct<a:string>, package string").first().update.a == "x"


def test_missing_generations(spark):
    problems = constant_rows(spark, [("a",), ("b",)], "id string")
    made = constant_rows(spark, [("a", ["x"])], "id string, texts array<string>")
    assert [r.id for r in testbeds.with_generations(problems, made, "id").collect()] == ["a"]
    with pytest.raises(Exception, match="no generations for b"):
        testbeds.with_generations(problems, made, "id", missing="fail").collect()
    with pytest.raises(ValueError):
        testbeds.prepending("other", "id")


def test_large_inputs_end(spark):
    big = "def f(" + "a, " * 300_000
    row = spark.range(1).select(text.signatures_in(F.lit(big)).alias("s"), text.string_list(F.lit(json.dumps(["x" * 1_000_000, "\"" * 5000]))).alias("l"), text.python_code(F.lit("'" * 20_001 + "x" + "'" * 20_001)).alias("c")).first()
    assert row.s == [] and [len(x) for x in row.l] == [1_000_000, 5000] and row.c == "x"


def test_guard():
    assert execution.run_program("open('own', 'w').write('x')\nassert open('own').read() == 'x'")[0] == "passed"
    assert execution.run_program("open('/tmp/not-own', 'w')")[0] == "failed: open"
    assert execution.run_program("import subprocess\nsubprocess.run(['true'])")[0].startswith("failed: ")
    assert execution.run_program("import os\nos.fork()")[0].startswith("failed: ")
    assert len(execution.run_program("print('x' * 300000)")[1]) == 300_001


def test_call_counts_of_computed_callees():
    import ast

    assert codecheck.call_counts(ast.parse("f(a())(b(), k=c())")) == {"f()": 1, "a()": 1}
    assert codecheck.call_counts(ast.parse("m.f(g(1)).h()")) == {".h()": 1, ".f()": 1, "g()": 1}
