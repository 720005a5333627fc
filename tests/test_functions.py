"""Column functions and small operators against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import ids, metrics, templates, text
from quernstone.operators import codecheck, execution, ledger, neardup, reports, selection, splits, taxonomy
from quernstone.sources import arena
from quernstone.sources.constants import constant_rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, rows, schema, column):
    return [r.x for r in constant_rows(spark, rows, schema).select(column.alias("x")).collect()]


def python_pass_at_k(n, c, k):
    return math.nan if n == 0 or c > n else 1.0 if n - c < k else 1 - math.prod(1 - k / i for i in range(n - c + 1, n + 1))


def test_pass_at_k_everywhere(spark):
    cases = [(n, c) for n in range(12) for c in range(n + 2)]
    for k in (1, 2, 5, 10):
        got = values(spark, cases, "n long, c long", metrics.pass_at_k(F.col("n"), F.col("c"), k))
        for (n, c), x in zip(cases, got):
            want = python_pass_at_k(n, c, k)
            assert math.isnan(x) if math.isnan(want) else abs(x - want) < 1e-12, (n, c, k)


def test_metrics_of_no_rows(spark):
    empty = spark.createDataFrame([], "p long, w boolean, o boolean")
    assert reports.problem_metrics(reports.program_reports(empty, ["p"]), ["p"]).count() == 0


def test_unfinished_programs_have_no_rate(spark):
    rows = constant_rows(spark, [(1, True, False, 2), (1, False, False, 2), (2, True, True, 2)], "p long, w boolean, o boolean, expected int")
    got = {r.p: r.rate for r in reports.program_reports(rows, ["p"], F.col("expected")).collect()}
    assert got == {1: 0.5, 2: None}


@pytest.mark.parametrize(
    ("id_", "parts"),
    [("[a.b]:[x-y]:[update-9]", ["a.b", "x-y", "update-9"]), ("aa:[bb]", ["aa", "[bb]"]), ("a:bb", None), (None, None)],
)
def test_decompose_id(spark, id_, parts):
    assert one(spark, ids.decompose_id(F.lit(id_).cast("string"))) == parts


def test_ordinal_is_a_number(spark):
    got = values(spark, [("[a]:[prog_syn-10]",), ("x-9",), ("x",)], "i string", ids.ordinal(F.col("i")))
    assert got == [10, 9, None]


def test_templates(spark):
    t = "a{% if c -%}\n [{{x}}]\n{% else %}none{% endif %}\nz"
    assert one(spark, templates.render(t, {"c": F.lit(True), "x": F.lit("v")})) == "a[v]\nz"
    assert one(spark, templates.render(t, {"c": F.lit(False), "x": F.lit("v")})) == "anonez"
    assert one(spark, templates.render("{{x}}", {"x": F.lit(None)})) == ""
    with pytest.raises(ValueError):
        templates.render("{% if c %}", {"c": F.lit(True)})


SOLUTIONS = {
    "x [PYTHON]a\nb[/PYTHON] [PYTHON]c[/PYTHON]": "a\nb",
    "[PYTHON][/PYTHON] ```python\nd```": "",
    "```python\nd\n``` ```e```": "d\n",
    "nothing": "",
}


def test_solutions(spark):
    got = values(spark, [(k,) for k in SOLUTIONS], "t string", text.solution(F.col("t")))
    assert got == list(SOLUTIONS.values())


def test_skeletons(spark):
    marks = ("# @A@", "# @B@")
    cases = [("x\n  # @A@ later\ny", "x\n  [INFILL]\ny"), ("# @A@\n# @B@", None), ("# @A@\n# @A@", None), ("x", None), ("y\n# @B@", "y\n[INFILL]")]
    assert values(spark, [c[:1] for c in cases], "t string", text.cut_skeleton(F.col("t"), marks)) == [c[1] for c in cases]
    filled = text.filled(F.lit("def t():\n    # @A@\n    # @A@"), "# @A@", F.lit("a\nb"))
    assert one(spark, filled) == "def t():\n    a\n    b\n    a\n    b"


def test_infill_dedents(spark):
    cases = [("```python\n  a\n    b\n\n  c```", "a\n  b\n\nc"), ("none", None), ("```\n  x```", "\n  x")]
    assert values(spark, [c[:1] for c in cases], "t string", text.infill(F.col("t"))) == [c[1] for c in cases]


def test_python_code_and_lists(spark):
    assert one(spark, text.python_code(F.lit("'\"x = 1\"'"))) == "x = 1"
    assert one(spark, text.python_code(F.lit("```python\ny\n```"))) == "y"
    assert one(spark, text.python_code(F.lit("  "))) is None
    assert one(spark, text.string_list(F.lit('["a", "b"]'))) == ["a", "b"]
    assert one(spark, text.string_list(F.lit('["a", 1]'))) is None
    assert one(spark, text.string_dict(F.lit('{"a": "b"}'), ("a",))) == {"a": "b"}
    assert one(spark, text.string_dict(F.lit('{"a": 1}'), ("a",))) is None


def python_sorted_imports(lines):
    if len(lines) <= 1:
        return lines
    lines = sorted(set(lines))
    most = max(map(len, lines))
    return sorted(lines, key=lambda x: (2 * most if "=" in x else 3 * most if "setattr(" in x else len(x), x))


def test_sorted_imports(spark):
    r = random.Random(3)
    pool = ["import a", "import bb", "x = 1", "setattr(a, b)", "import ccc", "setattr(a, 'b', c=1)"]
    cases = [([r.choice(pool) for _ in range(r.randint(0, 6))],) for _ in range(30)]
    got = values(spark, cases, "x array<string>", text.sorted_imports(F.col("x")))
    assert got == [python_sorted_imports(c[0]) for c in cases]


def test_signatures(spark):
    source = "def f(a,\n  b=1) -> int:\n  pass\ndef g():\n  pass"
    got = one(spark, text.signatures_in(F.lit(source)))
    assert [(s.name, s.arguments, s.returns) for s in got] == [("f", "a,b=1", "-> int"), ("g", "", "")]
    assert one(spark, text.imports_of_path(F.lit("a.b.c"))) == ["import a", "import a.b"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_circular_windows(spark, n):
    rows = [(g, i, f"{g}{i}") for g, size in (("a", 2), ("b", 3), ("c", 11)) for i in range(size)]
    got = {r.id: (r.train, r.enough) for r in splits.circular_splits(constant_rows(spark, rows, "g string, o int, id string"), "g", "o", "id", n).collect()}
    for g, size in (("a", 2), ("b", 3), ("c", 11)):
        u = [f"{g}{i}" for i in range(size)]
        for i, x in enumerate(u):
            want = (u[i - n : i] if i >= n else u[:i] + u[len(u) - (n - i) :]) if size > n else None
            assert got[x] == (want, size > n)


def test_taxonomy(spark):
    rows = taxonomy.dimension(spark).collect()
    assert len(rows) == 54 and sum(not r.is_banned for r in rows) == 17


def test_rejection(spark):
    rows = constant_rows(spark, [("a", 0, False), ("a", 1, True), ("a", 2, True), ("b", 0, False)], "k string, attempt int, ok boolean")
    got = {r.k: (r.chosen, r.num_attempts, round(r.yield_rate, 6)) for r in selection.rejection_stats(rows, ["k"], 3).collect()}
    assert got == {"a": (1, 2, round(1 - 1 / 3, 6)), "b": (None, 1, round(1 - 1 / 3, 6))}


def test_checks_folded(spark):
    rows = constant_rows(spark, [(1, 0, "parse", True, ""), (1, 1, "name", False, "m"), (1, 2, "boring", True, ""), (2, 0, "parse", True, "")], "k int, o int, name string, ok boolean, message string")
    got = {r.k: (r.passed, r.failed) for r in selection.checks_folded(rows, ["k"], "o").collect()}
    assert got == {1: (["parse"], "name"), 2: (["parse"], None)}


def test_memoize_computes_only_what_is_missing(spark, tmp_path):
    seen = []

    def compute(keys):
        seen.append(sorted(r.k for r in keys.collect()))
        return keys.withColumn("v", F.col("k") * 2)

    path = str(tmp_path / "ledger")
    first = ledger.memoize(spark.range(3).toDF("k"), path, ["k"], compute)
    assert sorted((r.k, r.v) for r in first.collect()) == [(0, 0), (1, 2), (2, 4)]
    second = ledger.memoize(spark.range(5).toDF("k"), path, ["k"], compute)
    assert sorted((r.k, r.v) for r in second.collect()) == [(k, 2 * k) for k in range(5)]
    assert seen == [[0, 1, 2], [3, 4]]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("words", [("x", "y", "z"), ("alpha", "b", "gamma", "dé")])
def test_token_distances(spark, words):
    r = random.Random(len(words))
    rows = [(i, [r.choice(words) for _ in range(r.randint(0, 9))]) for i in range(40)]
    rows += [(100, []), (101, ["x"]), (102, rows[0][1])]
    df = constant_rows(spark, rows, "id long, w array<string>")
    want = {(i, j): edits(a, b) for i, a in rows for j, b in rows if i < j}
    assert {(x.id_a, x.id_b): x.distance for x in neardup.scored_pairs(df, "id", "w").collect()} == want
    least = {}
    for i, w in rows:
        least.setdefault(tuple(w), i)
    reps = set(least.values())
    for k in (1, 2):
        near = {p: d for p, d in want.items() if d <= k and p[0] in reps and p[1] in reps}
        assert {(x.id_a, x.id_b): x.distance for x in neardup.pairs_within(df, "id", "w", k).collect()} == near
    assert {x.id: x["class"] for x in neardup.token_classes(df, "id", "w").collect()} == {i: least[tuple(w)] for i, w in rows}


CODE = {
    "def f(x):\n    return x": (True, "f", True, "boring"),
    "def f(x):\n    return len(list(x))": (True, "f", False, None),
    "def f(x):\n    if x:\n        return 1\n    return 0": (True, "f", False, None),
    "def f(): pass\ndef g(): pass": (True, None, None, "name"),
    "x = 1": (True, None, None, "name"),
    "def f(:": (False, None, None, "parse"),
    None: (True, None, None, "name"),
}


def test_static_checks(spark):
    got = values(spark, [(c,) for c in CODE], "c string", codecheck.checked(F.col("c")))
    assert [(x.parse_ok, x.name, x.boring, x.first_failed) for x in got] == list(CODE.values())


def test_anonymizer(spark):
    assert codecheck.anonymize("import numpy as np\ndef f(a: int) -> int:\n    return numpy.sum(a) + np") == "import numpy as np\n\ndef var0(var1):\n    return numpy.sum(var1) + var2"
    assert codecheck.anonymize("def f():\n    return") == "def f():\n    return"  # can't be visited
    assert codecheck.anonymize("def f(:") == "def f(:"
    assert codecheck.assertion_call("assert f(1) == 2") == "f(1)"
    assert codecheck.assertion_call("assert 1 == 2") is None
    assert [(s["kind"], s["text"]) for s in codecheck.statements("é = 1\nif é:  # why\n    x = 2")] == [("simple", "é = 1"), ("header", "if é:"), ("comment", "# why"), ("simple", "x = 2")]


def test_execution_is_off_by_default(spark):
    with pytest.raises(PermissionError):
        execution.executed(constant_rows(spark, [("x = 1",)], "program string"))


def test_results_of_programs():
    assert execution.run_program("print(1)")[0] == "passed"
    assert execution.run_program("assert 0")[0] == "failed: assertion error"
    assert execution.run_program("raise ValueError('no')")[0] == "failed: no"
    assert execution.run_program("raise SystemExit()")[0] == "failed: unknown error"
    assert execution.run_program("while True: pass", timeout=1)[0] == "timed out"
    assert execution.filter_imports(["import math", "import nothing_like_it", "x = math.pi"]) == ["import math", "x = math.pi"]


def test_traces_and_imports(spark):
    code = "def f(x):\n    y = x + 1\n    if y > 2:\n        return y\n    return\nf(1)\nf(2)"
    x = execution.traced(constant_rows(spark, [(code,), (code,), (None,), ("x =",)], "program string"), allow=True, tasks=1)
    got = {r.program: (r.result, r.states) for r in x.collect()}
    assert x.count() == 4 and got[None] == (None, None) and got["x ="][0].startswith("failed: ")
    result, states = got[code]
    assert result == "passed" and [{k: v.str_value for k, v in s.items()} for s in states] == [{"x": "1", "y": "2"}, {"x": "2", "y": "3", "_return_val": "3"}]
    rows = constant_rows(spark, [(1, ["import math", "import nothing_like_it"])], "k int, imports array<string>")
    r = execution.legal_imports(rows, allow=True, tasks=1).first()
    assert (r.legal, r.illegal) == (["import math"], ["import nothing_like_it"])


def test_arena_records(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('{"update": {"function_path": "m.f", "unit_tests": "a\\n\\nb", "imports": "import m\\nimport n"}, "update_id": "[m.f]:[t-x]:[update-1]", "prog_syn_id": "[m.f]:[t-x]:[update-1]:[prog_syn-10]", "scenario": "s", "problem": "p", "solution_signature": "g", "unit_tests": "t", "prog_syn_imports": "import q", "ref_solution": "r"}\n{broken\n')
    rows = arena.read_records(spark, str(path), arena.ARENA)
    good = rows.where("prog_syn_id is not null")
    apis = constant_rows(spark, [("m.f", None, "d", "a, b", "", "s", [])], "api_path string, source_code string, doc_string string, arguments_str string, return_type_hint string, summarized_doc string, imports array<string>")
    x = arena.normalized(good, apis).first()
    assert x.update.unit_tests == ["a", "b"] and x.update.old_signature == "m.f(a, b):" and x.package == "m" and x.prog_syn.imports == ["import q"]
    assert good.select(arena.arena_violations(good).alias("v")).first().v == []
    assert [r["_corrupt"] for r in rows.collect()] == [None, "{broken"]


def test_generation_files(spark, tmp_path):
    folder = tmp_path / "p-1" / "some model"
    folder.mkdir(parents=True)
    (folder / "generated_texts.json").write_text('["a", "b"]')
    got = arena.read_generation_files(spark, f"{tmp_path}/*/*/*.json").collect()
    assert sorted((r.prog_syn_id, r.model, r.decode_idx, r.text) for r in got) == [("p-1", "some model", 0, "a"), ("p-1", "some model", 1, "b")]
