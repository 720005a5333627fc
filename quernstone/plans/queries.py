"""The registered queries over the driver's tables.

The tables have no code, so each query says which column stands for which
concept; text operators build their input from the columns inside the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.functions import ids, templates, text
from quernstone.operators import instructions, ledger, neardup, reports, selection, splits, taxonomy
from quernstone.sources.constants import constant_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sql_pass(n: str, c: str, k: int) -> str:
    return f"CASE WHEN {n} - {c} < {k} THEN 1.0::DOUBLE ELSE 1 - coalesce(list_product(list_transform(generate_series({n} - {c} + 1, {n}), lambda x: 1 - {k}::DOUBLE / x)), 1) END"


def _sql_metrics() -> str:
    out = []
    for k in reports.KS:
        for name, c in ((f"pass_{k}_new", "c_new"), (f"upass_{k}", "c_new_excl"), (f"pass_{k}_old", "c_old"), (f"pass_{k}_old_excl", "c_old_excl")):
            out.append(f"round(100 * ({_sql_pass('n', c, k)}), 6) AS {name}")
    return ", ".join(out)


_PROBLEM = """count(*) AS n, count_if(all_w)::BIGINT AS c_new, count_if(all_o)::BIGINT AS c_old, count_if(all_w AND NOT all_o)::BIGINT AS c_new_excl, count_if(all_o AND NOT all_w)::BIGINT AS c_old_excl,
  round(100 * avg(rate), 6) AS accuracy_mean, round(100 * stddev_pop(rate), 6) AS accuracy_std,
  round(100 * avg((num_w = num_o)::INT), 6) AS unaffected_pct, round(100 * avg((num_w <> num_o)::INT), 6) AS affected_pct"""


@query(f"""
WITH t AS (SELECT l_orderkey, l_returnflag <> 'R' AS w, l_linestatus = 'O' AS o FROM lineitem),
p AS (SELECT l_orderkey, count(*) AS num_tests, count_if(w)::BIGINT AS num_w, count_if(o)::BIGINT AS num_o FROM t GROUP BY 1),
r AS (SELECT o_custkey, *, num_w = num_tests AS all_w, num_o = num_tests AS all_o, num_w::DOUBLE / num_tests AS rate FROM p JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT o_custkey, {_PROBLEM} FROM r GROUP BY 1)
SELECT *, round(100.0::DOUBLE * (n - c_old_excl - c_new_excl) / n, 6) AS unsolved_pct, {_sql_metrics()} FROM m
""")
def report_metrics(spark, folder):
    """Problems' metrics: a test is a lineitem, a program an order, a problem a customer."""
    tests = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("w"), (F.col("l_linestatus") == "O").alias("o"))
    programs = reports.program_reports(tests, ["l_orderkey"])
    owners = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return reports.problem_metrics(programs.join(owners, "l_orderkey"), ["o_custkey"])


@query(f"""
WITH m AS (SELECT source, count(*) AS n, count_if(quality = 1)::BIGINT AS c_new, count_if(toxic = 1)::BIGINT AS c_old, count_if(quality = 1 AND toxic = 0)::BIGINT AS c_new_excl, count_if(toxic = 1 AND quality = 0)::BIGINT AS c_old_excl
  FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT *, {_sql_metrics()} FROM m
""")
def pass_at_k_family(spark, folder):
    """Pass@k of sources: a labelled document is a program, quality passes with, toxic without."""
    rows = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    programs = rows.select("source", (F.col("quality") == 1).alias("all_w"), (F.col("toxic") == 1).alias("all_o"), F.col("quality").cast("double").alias("rate"), F.col("quality").alias("num_w"), F.col("toxic").alias("num_o"))
    return reports.problem_metrics(programs, ["source"]).drop("accuracy_mean", "accuracy_std", "unaffected_pct", "affected_pct", "unsolved_pct")


@query(f"""
WITH m AS (SELECT user_id, count(*) AS n, count_if(event_type <> 'error')::BIGINT AS c, count_if(value < 1)::BIGINT AS n_empty FROM events GROUP BY 1)
SELECT *, {", ".join(f"round({_sql_pass('n', 'c', k)}, 6) AS pass_{k}" for k in (1, 2, 5))} FROM m
""")
def completion_metrics(spark, folder):
    """Pass@k of tasks: users, events of type error fail."""
    e = table(spark, folder, "events").select("user_id", (F.col("event_type") != "error").alias("passed"), (F.col("value") < 1).alias("is_empty"))
    return reports.completion_metrics(e, "user_id")


@query("""
SELECT doc_id, '[' || source || '.' || lang || '.f]:[' || lang || '-x]:[update-' || (doc_id % 13) || ']:[prog_syn-' || doc_id || ']' AS id,
  source || '.' || lang || '.f' AS api_path, lang || '-x' AS tag, '[' || source || '.' || lang || '.f]:[' || lang || '-x]:[update-' || (doc_id % 13) || ']' AS parent,
  doc_id::INT AS ordinal, source AS package, source || '.' || lang AS parent_path, 'f' AS function_name FROM documents
""")
def id_roundtrip(spark, folder):
    """Build ids, take them apart."""
    api = F.concat("source", F.lit("."), "lang", F.lit(".f"))
    tail = [F.concat("lang", F.lit("-x")), F.concat(F.lit("update-"), (F.col("doc_id") % 13).cast("string")), F.concat(F.lit("prog_syn-"), F.col("doc_id").cast("string"))]
    rows = table(spark, folder, "documents").select("doc_id", ids.bracketed(api, *tail).alias("id"))
    parts = ids.decompose_id(F.col("id"))
    path = F.get(parts, F.lit(0))
    return rows.select("doc_id", "id", path.alias("api_path"), F.get(parts, F.lit(1)).alias("tag"), ids.parent_id(F.col("id")).alias("parent"), ids.ordinal(F.col("id")).alias("ordinal"), ids.package_of(path).alias("package"), ids.parent_path(path).alias("parent_path"), ids.function_name(path).alias("function_name"))


_RING = """
WITH r AS (SELECT source, doc_id, (row_number() OVER g - 1)::INT AS pos, list(doc_id) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS u FROM documents WINDOW g AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, pos, len(u) > {n} AS enough, CASE WHEN len(u) <= {n} THEN NULL WHEN pos >= {n} THEN array_to_string(u[pos - {n} + 1:pos], ',') ELSE array_to_string(list_concat(u[1:pos], u[len(u) - {n} + pos + 1:len(u)]), ',') END AS train FROM r
"""


def _ring(n):
    def run(spark, folder):
        rows = table(spark, folder, "documents").select("source", "doc_id", F.col("doc_id").alias("ordinal"))
        out = splits.circular_splits(rows, "source", "ordinal", "doc_id", n)
        return out.select("source", "doc_id", F.col("pos").cast("int").alias("pos"), "enough", F.array_join(F.col("train").cast("array<string>"), ",").alias("train"))

    return run


for _n in (1, 2, 5):
    QUERIES[f"circular_split_{_n}"], SQL[f"circular_split_{_n}"] = _ring(_n), _RING.format(n=_n)
QUERIES["zero_shot_split"] = _ring(0)
SQL["zero_shot_split"] = "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS pos, true AS enough, doc_id::VARCHAR AS train FROM documents"


@query("""
WITH f AS (SELECT c_nationkey, min(c_custkey) AS train FROM customer GROUP BY 1)
SELECT c.c_nationkey, c.c_custkey, (c.c_nationkey * 7 + 3) % 25 AS partner, f.train FROM customer c JOIN f ON f.c_nationkey = (c.c_nationkey * 7 + 3) % 25
""")
def random_partner_first(spark, folder):
    """Each customer with the first customer of its nation's partner nation."""
    rows = table(spark, folder, "customer").select("c_nationkey", "c_custkey", F.col("c_custkey").alias("ordinal"))
    partners = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("partner"))
    return splits.partner_first(rows, partners, "c_nationkey", "ordinal", "c_custkey")


@query("""
WITH s AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INT AS pos, c_custkey AS o_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT pos, o_custkey, min(o_orderkey) AS o_orderkey FROM orders JOIN s USING (o_custkey) WHERE pos < 25 GROUP BY ALL
""")
def sampled_first(spark, folder):
    """The first order of each of the first 25 sampled customers; the sample is a list of a segment's customers."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("ordinal"))
    customers = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return splits.sampled_first(rows, splits.first_of_list(customers, "o_custkey", 25), "o_custkey", "ordinal", "o_orderkey", 25)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def sampled_semi(spark, folder):
    """Only sampled tasks: orders whose customer is in a list."""
    picked = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").join(picked, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


_TYPES = """
types AS (
  SELECT action, place, aspect, action || '-' || place || CASE WHEN aspect <> '' THEN '-' || replace(aspect, ' ', '_') ELSE '' END AS tag,
    NOT (CASE WHEN action = 'deprecate' THEN false WHEN place = 'output' THEN aspect IN ('semantics', 'data type')
      WHEN action = 'modify' AND place = 'function' THEN aspect IN ('semantics', 'name') WHEN action = 'modify' THEN aspect <> ''
      WHEN place = 'function' THEN aspect = '' ELSE aspect <> 'name' END) AS is_banned
  FROM (VALUES ('modify'), ('add'), ('deprecate')) a(action), (VALUES ('function'), ('argument'), ('output')) p(place), (VALUES (''), ('name'), ('data type'), ('supported value'), ('default value'), ('semantics')) x(aspect)
)"""


@query(f"WITH {_TYPES} SELECT * FROM types")
def taxonomy_dim(spark, folder):
    return taxonomy.dimension(spark).select("action", "place", "aspect", "tag", "is_banned")


@query(f"WITH {_TYPES} SELECT count(*) AS total, count_if(NOT is_banned)::BIGINT AS legal FROM types")
def taxonomy_counts(spark, folder):
    return taxonomy.dimension(spark).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_banned")).alias("legal"))


@query(f"""
WITH {_TYPES}, n AS (SELECT * FROM types, (VALUES ('f', 'f'), ('f', 'g')) v(o, n))
SELECT tag, o AS old_name, n AS new_name,
  CASE WHEN place IN ('argument', 'output') OR (action = 'add' AND aspect = 'semantics') THEN CASE WHEN o = n THEN 'm.p.f = ' || n END
    WHEN action = 'deprecate' AND aspect = '' THEN CASE WHEN o = n THEN 'del m.p.f' END
    WHEN action = 'modify' AND aspect = 'name' THEN CASE WHEN o <> n THEN 'del m.p.' || o || chr(10) || 'setattr(m.p, ''' || n || ''', ' || n || ')' END
    WHEN action = 'add' AND aspect = '' THEN CASE WHEN o <> n THEN 'setattr(m.p, ''' || n || ''', ' || n || ')' END END AS statements,
  CASE WHEN place IN ('argument', 'output') OR (action = 'add' AND aspect = 'semantics') THEN o = n WHEN action = 'deprecate' AND aspect = '' THEN o = n
    WHEN (action = 'modify' AND aspect = 'name') OR (action = 'add' AND aspect = '') THEN o <> n ELSE false END AS ok
FROM n
""")
def enforcement_rule(spark, folder):
    """The statements of every type, for kept and for changed names."""
    names = constant_rows(spark, [("f", "f"), ("f", "g")], "old_name string, new_name string")
    rows = taxonomy.dimension(spark).crossJoin(names)  # 54 x 2 constants
    e = taxonomy.enforcement(F.col("action"), F.col("place"), F.col("aspect"), F.lit("m.p.f"), F.lit("m.p"), F.col("old_name"), F.col("new_name"))
    return rows.select("tag", "old_name", "new_name", e["statements"].alias("statements"), e["ok"].alias("ok"))


@query(f"WITH {_TYPES} SELECT tag, action, place, aspect FROM types UNION ALL SELECT * FROM (VALUES ('modify', NULL, NULL, NULL), ('add-x-name', NULL, NULL, NULL), ('a-b-c-d', NULL, NULL, NULL)) b(tag, action, place, aspect)")
def tag_parse(spark, folder):
    """Every tag read back, and three that can't be."""
    tags = taxonomy.dimension(spark).select("tag").unionByName(constant_rows(spark, [("modify",), ("add-x-name",), ("a-b-c-d",)], "tag string"))
    t = taxonomy.from_tag(F.col("tag"))
    return tags.select("tag", t["action"].alias("action"), t["place"].alias("place"), t["aspect"].alias("aspect"))


_WRAP = """
w AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'a [PYTHON]' || text || '[/PYTHON] b [PYTHON]no[/PYTHON]' WHEN 1 THEN 'a ```python' || chr(10) || text || '```' WHEN 2 THEN text WHEN 3 THEN '[PYTHON][/PYTHON]```' || text || '```' ELSE '```' || text || '``` and [PYTHON]x' || text || '[/PYTHON]' END AS t FROM conversations)"""


def _wrapped(spark, folder):
    c = table(spark, folder, "conversations")
    x, t = F.col("text"), F.col("turn") % 5
    wrapped = (
        F.when(t == 0, F.concat(F.lit("a [PYTHON]"), x, F.lit("[/PYTHON] b [PYTHON]no[/PYTHON]")))
        .when(t == 1, F.concat(F.lit("a ```python\n"), x, F.lit("```")))
        .when(t == 2, x)
        .when(t == 3, F.concat(F.lit("[PYTHON][/PYTHON]```"), x, F.lit("```")))
        .otherwise(F.concat(F.lit("```"), x, F.lit("``` and [PYTHON]x"), x, F.lit("[/PYTHON]")))
    )
    return c.select("conv_id", "turn", wrapped.alias("t"))


@query(rf"WITH {_WRAP} SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?s)\[PYTHON\](.*?)\[/PYTHON\]') THEN regexp_extract(t, '(?s)\[PYTHON\](.*?)\[/PYTHON\]', 1) ELSE regexp_extract(t, '(?s)```(?:python)?\s*(.*?)```', 1) END AS code FROM w")
def extract_solution(spark, folder):
    """Programs from texts wrapped in tags, fences, both, neither, or an empty tag."""
    return _wrapped(spark, folder).select("conv_id", "turn", text.solution(F.col("t")).alias("code"))


@query(r"""
WITH w AS (SELECT conv_id, turn, 'x ```python' || chr(10) || text || '``` y ```JSON {"a": 1} ``` z' AS t FROM conversations)
SELECT conv_id, turn, array_to_string(regexp_extract_all(t, '(?is)```(?:python)?\s*(.*?)```', 1), '|') AS blocks, array_to_string(regexp_extract_all(t, '(?is)```(?:json)?\s*([\s\S]*?)\s*```', 1), '|') AS json FROM w
""")
def fenced_blocks(spark, folder):
    """All fenced blocks, as code and as JSON."""
    t = F.concat(F.lit("x ```python\n"), "text", F.lit('``` y ```JSON {"a": 1} ``` z'))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", F.array_join(text.code_blocks(F.col("t")), "|").alias("blocks"), F.array_join(text.json_blocks(F.col("t")), "|").alias("json"))


@query("""
WITH d AS (SELECT item_id, translate(text, '`' || chr(10), ' ') AS t FROM benchmark)
SELECT item_id, 'def test_' || item_id || '():' || chr(10) || '    x = 1' || chr(10) || '    ' || replace(t || chr(10) || '  ' || t || chr(10), chr(10), chr(10) || '    ') || chr(10) || '    assert x' AS filled,
  'def test_' || item_id || '():' || chr(10) || '    [INFILL]' AS cut FROM d
""")
def infill_and_dedent(spark, folder):
    """A fenced answer put into a skeleton, its indent taken away; and a skeleton cut at its placeholder."""
    rows = table(spark, folder, "benchmark").select("item_id", F.translate("text", "`\n", " ").alias("t"))
    answer = F.concat(F.lit("see ```python\n  "), "t", F.lit("\n    "), "t", F.lit("\n```"))
    head = F.concat(F.lit("def test_"), F.col("item_id").cast("string"), F.lit("():\n"))
    skeleton = F.concat(head, F.lit("    x = 1\n    # @ANSWER@\n    assert x"))
    cut = F.concat(head, F.lit("    # @ASSERT@ later"))
    return rows.select("item_id", text.filled(skeleton, "# @ANSWER@", text.infill(answer)).alias("filled"), text.cut_skeleton(cut, ("# @ANSWER@", "# @ASSERT@")).alias("cut"))


_DEMO = {"example_scenario": "a shop", "example_problem": "add two", "example_solution_signature": "def f(a, b)", "example_unit_tests": "assert f(1, 2) == 3", "example_solution": "def f(a, b): return a + b"}


def _sql_prompt(kind: str, update: bool, solved: bool, fields: dict[str, str]) -> str:
    import re

    t = templates.PROMPTS[kind]
    t = re.sub(r"\{% if include_update -%\}\n(.*?)\{% endif %\}\n", lambda m: m[1] if update else "", t, flags=re.S)
    t = re.sub(r"\{% if solution_code %\}\n(.*?)\n\{%- endif %\}", lambda m: m[1] if solved else "", t, flags=re.S)
    parts = re.split(r"\{\{(\w+)\}\}", t)
    return " || ".join(fields[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p or i % 2)


_FIELDS = {k: f"'{v}'" for k, v in _DEMO.items()} | {"scenario": "role", "problem": "text", "solution_signature": "'def g()'", "unit_tests": "'# Unit Test 0' || chr(10) || text || chr(10) || chr(10) || '# Unit Test 1' || chr(10) || role", "old_function_signature": "'m.f(a):'", "update_description": "role", "new_function_signature": "'m.f(a, b):'", "update_docstring": "text", "solution_code": "text"}


@query(f"SELECT conv_id, turn, {_sql_prompt('base_one_shot', False, False, _FIELDS)} AS base, CASE WHEN turn % 2 = 0 THEN {_sql_prompt('tune_examples', True, True, _FIELDS)} ELSE {_sql_prompt('tune_examples', False, False, _FIELDS)} END AS tune, {_sql_prompt('tune_update_only', True, False, _FIELDS)} AS only_update FROM conversations")
def prompt_render(spark, folder):
    """Prompts with and without updates and solutions; texts stand in for problems."""
    rows = table(spark, folder, "conversations")
    even = F.col("turn") % 2 == 0
    fields = {k: F.lit(v) for k, v in _DEMO.items()} | {
        "scenario": F.col("role"), "problem": F.col("text"), "solution_signature": F.lit("def g()"), "unit_tests": text.numbered_tests(F.array("text", "role", F.lit("no")), 2),
        "include_update": even, "old_function_signature": text.signature(F.lit("m.f"), F.lit("a"), F.lit("")), "update_description": F.col("role"),
        "new_function_signature": text.signature(F.lit("m.f"), F.lit("a, b"), F.lit("")), "update_docstring": F.col("text"), "solution_code": F.when(even, F.col("text")).otherwise(F.lit("")),
    }
    made = {k: templates.render(templates.PROMPTS[p], fields, frozenset({"solution_code"})) for k, p in (("base", "base_one_shot"), ("tune", "tune_examples"), ("only_update", "tune_update_only"))}
    return rows.select("conv_id", "turn", *[c.alias(k) for k, c in made.items()])


@query("""
WITH r AS (SELECT p_partkey, unnest(['import ' || p_brand, 'import ' || p_type || '.' || p_brand, 'x = ' || p_brand, 'setattr(m, ' || p_brand || ')', 'import ' || p_brand, 'import old_' || p_brand]) AS x FROM part),
d AS (SELECT DISTINCT * FROM r WHERE NOT contains(x, 'old_')),
k AS (SELECT *, CASE WHEN contains(x, '=') THEN 2 * max(length(x)) OVER (PARTITION BY p_partkey) WHEN contains(x, 'setattr(') THEN 3 * max(length(x)) OVER (PARTITION BY p_partkey) ELSE length(x) END AS k FROM d)
SELECT p_partkey, string_agg(x, chr(10) ORDER BY k, x) AS imports FROM k GROUP BY 1
""")
def imports_sort(spark, folder):
    """Import lists deduplicated, freed of aliases and sorted."""
    b = F.col("p_brand")
    lines = F.array(F.concat(F.lit("import "), b), F.concat(F.lit("import "), "p_type", F.lit("."), b), F.concat(F.lit("x = "), b), F.concat(F.lit("setattr(m, "), b, F.lit(")")), F.concat(F.lit("import "), b), F.concat(F.lit("import old_"), b))
    rows = table(spark, folder, "part").select("p_partkey", lines.alias("x"))
    return rows.select("p_partkey", F.array_join(text.sorted_imports(text.without_old_aliases(F.col("x"))), "\n").alias("imports"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS name, CASE event_id % 4 WHEN 0 THEN 'a,' || event_type WHEN 1 THEN 'b' END AS items FROM events
""")
def json_repair(spark, folder):
    """Objects and lists bare, fenced, of wrong kinds, and broken."""
    e, t = F.col("event_type"), F.col("event_id") % 4
    fence = lambda body: F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```"))
    obj, lst = F.concat(F.lit('{"name": "'), e, F.lit('", "l": [1]}')), F.concat(F.lit('["a", "'), e, F.lit('"]'))
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(t == 0, obj).when(t == 1, fence(obj)).when(t == 2, F.lit('{"name": 1, "l": []}')).otherwise(F.lit('{"name": ')).alias("d"),
        F.when(t == 0, lst).when(t == 1, fence(F.lit('["b"]'))).when(t == 2, F.lit('{"a": 1}')).otherwise(F.lit("[1, 2]")).alias("l"),
    )
    return rows.select("event_id", text.string_dict(F.col("d"), ("name",), ("l",))["name"].alias("name"), F.array_join(text.string_list(F.col("l")), ",").alias("items"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80)")
def ledger_missing(spark, folder):
    """Users without a large purchase: work that is not done."""
    e = table(spark, folder, "events")
    return ledger.missing(e.select("user_id").distinct(), e.where("event_type = 'purchase' and value > 80"), ["user_id"])


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100 INTERSECT SELECT user_id FROM events WHERE event_type = 'click' AND value > 100)")
def ledger_incomplete(spark, folder):
    """Users that lack a large purchase or a large click: one of two artefacts."""
    e = table(spark, folder, "events")
    return ledger.incomplete(e.select("user_id").distinct(), [e.where("event_type = 'purchase' and value > 100"), e.where("event_type = 'click' and value > 100")], ["user_id"])


@query("SELECT user_id, max(CASE WHEN event_type = 'purchase' AND value > 80 THEN 1 ELSE 0 END)::INT AS old FROM events GROUP BY 1")
def ledger_merge(spark, folder):
    """The ledger of purchasers with the other users added."""
    e = table(spark, folder, "events")
    done = e.where("event_type = 'purchase' and value > 80").select("user_id", F.lit(1).alias("old")).distinct()
    return ledger.merged(done, e.select("user_id", F.lit(0).alias("old")), ["user_id"])


_ATTEMPTS = """
a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS attempt, * EXCLUDE (l_orderkey) FROM lineitem)"""


def _attempts(spark, folder):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, folder, "lineitem").withColumn("attempt", F.row_number().over(order) - 1)


@query(f"""
WITH {_ATTEMPTS}, g AS (SELECT l_orderkey, min(attempt) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS chosen, count(*) AS made FROM a WHERE attempt < 3 GROUP BY 1),
u AS (SELECT *, coalesce(chosen + 1, made) AS used, coalesce(chosen + 1, made) - (chosen IS NOT NULL)::INT AS failed FROM g)
SELECT l_orderkey, chosen::INT AS chosen, used::INT AS num_attempts, round(1 - failed / 3.0::DOUBLE, 9) AS yield_rate, '1 - ' || failed || ' / 3' AS yield_text FROM u
""")
def rejection_stats(spark, folder):
    """Orders' lines as attempts, at most three."""
    rows = _attempts(spark, folder).select("l_orderkey", "attempt", ((F.col("l_returnflag") != "R") & (F.col("l_linestatus") == "O")).alias("ok"))
    return selection.rejection_stats(rows, ["l_orderkey"], 3).withColumn("yield_rate", F.round("yield_rate", 9))


@query(f"""
WITH {_ATTEMPTS}
SELECT l_orderkey, (min(attempt) FILTER (1 - 5 * l_discount >= 0.699999 AND l_returnflag = 'A'))::INT AS attempt, round(arg_min(1 - 5 * l_discount, attempt) FILTER (1 - 5 * l_discount >= 0.699999 AND l_returnflag = 'A'), 6) AS rate FROM a GROUP BY 1
""")
def best_of_attempts(spark, folder):
    """The first line of each order with rate 1 - 5 x discount of 0.7 or more and flag A."""
    rows = _attempts(spark, folder).select("l_orderkey", "attempt", (1 - 5 * F.col("l_discount")).alias("rate"), (F.col("l_returnflag") == "A").cast("int").alias("exclusive"))
    out = selection.best_of_attempts(rows, ["l_orderkey"], 0.699999)
    return out.withColumn("rate", F.round("rate", 6))


@query(r"""
WITH d AS (SELECT item_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n FROM benchmark)
SELECT a.item_id AS id_a, z.item_id AS id_b, a.n::INT AS n_a, z.n::INT AS n_b FROM d a JOIN d z ON a.item_id < z.item_id
""")
def near_dup_blocks(spark, folder):
    """Which pairs of benchmark items are scored, and how long their token lists are."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = table(spark, folder, "benchmark").select("item_id", words.alias("w"))
    pairs = neardup.scored_pairs(rows, "item_id", "w")
    sizes = rows.select("item_id", F.size("w").alias("n"))
    return pairs.join(sizes.selectExpr("item_id id_a", "n n_a"), "id_a").join(sizes.selectExpr("item_id id_b", "n n_b"), "id_b").select("id_a", "id_b", "n_a", "n_b")


@query(r"""
WITH a AS (SELECT item_id, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS t FROM benchmark)
SELECT x.item_id AS id_a, y.item_id AS id_b, levenshtein(x.t, y.t)::INT AS distance FROM a x JOIN a y ON x.item_id < y.item_id
""")
def near_dup_pairs(spark, folder):
    """Edit distances of all pairs of benchmark items, each letter of the whole text a token."""
    letters = F.regexp_extract_all(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), F.lit("[a-z]"), F.lit(0))
    rows = table(spark, folder, "benchmark").select("item_id", letters.alias("t"))
    return neardup.scored_pairs(rows, "item_id", "t")


@query("""
WITH d AS (SELECT DISTINCT p_name || ' ' || p_brand AS t FROM part)
SELECT a.t AS id_a, b.t AS id_b, levenshtein(a.t, b.t)::INT AS distance FROM d a JOIN d b ON a.t < b.t AND levenshtein(a.t, b.t) <= 2
""")
def near_dup_within(spark, folder):
    """Pairs of different part names with brands that at most two edits of characters separate."""
    name = F.concat("p_name", F.lit(" "), "p_brand")
    rows = table(spark, folder, "part").select(name.alias("t")).distinct().select("t", F.filter(F.split("t", ""), lambda x: x != "").alias("w"))
    return neardup.pairs_within(rows, "t", "w", 2)


_GENERAL = {"ECONOMY": [["compare numbers with a margin", "never with =="]], "PROMO": [["return lists"], ["sort them"]]}
_SPECIFIC = {"Brand#11": [["keep keys", "as strings"]], "Brand#22": [["no nulls"]]}


@query("""
SELECT p_partkey, CASE substring(p_type, 1, instr(p_type || ' ', ' ') - 1)
  WHEN 'ECONOMY' THEN '1: compare numbers with a margin' || chr(10) || '1.1: never with ==' || CASE p_brand WHEN 'Brand#11' THEN chr(10) || '2: keep keys' || chr(10) || '2.1: as strings' WHEN 'Brand#22' THEN chr(10) || '2: no nulls' ELSE '' END
  WHEN 'PROMO' THEN '1: return lists' || chr(10) || '2: sort them' || CASE p_brand WHEN 'Brand#11' THEN chr(10) || '3: keep keys' || chr(10) || '3.1: as strings' WHEN 'Brand#22' THEN chr(10) || '3: no nulls' ELSE '' END END AS instruction FROM part
""")
def instruction_lookup(spark, folder):
    """Part types as packages, brands as APIs."""
    general = constant_rows(spark, list(_GENERAL.items()), "package string, entries array<array<string>>")
    specific = constant_rows(spark, list(_SPECIFIC.items()), "api_path string, entries array<array<string>>")
    rows = table(spark, folder, "part").select("p_partkey", F.substring_index("p_type", " ", 1).alias("package"), F.col("p_brand").alias("api_path"))
    return instructions.instruction_lookup(rows, general, specific).select("p_partkey", "instruction")


@query("""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10))[1:3], lambda x, i: '# Unit Test ' || (i - 1) || chr(10) || x), chr(10) || chr(10)) AS public_tests FROM documents
""")
def public_tests(spark, folder):
    """The first three lines of each document as numbered tests."""
    return table(spark, folder, "documents").select("doc_id", text.numbered_tests(F.split("text", "\n"), 3).alias("public_tests"))


@query(r"SELECT conv_id, turn, (8191 - 11 - len(regexp_extract_all(role, '\S+')) - len(regexp_extract_all(text, '\S+')))::INT AS budget FROM conversations")
def token_budget(spark, folder):
    """What prompts leave of the context, in blank-separated tokens."""
    n = lambda c: F.regexp_count(c, F.lit(r"\S+"))
    return table(spark, folder, "conversations").select("conv_id", "turn", text.token_budget(n("role"), n("text")).alias("budget"))


@query("""
SELECT source, lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source, lang)
""")
def rollup_by_package(spark, folder):
    """An extension: means by source and language, with totals."""
    rows = table(spark, folder, "documents").select("doc_id", "source", "lang").join(table(spark, folder, "labels"), "doc_id")
    return reports.rollup_by(rows, ["source", "lang"], ["quality", "toxic"])


@query("""
SELECT doc_id, '########## Start: Import statement(s) ##########' || chr(10) || 'import ' || lang || chr(10) || '##########  End : Import statement(s) ##########' || chr(10) ||
  '########## Start: Updated API implementation ##########' || chr(10) || 'def g(): pass' || chr(10) || '##########  End : Updated API implementation ##########' || chr(10) || 'm.f = g' || chr(10) || text || chr(10) || 'def test_a(): pass' || chr(10) || 'test_a()' AS with_update,
  length('########## Start: Import statement(s) ##########' || chr(10) || 'import ' || lang || chr(10) || '##########  End : Import statement(s) ##########' || chr(10) ||
  '########## Start: Updated API implementation ##########' || chr(10) || 'def g(): pass' || chr(10) || '##########  End : Updated API implementation ##########' || chr(10) || text || chr(10) || 'def test_a(): pass' || chr(10) || 'test_a()')::INT AS n_without,
  '    ' || replace(text, chr(10), chr(10) || '    ') AS indented FROM documents
""")
def program_assembly(spark, folder):
    """Programs with and without an update; texts stand in for solutions."""
    parts = (F.array(F.concat(F.lit("import "), "lang")), F.lit("def g(): pass"), F.lit("m.f = g"), F.col("text"), F.lit("def test_a(): pass"), F.lit("test_a"))
    return table(spark, folder, "documents").select("doc_id", text.program(*parts).alias("with_update"), F.length(text.program(*parts, with_update=False)).alias("n_without"), text.indented(F.col("text")).alias("indented"))
