"""More registered queries: text operators over the driver's tables, code operators over small programs of our own.

What code operators should give can't be computed by SQL: their SQL states it,
row by row.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quernstone.functions import literals, templates, text
from quernstone.operators import codecheck, execution, instructions, neardup, reports, selection, splits, taxonomy
from quernstone.plans import testbeds
from quernstone.plans.queries import _FIELDS, _WRAP, QUERIES, SQL, _sql_metrics, _sql_prompt, _wrapped, query, table
from quernstone.sources import arena
from quernstone.sources.constants import constant_rows

__all__ = ["QUERIES", "SQL"]


def _values(columns: str, rows: list[tuple]) -> str:
    def one(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (int, float)):
            return str(x)
        return "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


# -- text operators over the tables -----------------------------------------------------


@query("""
WITH r AS (SELECT p_partkey, unnest(['import ' || p_brand, 'x = ' || p_brand, 'setattr(m, ' || p_brand || ')', 'import ' || p_brand]) AS x FROM part), d AS (SELECT DISTINCT * FROM r),
k AS (SELECT *, CASE WHEN contains(x, '=') THEN 2 * max(length(x)) OVER (PARTITION BY p_partkey) ELSE length(x) END AS k FROM d)
SELECT p_partkey, string_agg(x, chr(10) ORDER BY k, x) AS imports FROM k GROUP BY 1
""")
def imports_sort_plain(spark, folder):
    """Import lists deduplicated and sorted, ``setattr`` lines by length like the others."""
    b = F.col("p_brand")
    lines = F.array(F.concat(F.lit("import "), b), F.concat(F.lit("x = "), b), F.concat(F.lit("setattr(m, "), b, F.lit(")")), F.concat(F.lit("import "), b))
    return table(spark, folder, "part").select("p_partkey", F.array_join(text.sorted_imports(lines, setattr_last=False), "\n").alias("imports"))


@query("""
SELECT conv_id, turn, '# Unit Test 1' || chr(10) || role || chr(10) || chr(10) || '# Unit Test 2' || chr(10) || text AS tests, trim('1. ' || role || chr(10) || '2. ' || text, ' ' || chr(9) || chr(10) || chr(13)) AS listed,
  trim('* ' || role || chr(10) || '* ' || text, ' ' || chr(9) || chr(10) || chr(13)) AS starred, '0: ' || role || chr(10) || '1: ' || text AS errors FROM conversations
""")
def numbered_texts(spark, folder):
    """Tests numbered from 1, lists numbered and starred, an error log."""
    both = F.array("role", "text")
    made = {"tests": text.numbered_tests(both, start=1), "listed": text.listed(both), "starred": text.listed(both, False), "errors": text.error_log(both)}
    return table(spark, folder, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in made.items()])


_PROMPTS = {"update_one_shot": "told", "tune_examples_no_update": "plain", "tune_update_eval": "asked", "completion": "completed"}
_MORE = _FIELDS | {"completion_context": "text"}


@query(f"SELECT conv_id, turn, {', '.join(_sql_prompt(k, True, True, _MORE) + ' AS ' + a for k, a in _PROMPTS.items())} FROM conversations")
def prompt_kinds(spark, folder):
    """The other kinds of prompts, updates and solutions included."""
    fixed = {k: F.lit(v.strip("'")) for k, v in _FIELDS.items() if v.startswith("'") and "||" not in v}
    fields = fixed | {
        "scenario": F.col("role"), "problem": F.col("text"), "unit_tests": text.numbered_tests(F.array("text", "role")), "include_update": F.lit(True), "update_description": F.col("role"),
        "update_docstring": F.col("text"), "solution_code": F.col("text"), "completion_context": F.col("text"),
    }
    made = [templates.render(templates.PROMPTS[k], fields, frozenset({"solution_code"})).alias(a) for k, a in _PROMPTS.items()]
    return table(spark, folder, "conversations").select("conv_id", "turn", *made)


_STAGE_NAMES = sorted({f for t in templates.STAGE_PROMPTS.values() for f in re.findall(r"\{\{(\w+)\}\}", t)})


def _sql_stage(template: str) -> str:
    template = re.sub(r"\{% if instruction -%\}\n(.*?)\{% endif %\}\n", r"\1", template, flags=re.S)
    parts = re.split(r"\{\{(\w+)\}\}", template)
    return " || ".join((f"'<{p}>' || item_id" if i % 2 else "'" + p.replace("'", "''") + "'") for i, p in enumerate(parts) if p or i % 2)


@query(" UNION ALL ".join(f"SELECT item_id, '{k}' AS stage, {_sql_stage(t)} AS prompt FROM benchmark" for k, t in templates.STAGE_PROMPTS.items()))
def stage_prompts(spark, folder):
    """The prompts record of all stages: a row for each item and stage."""
    fields = {f: F.concat(F.lit(f"<{f}>"), F.col("item_id").cast("string")) for f in _STAGE_NAMES}
    made = [F.struct(F.lit(k).alias("stage"), templates.render(t, fields, frozenset({"instruction"})).alias("prompt")) for k, t in templates.STAGE_PROMPTS.items()]
    return table(spark, folder, "benchmark").select("item_id", F.explode(F.array(*made)).alias("x")).select("item_id", "x.*")


@query("""
SELECT doc_id, lang || ' = 1' || chr(10) || 'import late' || chr(10) || 'def f(): pass' AS code, 'a  c' AS echoless, 'old_' || lang || '(x) and old_' || lang AS renamed, 'old_' || lang || '(a, b):' AS old_signature,
  'import ' || source || chr(10) || 'import ' || source || '.' || lang AS imports, 'import a' AS trimmed, 2 AS marks FROM documents
""")
def code_texts(spark, folder):
    """Leading imports and echoes removed, old names, imports of a path, blank imports, placeholders counted."""
    lang, src = F.col("lang"), F.col("source")
    path = F.concat_ws(".", src, lang, F.lit("f"))
    code = F.concat(F.lit("import a\nfrom b import c\n"), lang, F.lit(" = 1\nimport late\ndef f(): pass"))
    old = F.concat(F.lit("old_"), src, F.lit("."), lang, F.lit("(x) and old_"), src, F.lit("."), lang)
    made = {
        "code": text.without_leading_imports(code),
        "echoless": text.without_echo(F.concat(F.lit("a "), lang, F.lit(" c")), lang),
        "renamed": text.old_name(old, F.concat(src, F.lit("."), lang), lang),
        "old_signature": text.old_signature(F.concat(src, F.lit("."), lang, F.lit("(a, b):")), src),
        "imports": F.array_join(text.imports_of_path(path), "\n"),
        "trimmed": F.array_join(text.trimmed_imports(F.array(F.lit("  import a\n"), F.lit(" "), F.lit(""))), "|"),
        "marks": text.placeholder_count(F.concat(F.lit("@M@ "), lang, F.lit(" @M@")), "@M@"),
    }
    return table(spark, folder, "documents").select("doc_id", *[c.alias(k) for k, c in made.items()])


@query("""
SELECT conv_id, turn, 'import ' || role AS imports, 'import ' || role || chr(10) || 'code' || chr(10) || 'def check(candidate): pass' || chr(10) || 'check(candidate=go)' AS program, NULL::VARCHAR AS missing,
  'i' || chr(10) || role || chr(10) || 'e' || chr(10) || 't' || chr(10) || 'c' AS update_order, 'i' || chr(10) || role || chr(10) || 's' || chr(10) || 'e' || chr(10) || 't' || chr(10) || 'c' AS problem_order, 'i' || chr(10) || role || chr(10) || 'e' || chr(10) || 's' || chr(10) || 't' || chr(10) || 'c' AS evaluate_order FROM conversations
""")
def completion_assembly(spark, folder):
    """Programs of completion tasks, and the orders in which programs are put together."""
    prompt = F.concat(F.lit("\nimport "), "role", F.lit("\n\ndef go(x):\n    "), "role")
    imports = text.completion_imports(prompt, F.lit("go"))
    parts = {"imports": F.lit("i"), "implementation": F.col("role"), "enforcement": F.lit("e"), "solution": F.lit("s"), "test": F.lit("t"), "call": F.lit("c")}
    made = {"imports": imports, "program": text.completion_program(imports, F.lit("code"), F.lit("def check(candidate): pass"), F.lit("go")), "missing": text.completion_imports(prompt, F.lit("stop"))}
    made |= {f"{k}_order": text.assembled(k, **{p: parts[p] for p in text.PROGRAM_ORDERS[k]}) for k in text.PROGRAM_ORDERS}
    return table(spark, folder, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in made.items()])


@query("SELECT conv_id, turn, least(7, length(text))::INT AS at, least(4, turn + 1)::INT AS per_round, ceil(10.0 / least(4, turn + 1))::INT AS rounds, floor(100.0 / (turn + 1))::INT AS epochs, least(8, turn + 1)::INT AS batch FROM conversations")
def index_and_rounds(spark, folder):
    """Character indexes of byte indexes, rounds of decoding and epochs of training."""
    n = (F.col("turn") + 1).cast("int")
    rounds, epochs = text.decoding_rounds(F.lit(10), F.least(F.lit(4), n)), text.train_epochs(F.lit(100), n, F.lit(8))
    at = text.char_index(F.col("text"), F.octet_length(F.left("text", F.lit(7))))
    return table(spark, folder, "conversations").select("conv_id", "turn", at.alias("at"), rounds["per_round"].cast("int").alias("per_round"), rounds["rounds"].alias("rounds"), epochs["epochs"].alias("epochs"), epochs["batch"].cast("int").alias("batch"))


@query("""
SELECT l_orderkey, count(*) AS num_tests, count_if(l_returnflag <> 'R' AND l_linestatus <> 'O')::BIGINT AS num_excl, count_if(l_returnflag <> 'R' AND l_linestatus = 'O')::BIGINT AS num_incl, count(*) = 4 AS finished,
  CASE WHEN count(*) = 4 THEN round(count_if(l_returnflag <> 'R') / 4.0::DOUBLE, 6) END AS rate,
  'tests: ' || count(*) || chr(10) || 'pass with update: ' || count_if(l_returnflag <> 'R') || ' of ' || count(*) || chr(10) || 'pass without update: ' || count_if(l_linestatus = 'O') || ' of ' || count(*) || chr(10) || 'pass only with update: ' || count_if(l_returnflag <> 'R' AND l_linestatus <> 'O') || ' of ' || count(*) || chr(10) ||
  'pass both ways: ' || count_if(l_returnflag <> 'R' AND l_linestatus = 'O') || ' of ' || count(*) || chr(10) || 'pass rate: ' || CASE WHEN count(*) = 4 THEN ['0.0', '25.0', '50.0', '75.0', '100.0'][count_if(l_returnflag <> 'R')::INT + 1] ELSE '0.0' END || ' %' || chr(10) || '0: late' AS report
FROM lineitem GROUP BY 1
""")
def test_counts(spark, folder):
    """Tests that pass only with, or both ways; whether all four outcomes are there; the report for readers."""
    tests = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("w"), (F.col("l_linestatus") == "O").alias("o"), F.lit(4).alias("expected"))
    rows = reports.program_reports(tests, ["l_orderkey"], F.col("expected"))
    report = text.report_text(F.struct("num_tests", "num_w", "num_o", "num_excl", "num_incl", "rate", F.array(F.lit("late")).alias("errors")))
    return rows.select("l_orderkey", "num_tests", "num_excl", "num_incl", "finished", F.round("rate", 6).alias("rate"), report.alias("report"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, min(CASE WHEN value > 100 THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events)
SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (stop IS NULL OR event_id < stop), '') AS passed, max(event_type) FILTER (event_id = stop) AS failed FROM e GROUP BY 1
""")
def folded_checks(spark, folder):
    """A user's events as checks in order, up to the first that fails with a value above 100."""
    e = table(spark, folder, "events").select("user_id", "event_id", F.col("event_type").alias("name"), (F.col("value") <= 100).alias("ok"), F.lit("").alias("message"))
    out = selection.checks_folded(e, ["user_id"], "event_id")
    return out.select("user_id", F.array_join("passed", ",").alias("passed"), "failed")


@query("SELECT DISTINCT o_custkey FROM orders ORDER BY md5('7:' || o_custkey), o_custkey LIMIT 25")
def seeded_sample(spark, folder):
    """25 customers with orders, in an order that a seed fixes."""
    return splits.random_groups(table(spark, folder, "orders"), "o_custkey", 25, 7)


@query("SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def missing_groups(spark, folder):
    """Customers of the list without any large order."""
    return splits.missing_groups(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey")), table(spark, folder, "orders").where("o_totalprice > 300000"), "o_custkey")


@query("""
SELECT p_partkey, 'm' || (p_size % 3) AS package, 'm' || (p_size % 3) || '.' || p_brand AS api_path, 'm' || (p_size % 3) || '.' || p_brand || '(x)' || CASE WHEN p_size % 2 = 0 THEN ' -> int' ELSE '' END || ':' AS old_signature, 2 AS update_tests, 'import a|import b' AS imports, 'p' || p_partkey AS first_test, '' AS broken FROM part
""")
def arena_rows(spark, folder):
    """Records normalised, joined to the metadata of their functions and validated."""
    part = table(spark, folder, "part")
    path = F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string"), F.lit("."), "p_brand")
    uid = F.concat(F.lit("["), path, F.lit("]:[add-function]:[update-"), F.col("p_partkey").cast("string"), F.lit("]"))
    fields = [f.name for f in arena.UPDATE.fields]
    update = {"function_path": path, "unit_tests": F.lit("a\n\nb"), "imports": F.lit("import m"), "update_id": uid}
    rows = part.select(
        "p_partkey", F.struct(*[update.get(f, F.lit(None).cast("string")).alias(f) for f in fields]).alias("update"), uid.alias("update_id"), F.lit("s").alias("scenario"), F.lit("p").alias("problem"), F.lit("g").alias("solution_signature"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("\n\nq")).alias("unit_tests"), F.lit(None).cast("string").alias("imports"), F.lit("import a\nimport b").alias("prog_syn_imports"), F.lit("r").alias("ref_solution"), F.concat(uid, F.lit(":[prog_syn-"), F.col("p_partkey").cast("string"), F.lit("]")).alias("prog_syn_id"),
    )
    apis = part.select(path.alias("api_path"), F.lit("x").alias("arguments_str"), F.when(F.col("p_size") % 2 == 0, F.lit(" -> int")).otherwise("").alias("return_type_hint"), (F.col("p_size") % 2).alias("odd"), "p_size")
    # a function has one row of metadata: of each path and parity one
    odd = (F.col("p_size") % 2).alias("odd")
    out = None
    for k in (0, 1):
        own = rows.join(part.select("p_partkey", odd).where(f"odd = {k}"), "p_partkey").drop("odd")
        one = arena.normalized(own, apis.where(f"odd = {k}").select("api_path", "arguments_str", "return_type_hint").distinct())
        checked = own.select("prog_syn_id", "p_partkey", F.array_join(arena.arena_violations(own), ",").alias("broken"))
        one = one.join(checked, "prog_syn_id")
        out = one if out is None else out.unionByName(one)
    return out.select("p_partkey", "package", "update.api_path", "update.old_signature", F.size("update.unit_tests").alias("update_tests"), F.array_join("prog_syn.imports", "|").alias("imports"), F.get("prog_syn.unit_tests", F.lit(0)).alias("first_test"), "broken")


@query("SELECT doc_id, 'f' AS name, 'a=(' || lang || ',1),*b' AS arguments, '-> int' AS returns, 2 AS headers, '(x)' || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN ' from docs' ELSE ' offered' END AS cascade FROM documents")
def signatures(spark, folder):
    """Function headers found in sources, and the cascade of places where a signature may stand."""
    source = F.concat(F.lit("x = 1\ndef f(a = ("), "lang", F.lit(", 1), *b) -> int:\n    def  g ( ) :\n        pass"))
    third = F.col("doc_id") % 3
    empty = F.lit(None).cast("string")
    own = F.when(third == 0, F.lit("def h(x): pass")).otherwise(empty)
    docs = F.when(third == 1, F.lit("m.h(x) -> from docs\nmore")).otherwise(F.lit("nothing here"))
    offered = F.struct(F.lit("h").alias("name"), F.lit("x").alias("arguments"), F.lit("offered").alias("returns"))
    found = text.signature_cascade(own, F.lit("m.h"), docs, offered)
    first = text.signature_of(source, F.lit("f"))
    cascade = F.concat(F.lit("("), found["arguments"], F.lit(")"), F.when(found["returns"] != "", F.concat(F.lit(" "), F.regexp_replace(found["returns"], "^->\\s*", ""))).otherwise(F.lit("")))
    return table(spark, folder, "documents").select("doc_id", first["name"].alias("name"), first["arguments"].alias("arguments"), first["returns"].alias("returns"), F.size(text.signatures_in(source)).alias("headers"), cascade.alias("cascade"))


@query(rf"""
WITH {_WRAP}, o AS (SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) AS pos, text FROM conversations)
SELECT (o.pos // 3)::INT AS pos, (o.pos % 3)::INT AS decode_idx, o.text AS output, i.conv_id AS input_conv, i.turn AS input_turn FROM o JOIN o i ON i.pos = o.pos // 3
""")
def realigned_outputs(spark, folder):
    """Outputs put back to the inputs of their slices of three."""
    c = table(spark, folder, "conversations")
    from pyspark.sql import Window as W

    rows = c.select("conv_id", "turn", "text", (F.row_number().over(W.orderBy("conv_id", "turn")) - 1).alias("pos"))  # a batch's positions
    out = testbeds.realigned(rows.select("pos", F.col("conv_id").alias("input_conv"), F.col("turn").alias("input_turn")), rows.select("pos", F.col("text").alias("output")), 3)
    return out.select("pos", "decode_idx", "output", "input_conv", "input_turn")


@query("SELECT e.event_id, e.user_id, t.turn, t.role FROM events e JOIN (SELECT conv_id AS user_id, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations GROUP BY 1) t USING (user_id)")
def matched_tasks(spark, folder):
    """Events with the first turn of the conversation that has their user's number."""
    tasks = table(spark, folder, "conversations").select(F.col("conv_id").alias("user_id"), "turn", "role")
    return testbeds.matched_tasks(table(spark, folder, "events").select("event_id", "user_id"), tasks, "user_id", "turn").select("event_id", "user_id", "turn", "role")


@query(r"SELECT max(len(regexp_extract_all(text, '\S+')))::INT AS tokens FROM documents")
def longest_text(spark, folder):
    return testbeds.longest_text(table(spark, folder, "documents"), "text").select(F.col("tokens").cast("int").alias("tokens"))


@query("WITH n AS (SELECT count(*) AS n FROM nation) SELECT n_nationkey::BIGINT AS pos, n_name AS item FROM nation UNION ALL SELECT n + r_regionkey, r_name FROM region, n")
def concatenated_lists(spark, folder):
    """The nations' list followed by the regions'."""
    lists = [table(spark, folder, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("item")), table(spark, folder, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("item"))]
    return testbeds.concatenated(lists, "pos", "item")


_NAME = "########## Start: Import statement(s) ##########' || chr(10) || 'import m' || chr(10) || '##########  End : Import statement(s) ##########' || chr(10) || '########## Start: Updated API implementation ##########' || chr(10) || 'def g(): pass' || chr(10) || '##########  End : Updated API implementation ##########"


@query(rf"""
WITH {_WRAP}, s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?s)\[PYTHON\](.*?)\[/PYTHON\]') THEN regexp_extract(t, '(?s)\[PYTHON\](.*?)\[/PYTHON\]', 1) ELSE regexp_extract(t, '(?s)```(?:python)?\s*(.*?)```', 1) END AS code FROM w)
SELECT conv_id, turn::INT AS decode_idx, test_idx::INT AS test_idx, variant, '{_NAME}' || chr(10) || CASE variant WHEN 'w' THEN 'm.f = g' || chr(10) ELSE '' END || code || chr(10) || 'def test_' || test_idx || '(): pass' || chr(10) || 'test_' || test_idx || '()' AS program
FROM s, (VALUES (0), (1)) a(test_idx), (VALUES ('w'), ('wo')) b(variant)
""")
def program_fan_out(spark, folder):
    """Each turn as a generation, with each of two tests, with and without the update."""
    rows = _wrapped(spark, folder).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]).alias("texts"))  # a conversation's turns
    rows = rows.withColumn("tests", F.array(F.lit("def test_0(): pass"), F.lit("def test_1(): pass"), F.lit("def test_2(): pass")))
    out = testbeds.fan_out(rows, "conv_id", "texts", "tests", F.array(F.lit("import m")), F.lit("def g(): pass"), F.lit("m.f = g"), first=2)
    return out.select("conv_id", "decode_idx", "test_idx", "variant", "program")


_EVAL = f"""
WITH p AS (SELECT l_orderkey AS decode_idx, count(*) AS num_tests, count_if(l_returnflag <> 'R') AS num_w, count_if(l_linestatus = 'O') AS num_o FROM lineitem GROUP BY 1),
q AS (SELECT o_custkey AS c_custkey, num_w = num_tests AS all_w, num_o = num_tests AS all_o FROM p JOIN orders ON o_orderkey = decode_idx),
m AS (SELECT c_custkey, count(*) AS n, count_if(all_w)::BIGINT AS c_new, count_if(all_o)::BIGINT AS c_old, count_if(all_w AND NOT all_o)::BIGINT AS c_new_excl, count_if(all_o AND NOT all_w)::BIGINT AS c_old_excl FROM q GROUP BY 1)
SELECT m.c_custkey, c_mktsegment, c_nationkey, n, {_sql_metrics()} FROM m JOIN customer USING (c_custkey) """
_KEEP = ["c_custkey", "c_mktsegment", "c_nationkey", "n", *[f"{a}{k}{b}" for k in reports.KS for a, b in (("pass_", "_new"), ("upass_", ""), ("pass_", "_old"), ("pass_", "_old_excl"))]]


def _outcomes(spark, folder):
    owners = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    tests = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("w"), (F.col("l_linestatus") == "O").alias("o"))
    return tests.join(owners, "l_orderkey").withColumnRenamed("l_orderkey", "decode_idx")


def _customers(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")


@query(_EVAL)
def prepending_eval(spark, folder):
    """Metrics of problems with their metadata, from outcomes: customers, their orders and lines."""
    out = testbeds.prepending("eval", "c_custkey", outcomes=_outcomes(spark, folder), metadata=_customers(spark, folder))
    return out.select(*_KEEP)


@query(_EVAL + "WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 2)")
def tuning_eval(spark, folder):
    """The same for problems whose group, a nation, has more than two members."""
    problems = _customers(spark, folder).withColumn("ordinal", F.col("c_custkey"))
    out = testbeds.tuning("eval", "c_custkey", "c_nationkey", "ordinal", problems=problems, outcomes=_outcomes(spark, folder), metadata=_customers(spark, folder))
    return out.select(*_KEEP)


@query(_EVAL + "WHERE (c_nationkey * 7 + 3) % 25 IN (SELECT c_nationkey FROM customer)")
def tuning_rand_eval(spark, folder):
    """The same for problems tuned on a partner nation's first customer."""
    problems = _customers(spark, folder).withColumn("ordinal", F.col("c_custkey"))
    partners = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("partner"))
    out = testbeds.tuning("rand_eval", "c_custkey", "c_nationkey", "ordinal", problems=problems, partners=partners, outcomes=_outcomes(spark, folder), metadata=_customers(spark, folder))
    return out.select(*_KEEP)


@query("""
WITH g AS (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5)
SELECT user_id AS task_id, count(*) AS n, count_if(event_type <> 'error')::BIGINT AS c, count_if(value < 1)::BIGINT AS n_empty FROM events WHERE user_id % 25 IN (SELECT n_nationkey FROM g JOIN customer ON c_nationkey = n_nationkey) GROUP BY 1
""")
def tuning_specificity(spark, folder):
    """Completion tasks under models tuned on the first five nations."""
    sample = splits.first_of_list(table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", 5)
    tasks = table(spark, folder, "events").select((F.col("user_id") % 25).cast("int").alias("c_nationkey"), F.col("user_id").alias("task_id"), (F.col("event_type") != "error").alias("passed"), (F.col("value") < 1).alias("is_empty"))
    problems = _customers(spark, folder).withColumn("ordinal", F.col("c_custkey"))
    out = testbeds.tuning("specificity", "c_custkey", "c_nationkey", "ordinal", problems=problems, sample=sample, first=5, completions=tasks)
    return out.select("task_id", "n", "c", "n_empty")


# -- code operators ---------------------------------------------------------------------

CODE = [
    ("plain", "import numpy as np\ndef f(a, b=2):\n    c = a + b\n    return np.sum(c)", True, "f", False, None, ".sum()=1", "import numpy as np\n\ndef var0(var1, var2=2):\n    var3 = var1 + var2\n    return var4.sum(var3)", "numpy"),
    ("two", "def f(): pass\ndef g(): pass", True, None, None, "name", "", "def var0():\n    pass\n\ndef var1():\n    pass", ""),
    ("broken", "def f(:\n  pass", False, None, None, "parse", None, "def f(:\n  pass", ""),
    ("vacuous", "def f(x):\n    return x", True, "f", True, "boring", "", "def var0(var1):\n    return var1", ""),
    ("passes", "def f(x):\n    pass", True, "f", True, "boring", "", "def var0(var1):\n    pass", ""),
    ("prints", "def f(x):\n    print(x)", True, "f", True, "boring", "print()=1", "def var0(var1):\n    var2(var1)", ""),
    ("branch", "def f(x: int) -> int:\n    if x > 0:\n        return 1\n    return 0", True, "f", False, None, "", "def var0(var1):\n    if var1 > 0:\n        return 1\n    return 0", ""),
    ("bare", "def f(x):\n    print(x)\n    return", True, "f", False, None, "print()=1", "def f(x):\n    print(x)\n    return", ""),
    ("calls", "def f(x):\n    return len(list(x))", True, "f", False, None, "len()=1,list()=1", "def var0(var1):\n    return var2(var3(var1))", ""),
    ("none", "x = 1", True, None, None, "name", "", "var0 = 1", ""),
    ("empty", "", True, None, None, "name", "", "", ""),
    ("nested", "def f(x):\n    def g(y):\n        return y\n    return g(x)", True, None, None, "name", "g()=1", "def var0(var1):\n\n    def var2(var3):\n        return var3\n    return var2(var1)", ""),
    ("method", "class A:\n    def f(self):\n        return self.g().h()", True, "f", False, None, ".g()=1,.h()=1", "class A:\n\n    def var0(var1):\n        return var1.g().h()", ""),
    ("loop", "def f(n):\n    t = 0\n    for i in range(n):\n        t += i\n    return t", True, "f", False, None, "range()=1", "def var0(var1):\n    var2 = 0\n    for var3 in var4(var1):\n        var2 += var3\n    return var2", ""),
    ("computed", "def f(x):\n    return g(x)(h(x))", True, "f", True, "boring", "g()=1", "def var0(var1):\n    return var2(var1)(var3(var1))", ""),
    ("inner_import", "def f(x):\n    import math\n    return math.sqrt(math.floor(x))", True, "f", False, None, ".floor()=1,.sqrt()=1", "def var0(var1):\n    import math\n    return math.sqrt(math.floor(var1))", "math"),
    ("from_import", "from os import path\ndef f(x):\n    return path.join(x, path.sep)", True, "f", True, "boring", ".join()=1", "from os import path\n\ndef var0(var1):\n    return path.join(var1, path.sep)", "path,os"),
    ("deleted", "def f(x):\n    y = x\n    del y\n    return x + x", True, "f", False, None, "", "def var0(var1):\n    var2 = var1\n    del \n    return var1 + var1", ""),
    ("lambda", "f = lambda x: x", True, None, None, "name", "", "var0 = lambda x: var1", ""),
    ("async", "async def f(x):\n    return await x", True, "f", False, None, "", "async def f(x):\n    return await var0", ""),
    ("comment", "# def g(x):\ndef f(x):  # twice\n    return x * 2", True, "f", True, "boring", "", "def var0(var1):\n    return var1 * 2", ""),
    ("text", "def f(x):\n    return 'def g('", True, "f", True, "boring", "", "def var0(var1):\n    return 'def g('", ""),
    ("boolean", "def f(a, b):\n    return a and b or a", True, "f", False, None, "", "def var0(var1, var2):\n    return var1 and var2 or var1", ""),
    ("chosen", "def f(a):\n    return 1 if a else 2", True, "f", False, None, "", "def var0(var1):\n    return 1 if var1 else 2", ""),
]


def _samples(spark):
    return constant_rows(spark, [(n, c) for n, c, *_ in CODE], "sample string, code string")


def _counts(calls):
    entries = F.transform(F.array_sort(F.map_entries(calls)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(entries, ",")


@query(_values("sample, parse_ok, name, boring, first_failed", [(n, *c[:4]) for n, _, *c in CODE]))
def static_checks(spark, folder):
    """Parsing, naming and vacuity of programs."""
    rows = _samples(spark).select("sample", codecheck.checked(F.col("code")).alias("c"))
    return rows.select("sample", "c.parse_ok", "c.name", "c.boring", "c.first_failed")


@query(_values("sample, calls", [(n, c[4]) for n, _, *c in CODE]))
def call_counts(spark, folder):
    """Calls of programs by name."""
    return _samples(spark).select("sample", _counts(codecheck.checked(F.col("code"))["calls"]).alias("calls"))


@query(_values("sample, code", [(n, c[5]) for n, _, *c in CODE]))
def anonymized(spark, folder):
    """Programs with names replaced by order of use."""
    return _samples(spark).select("sample", codecheck.anonymized(F.col("code")).alias("code"))


@query(_values("sample, modules, has_function", [(n, c[6], c[0] and "def " in code and n not in ("none", "empty")) for n, code, *c in CODE]))
def modules_and_functions(spark, folder):
    """Modules that programs import, and whether they define a function."""
    return _samples(spark).select("sample", F.array_join(codecheck.modules(F.col("code")), ",").alias("modules"), codecheck.with_functions(F.col("code")).alias("has_function"))


PROGRAMS = [
    (1, "def add(a, b):\n    return a + b"),
    (2, "def plus(x, y):\n    return x + y"),
    (3, "def minus(x, y):\n    return x - y"),
    (4, "def twice(x):\n    return x + x"),
]


@query(_values("id_a, id_b, distance", [(1, 2, 0), (1, 3, 1), (1, 4, 3), (2, 3, 1), (2, 4, 3), (3, 4, 4)]))
def near_dup_programs(spark, folder):
    """Programs anonymised, cut into tokens, and scored by token edits: within a block, here all of one update."""
    rows = constant_rows(spark, PROGRAMS, "id int, code string").withColumn("update", F.lit("u"))
    rows = rows.select("id", "update", neardup.lexed(codecheck.anonymized(F.col("code"))).alias("t"))
    return neardup.scored_pairs(rows, "id", "t", ["update"]).select("id_a", "id_b", "distance")


@query(_values("sample, nr, kind, text", [
    ("block", 0, "header", "if a:"), ("block", 1, "simple", "x = 1"), ("block", 2, "comment", "# one"), ("block", 3, "header", "for i in y:"), ("block", 4, "simple", "pass"),
    ("decorated", 0, "header", "@d\ndef f(a,\n      b):"), ("decorated", 1, "simple", "return a"), ("letters", 0, "simple", "é = 'ü'"), ("letters", 1, "simple", "z = é"),
]))
def statements(spark, folder):
    """Statements, headers and comments of programs in the order of their text."""
    samples = [("block", "if a:\n    x = 1  # one\n    for i in y:\n        pass"), ("decorated", "@d\ndef f(a,\n      b):\n    return a"), ("letters", "é = 'ü'\nz = é"), ("broken", "x =")]
    rows = constant_rows(spark, samples, "sample string, code string")
    return rows.select("sample", F.posexplode(codecheck.statement_rows(F.col("code"))).alias("nr", "s")).select("sample", "nr", "s.kind", "s.text")


@query(_values("sample, call", [(1, "f(1)"), (2, "f(g(2), 'a')"), (3, None), (4, None), (5, "m.f(x)"), (6, None), (7, None)]))
def assertion_calls(spark, folder):
    """The calls that assertions compare."""
    samples = ["assert f(1) == 2", "assert (f(g(2), 'a')) != 3", "assert x == 1", "x = f(1)", "assert m.f(x) < 1, 'no'", "assert f(1)", "assert f(1) < f(2) < 3"]
    rows = constant_rows(spark, list(enumerate(samples, 1)), "sample int, code string")
    return rows.select("sample", codecheck.assertion_calls(F.col("code")).alias("call"))


_CONTENT = [
    (1, '[{"a": 1}]', True, None, 1, '{"a": 1}', None, None),
    (2, "[{'a': 'x'}, {'b': 2}]", True, "2 objects, the first is used", 2, '{"a": "x"}', None, None),
    (3, "[]", False, "not a list of objects", 0, None, "", None),
    (4, "['x', \"y\"]", False, "not a list of objects", 0, None, "x,y", "['x', \"y\"]"),
    (5, '["x", null]', False, "not a list of objects", 0, None, None, '["x", null]'),
    (6, "[{", False, "can't be read", 0, None, None, "[{"),
    (7, '[{"t": "a\nb"}]', True, None, 1, '{"t": "a\\nb"}', None, None),
    (8, "'\"z\"'", False, "not a list of objects", 0, None, None, "z"),
    (9, "__import__('os')", False, "can't be read", 0, None, None, "__import__('os')"),
    (10, '```json\n["p"]\n```', False, "can't be read", 0, None, "p", '["p"]'),
]


@query(_values("sample, ok, message, items, first, list", [r[:1] + r[2:7] for r in _CONTENT]))
def loaded_content(spark, folder):
    """Lists of objects and lists of texts: JSON, fenced, as Python literals, and what is neither."""
    rows = constant_rows(spark, [r[:2] for r in _CONTENT], "sample int, t string")
    rows = rows.select("sample", literals.loaded_content(F.col("t")).alias("c"), F.array_join(text.string_list(F.col("t")), ",").alias("list"))
    return rows.select("sample", "c.ok", "c.message", "c.items", "c.first", "list")


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type END AS code FROM events")
def peeled_code(spark, folder):
    """Code in one, in many quotes and fences, and nothing at all."""
    e, t = F.col("event_type"), F.col("event_id") % 3
    many = F.concat(F.repeat(F.lit("'\""), F.lit(12)), e, F.repeat(F.lit("\"'"), F.lit(12)))
    wrapped = F.when(t == 0, F.concat(F.lit(" "), many, F.lit("\n"))).when(t == 1, F.concat(F.lit("```python\n"), e, F.lit("\n```"))).otherwise(F.lit(" '' "))
    return table(spark, folder, "events").select("event_id", text.python_code(wrapped).alias("code"))


_TESTS = [("both", "def t():\n    assert abs(-1) == 1"), ("only_with", "def t():\n    assert m.f() == 2"), ("only_without", "def t():\n    assert m.f() == 1"), ("neither", "def t():\n    raise SystemExit('stop')"), ("slow", "def t():\n    while True: pass")]
_FAIL = "failed: assertion error"


@query(_values("test, w, o, result_w, result_wo, is_complete", [("both", True, True, "passed", "passed", True), ("only_with", True, False, "passed", _FAIL, True), ("only_without", False, True, _FAIL, "passed", True), ("neither", False, False, "failed: stop", "failed: stop", True), ("slow", False, False, "timed out", "timed out", True)]))
def paired_execution(spark, folder):
    """Small programs of ours, put together with each test and run with and without an update."""
    rows = constant_rows(spark, _TESTS, "test string, body string").select("test", F.array(F.lit("[PYTHON]y = 1[/PYTHON]")).alias("texts"), F.array("body").alias("tests"))
    programs = testbeds.fan_out(rows, "test", "texts", "tests", F.array(F.lit("import math")), F.lit("class m: pass\nm.f = lambda: 1"), F.lit("m.f = lambda: 2"))
    out = testbeds.prepending("exec", "test", programs=programs, run=lambda p: execution.executed(p, timeout=2, allow=True, tasks=4))
    return out.select("test", "w", "o", "result_w", "result_wo", "is_complete")


@query(_values("sample, result, ostream, states", [(1, "passed", "hi\n", ""), (2, "failed: division by zero", "", ""), (3, "passed", "", "x:<class 'int'>=1,y:<class 'int'>=2|x:<class 'int'>=2,y:<class 'int'>=3,_return_val:<class 'int'>=3"), (4, "failed: no input", "", ""), (5, "failed: os.system", "", "")]))
def traced_programs(spark, folder):
    """Results, output and the variables at each return of programs."""
    samples = ["print('hi')", "1 / 0", "def f(x):\n    y = x + 1\n    if y > 2:\n        return y\n    return\nf(1)\nf(2)", "input()", "import os\nos.system('true')"]
    rows = constant_rows(spark, list(enumerate(samples, 1)), "sample int, program string")
    out = execution.traced(rows, timeout=5, allow=True, tasks=2).join(execution.executed(rows, timeout=5, allow=True, tasks=2).select("sample", "ostream"), "sample")
    order = F.array(F.lit("x"), F.lit("y"), F.lit("_return_val"))
    one = lambda s: F.array_join(F.transform(F.filter(order, lambda k: F.map_contains_key(s, k)), lambda k: F.concat(k, F.lit(":"), s[k]["type"], F.lit("="), s[k]["str_value"])), ",")
    return out.select("sample", "result", "ostream", F.coalesce(F.array_join(F.transform("states", one), "|"), F.lit("")).alias("states"))


@query(_values("sample, legal, illegal, lines, failure", [(1, "import math|x = math.pi", "import nothing_like_it", "import math|import re", None), (2, "", "", "", "import nothing_like_it: failed: No module named 'nothing_like_it'"), (3, "import re", "", "", "no block")]))
def tried_imports(spark, folder):
    """Import lines kept if they run after those before them, and import lines that answers offer."""
    rows = constant_rows(spark, [(1, ["import math", "import nothing_like_it", "x = math.pi"], "so ```python\nimport math\nimport re\n```"), (2, [], "```\nimport re\nimport nothing_like_it\n```"), (3, ["import re"], "import re")], "sample int, imports array<string>, answer string")
    out = execution.sampled_imports(execution.legal_imports(rows, allow=True, tasks=2), allow=True, tasks=2)
    return out.select("sample", *[F.array_join(c, "|").alias(c) for c in ("legal", "illegal", "lines")], "failure")


@query("SELECT kind, stood::INT AS stood, 5 - stood::INT AS left_over FROM (VALUES ('load', 0), ('parse', 1), ('boring', 2), ('wrong', 3), ('test', 4), ('pass', 5)) v(kind, stood)")
def check_orders(spark, folder):
    """How far kinds of checks stand from loading to passing, and the other way."""
    rows = constant_rows(spark, [(c,) for c in taxonomy.CHECK_ORDER], "kind string")
    return rows.select("kind", taxonomy.check_order(F.col("kind")).alias("stood"), taxonomy.check_order(F.col("kind"), descending=True).alias("left_over"))


_LINES = {k: ({p: "\n".join(f"{i}: {e[0]}" + "".join(f"\n{i}.{j}: {x}" for j, x in enumerate(e[1:], 1)) for i, e in enumerate(instructions.GENERAL[k][p] + extra, 1)) for p, extra in ((q, instructions.SPECIFIC[k].get(a, [])) for q, a in (("numpy", "numpy.unique"), ("itertools", "itertools.count"), ("re", "re.split")))}) for k in instructions.GENERAL}


@query(_values("kind, api_path, instruction", [(k, a, _LINES[k].get(p)) for k in _LINES for p, a in (("numpy", "numpy.unique"), ("itertools", "itertools.count"), ("re", "re.split"), ("other", "other.f"))]))
def package_instructions(spark, folder):
    """What to mind for functions of some packages, in each kind of stage."""
    items = constant_rows(spark, [("numpy", "numpy.unique"), ("itertools", "itertools.count"), ("re", "re.split"), ("other", "other.f")], "package string, api_path string")
    out = None
    for kind in instructions.GENERAL:
        one = instructions.instruction_lookup(items, *instructions.dimensions(spark, kind)).select(F.lit(kind).alias("kind"), "api_path", "instruction")
        out = one if out is None else out.unionByName(one)
    return out
