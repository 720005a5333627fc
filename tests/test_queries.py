"""Every registered query of the core against DuckDB on the smallest tables."""

import pytest

from tests.conftest import TINY, same_rows

from quernstone.plans.more import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert same_rows(QUERIES[name](spark, TINY), duck, SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, TINY).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_module_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_plans_prune_and_push_down(spark):
    plan = QUERIES["report_metrics"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "ReadSchema" in x]
    assert any("l_orderkey" in x and "l_comment" not in x and "l_extendedprice" not in x for x in scans)
    plan = QUERIES["sampled_semi"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
