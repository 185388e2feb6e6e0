"""Every registered query against its SQL, and the shape of its plan."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in SQL:
        assert compare(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["matches_by_kind"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string,text:string>" not in plan.replace("n_chars", "")
    assert "n_chars" not in plan and "lang" not in plan


def test_counting_kinds_shuffles_once_beyond_the_spread(spark):
    plan = QUERIES["matches_by_kind"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
