"""Every query with SQL agrees with DuckDB on the same tables; the others run and give rows."""

import pytest
from oracle import rows_of

from foliomill import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, spark, sf_dir, duck):
    found, expected = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_flagship_is_not_empty(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_query_collects_in_python(spark, sf_dir):
    """Queries over patterns stay in Spark's expressions: no Python in their plans."""
    for name in ("q04_repair_decisions", "q12_language_vote", "q30_case_grades", "q45_contained_passages"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
