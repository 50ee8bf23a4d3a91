"""Every query that has SQL gives the SQL's rows."""

import pytest
from conftest import DATA, same_rows

from tidemark.queries import ORACLE, QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck(ORACLE[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "object_id"
    assert set(e.oracle_sql()) <= set(e.queries())


def test_curves_are_broadcast_and_columns_pruned(spark):
    plan = QUERIES["damage_orders"](spark, DATA)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "o_orderpriority" not in plan.split("== Physical Plan ==")[1]
