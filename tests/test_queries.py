import pytest

from timeloom.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf, same):
    same(QUERIES[name](spark, sf), SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_interval_plan_has_no_cartesian_product(spark, sf):
    plan = QUERIES["interval_argmax_assign"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
