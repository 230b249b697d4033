"""Every registered query against its SQL twin on the smallest tables, and its plan."""

import pytest

import __spark_entry__ as entry_points
from liftline.plans import all_entries
from tests.comparison import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ENTRIES = all_entries()

# None of these may be part of a plan: they pair everything with everything, or
# leave the JVM row by row.
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


@pytest.fixture(scope="module")
def duck():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", list(ENTRIES))
def test_same_as_sql(spark, duck, name):
    assert compare(spark, duck, name, ENTRIES[name], SF_DIR) is None


@pytest.mark.parametrize("name", list(ENTRIES))
def test_plan_has_no_forbidden_operator(spark, name):
    plan = ENTRIES[name].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert [word for word in FORBIDDEN if word in plan] == []


def test_every_inventory_item_is_registered():
    wanted = [f"a{i:02d}" for i in range(1, 61)] + [f"b{i:02d}" for i in range(1, 21)]
    have = {name.split("_")[0] for name in ENTRIES}
    assert [item for item in wanted if item not in have] == []


def test_entry_points(spark):
    assert set(ENTRIES) <= set(entry_points.queries())
    assert set(ENTRIES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).columns[:4] == ["request_id", "pos", "site_id", "slug"]


def test_same_result_without_broadcast(spark, duck):
    """Large dimensions are shuffled; the flagship must not rely on broadcasting them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("a18_batched_summaries", "a47_selection_fallback", "b04_launch_assignment"):
            assert compare(spark, duck, name, ENTRIES[name], SF_DIR) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_latest_per_key_is_reduced_before_the_shuffle(spark):
    plan = ENTRIES["a22_latest_per_key"].run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial") if "Partial" in plan else -1
    assert plan.count("WindowGroupLimit") == 2 and partial > plan.index("Exchange")
