"""Small limits on large tables: few partitions, and blocks that stream through Python."""

from pyspark.sql import functions as F

from millrace.operators import positions
from millrace.operators.scripts import multi_row_fold
from millrace.plans import checks


def test_small_limits_do_not_make_thousands_of_partitions(spark):
    rows = spark.range(60_000).selectExpr("id div 300 as k", "id as x")
    got = positions.numbered(rows, ["k"], [F.col("x").asc()], 60_000, 10)
    parts = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in parts and got.select("__position").distinct().count() == 300
    assert got.where("__position <> x % 300").isEmpty()
    assert got.inputFiles() and len(got.inputFiles()) <= positions.FREE_PARTITIONS + 4


def test_blocks_stream_rather_than_form_groups(spark):
    rows = spark.range(4000).selectExpr("id % 3 as k", "id as x", "cast(id % 7 - 3 as double) as step")
    out = multi_row_fold(rows, "total", 2.0, "step", ["k"], ["x"], scale=F.lit(0.5), group_rows=6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1  # states of whole groups; their blocks come as a stream
    plain = multi_row_fold(rows, "total", 2.0, "step", ["k"], ["x"], scale=F.lit(0.5), group_rows=None)
    near = out.join(plain.withColumnRenamed("total", "other"), ["k", "x"])
    assert near.count() == 4000 and near.where("abs(total - other) > 1e-9").isEmpty()


def test_a_table_in_another_order_is_not_dealt_to_five_tasks(spark):
    class Tables:
        lineitem = spark.range(100).selectExpr("id as l_suppkey", "id as l_orderkey")

    seen = []
    kept, checks.row_parity_tree = checks.row_parity_tree, lambda a, b: seen.append(a) or kept(a, b)
    try:
        assert checks.parity_tree_equal(Tables).first().passed
    finally:
        checks.row_parity_tree = kept
    assert "hashpartitioning(l_suppkey" in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert ", 5)" not in seen[0]._jdf.queryExecution().executedPlan().toString()
