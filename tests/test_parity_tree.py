from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.quality import row_parity, row_parity_tree, rows_to_compare


@pytest.fixture
def table(spark):
    return spark.range(5000).select("id", (F.col("id") % 7).alias("x"), F.expr("if(id % 11 = 0, NULL, 'v' || id)").alias("s"))


@pytest.mark.parametrize("keys", [None, ["id"]])
@pytest.mark.parametrize("bits,levels", [(1, 1), (4, 3), (12, 2), (16, 3)])
def test_equal_to_the_whole_comparison(spark, table, keys, bits, levels):
    other = table.where("id <> 17").withColumn("x", F.expr("if(id in (5, 900), NULL, x)")).unionAll(table.where("id = 44"))
    tree, whole = row_parity_tree(other, table, keys, bits=bits, levels=levels), row_parity(other, table)
    assert tree.summary.first() == whole.summary.first()
    for side in ("extra", "missing"):
        assert Counter(map(tuple, getattr(tree, side).collect())) == Counter(map(tuple, getattr(whole, side).collect()))


def test_equal_buckets_are_left_out(spark, table):
    other = table.withColumn("x", F.expr("if(id = 5, -1, x)"))
    one_level = rows_to_compare(other, table, table.columns, ["id"], bits=6, levels=1)
    assert one_level.differing == 1 and 0 < one_level.migrated.count() < 5000 / 20
    deep = rows_to_compare(other, table, table.columns, ["id"])
    assert deep.migrated.count() == deep.expected.count() == 1
    same = rows_to_compare(table.repartition(3), table, table.columns)
    assert same.differing == 0 and same.migrated.isEmpty()
    assert "LocalTableScan" in same.migrated._jdf.queryExecution().executedPlan().toString()


def test_values_that_only_move(spark):
    a = spark.createDataFrame([("a", None), ("b", "b")], "p string, q string")
    b = spark.createDataFrame([(None, "a"), ("b", "b")], "p string, q string")
    found = row_parity_tree(a, b)
    assert rows(found.extra) == [("a", None, 1)] and rows(found.missing) == [(None, "a", 1)]
    assert row_parity_tree(a.limit(0), b.limit(0)).summary.first().passed
    assert not row_parity_tree(a.limit(0), b).summary.first().passed
    with pytest.raises(ValueError):
        row_parity_tree(a, b, bits=20)
