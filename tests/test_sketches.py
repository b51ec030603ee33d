from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.sketches import compare_sketches, distinct_sketches, merge_sketches, sketched_count


def _counts(sketches, *keys):
    return {tuple(r[k] for k in keys): r.n for r in sketches.withColumn("n", sketched_count(F.col("sketch"))).collect()}


def test_merged_sketches_equal_one_sketch_and_stay_within_the_error(spark):
    df = spark.range(120_000).select((F.col("id") % 30).alias("day"), F.expr("id * 7 % 60000").alias("user"))
    merged = merge_sketches(distinct_sketches(df, ["day"], "user", bits=10), [], bits=10)
    at_once = distinct_sketches(df, [], "user", bits=10)
    assert _counts(merged) == _counts(at_once)
    assert abs(_counts(merged)[()] / 60_000 - 1) < 5 * 2**-5
    few = distinct_sketches(df.where("user < 900"), ["day"], "user", bits=10)
    assert _counts(merge_sketches(few, [], bits=10))[()] == 900


def test_odd_values(spark):
    data = [("a", 1, "2024-01-01"), ("a", None, None), ("a", 1, "2024-01-02"), (None, None, None)]
    df = spark.createDataFrame(data, "k string, v int, d string").withColumn("d", F.col("d").cast("date"))
    assert _counts(distinct_sketches(df, ["k"], "v"), "k") == {("a",): 1, (None,): 0}
    assert _counts(distinct_sketches(df, ["k"], "d"), "k") == {("a",): 2, (None,): 0}
    wide = df.withColumn("v", F.col("v").cast("long"))
    both = distinct_sketches(df, ["k"], "v").unionAll(distinct_sketches(wide, ["k"], "v"))
    assert _counts(merge_sketches(both, ["k"]), "k") == {("a",): 1, (None,): 0}
    assert distinct_sketches(df.limit(0), ["k"], "v").collect() == []


def test_set_combinations(spark):
    def sketches(data):
        return distinct_sketches(spark.createDataFrame(data, "k string, v string"), ["k"], "v")

    before = sketches([("a", "x"), ("a", "y"), ("gone", "x"), (None, "p")])
    after = sketches([("a", "y"), ("a", "z"), ("a", "w"), ("new", "x"), (None, "p")])
    assert rows(compare_sketches(before, after, ["k"])) == [(None, 1, 0, 0), ("a", 1, 2, 1), ("gone", 0, 0, 1), ("new", 0, 1, 0)]
