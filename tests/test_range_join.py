"""Inequality joins against all pairs, in many ranges and in one."""

import math
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators import range_join as range_joins
from millrace.operators.range_join import _place, range_join

POINTS = [(i, float(v) if v is not None else None) for i, v in enumerate([5, 5, 5, 5, 1, 9, None, -3, 7.5, 100, 2, 5, math.nan])]
BANDS = [("a", 5.0, 5.0), ("b", 1.0, 9.0), ("c", 9.0, 1.0), ("d", None, 3.0), ("e", -100.0, 1000.0), ("f", 5.0, math.nan)]


def _above(x, y):
    return not math.isnan(y) and (math.isnan(x) or x > y)


@pytest.mark.parametrize("per_range", [1, 3, 1000])
@pytest.mark.parametrize("closed", [(True, False), (False, True), (True, True), (False, False)])
def test_bands(spark, per_range, closed):
    points = spark.createDataFrame(POINTS, "id int, x double")
    bands = spark.createDataFrame(BANDS, "id string, low double, high double")
    got = range_join(points, bands, "x", "low", "high", *closed, rows_per_range=per_range)
    assert got.columns == ["id", "x", "id_right", "low", "high"]

    def same(a, b):
        return a == b or math.isnan(a) and math.isnan(b)

    want = {
        (i, n) for i, x in POINTS for n, low, high in BANDS if None not in (x, low, high)
        if (_above(x, low) or closed[0] and same(x, low)) and (_above(high, x) or closed[1] and same(x, high))
    }
    assert {(r.id, r.id_right) for r in got.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1023, 1024, 1025, 1100])
def test_places(spark, n):
    cuts = [3 * k for k in range(n)]
    got = spark.range(-2, 3 * n + 3).select("id", _place(F.col("id"), cuts).alias("at")).collect()
    assert all(r["at"] == sum(c <= r.id for c in cuts) for r in got)


def test_one_bound_with_equal_keys_and_times(spark):
    start = datetime(2024, 1, 1)
    left = spark.createDataFrame([(i, i % 3, start + timedelta(hours=i)) for i in range(40)], "id int, k int, at timestamp")
    right = spark.createDataFrame([(j, j % 4, start + timedelta(hours=5 * j)) for j in range(8)], "n int, k int, since timestamp")
    got = range_join(left, right, "at", low="since", on=["k"], rows_per_range=4)
    want = {(i, j) for i in range(40) for j in range(8) if i % 3 == j % 4 and i >= 5 * j}
    assert {(r.id, r.n) for r in got.collect()} == want and got.columns == ["id", "k", "at", "n", "since"]
    below = range_join(left, right, "at", high="since", include_high=True, rows_per_range=4)
    assert below.count() == sum(i <= 5 * j for i in range(40) for j in range(8))
    with pytest.raises(ValueError):
        range_join(left, right, "at")
    with pytest.raises(TypeError):
        range_join(left.selectExpr("cast(id as string) id"), right, "id", low="n")


def test_empty_sides_and_plan(spark):
    left = spark.createDataFrame([(i,) for i in range(500)], "x int")
    right = spark.createDataFrame([(1, 3), (400, 450)], "low int, high int")
    assert rows(range_join(left.limit(0), right, "x", "low", "high")) == []
    assert rows(range_join(left, right.limit(0), "x", "low", "high")) == []
    found = range_join(left, right, "x", "low", "high", rows_per_range=20)
    assert found.count() == 52
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_more_than_a_thousand_ranges(spark):
    points = spark.range(2500).selectExpr("id", "cast(id as double) as x")
    bands = spark.createDataFrame([("a", 10.0, 13.0), ("b", 2000.5, 2100.0), ("c", -5.0, 9000.0)], "n string, low double, high double")
    got = range_join(points, bands, "x", "low", "high", rows_per_range=1)
    want = [("a", 3), ("b", 99), ("c", 2500)]
    assert rows(got.groupBy("n").count(), "n", "count") == want
    exact = points.selectExpr("id", "cast(x / 4 as decimal(12,2)) as x")
    got = range_join(exact, bands.selectExpr("n", "cast(low / 4 as decimal(12,3)) as low", "cast(high / 4 as decimal(12,3)) as high"),
                     "x", "low", "high", rows_per_range=1)
    assert rows(got.groupBy("n").count(), "n", "count") == want


@pytest.mark.parametrize("per_range", [1, 4, 50, 10_000])
def test_equal_keys_of_unlike_sizes_are_cut_on_their_own(spark, per_range):
    """Key 0 is frequent, key 1 less so, others rare or NULL."""
    left = spark.range(1500).selectExpr(
        "id", "case when id % 3 > 0 then 0 when id % 9 > 0 then 1 when id % 2 = 0 then null else id end as k",
        "cast(id * 7919 % 1009 as int) as x",
    )
    right = spark.range(60).selectExpr("id as n", "case when id % 7 = 0 then null when id % 2 = 0 then 0 when id % 3 = 0 then 1 else id end as k",
                                       "cast(id * 13 as int) as low", "cast(id * 13 + id % 5 * 40 as int) as high")
    plain = left.alias("l").join(right.alias("r"), F.expr("l.k = r.k and x > low and x <= high")).select("id", "n")
    got = range_join(left, right, "x", "low", "high", False, True, on=["k"], rows_per_range=per_range).select("id", "n")
    assert plain.count() and rows(got) == rows(plain)


def test_rare_keys_need_no_cuts(spark, monkeypatch):
    """However many rows a period spans, it stays one row where its key has few."""
    monkeypatch.setattr(range_joins, "_cuts", lambda *_: pytest.fail("cut"))
    left = spark.range(5000).selectExpr("id", "id % 1000 as k", "id as x")
    right = spark.range(1000).selectExpr("id as k", "0 as low", "5000 as high")
    found = range_join(left, right, "x", "low", "high", on=["k"], rows_per_range=10)
    assert found.count() == 5000


@pytest.mark.parametrize("per_range", [1, 3, 20, 1000])
@pytest.mark.parametrize(("low", "high"), [("low", "high"), ("low", None), (None, "high")])
def test_totals_are_those_of_the_pairs(spark, per_range, low, high):
    left = spark.range(300).selectExpr("id", "case when id % 11 > 0 then cast(id * 37 % 101 as double) end as x")
    right = spark.range(40).selectExpr("id div 2 as n", "cast(id * 3 - 5 as double) as low", "cast(id * 3 + id % 4 * 9 - 6 as double) as high")
    totals = {"pairs": ("count", "id"), "least": ("min", "x"), "last": ("max", "id"), "all": ("sum", "x")}
    args = (left, right, "x", low, high, True, True, (), "_right", per_range)
    got = range_join(*args, totals=totals).groupBy("n").agg(F.sum("pairs"), F.min("least"), F.max("last"), F.sum("all"))
    want = range_join(*args).groupBy("n").agg(F.count(F.lit(1)), F.min("x"), F.max("id"), F.sum("x"))
    assert rows(got) == rows(want)
    with pytest.raises(ValueError):
        range_join(left, right, "x", "low", totals={"m": ("avg", "x")})


def test_totals_do_not_write_out_pairs(spark):
    left, right = spark.range(4000).selectExpr("id as x"), spark.range(3000).selectExpr("id as low")
    found = range_join(left, right, "x", "low", rows_per_range=10, totals={"n": ("count", "x")})
    assert found.count() < 100_000
    assert found.agg(F.sum("n")).first()[0] == sum(4000 - i for i in range(3000))


def test_ranges_are_fine_where_bounds_crowd(spark):
    """All bounds lie among a hundredth of the rows, which one range of 200 rows would hold."""
    left = spark.range(10_000).selectExpr("id as x")
    right = spark.range(3000).selectExpr("id as n", "id % 90 as low", "id % 90 + 5 as high")
    x, low, high = F.col("x"), F.col("low"), F.col("high")
    kept, cuts = range_joins._crowded_cuts(left, x, right, low, high, 200)
    assert kept.count() == 95 and len(cuts) > 20
    assert range_join(left, right, "x", "low", "high", rows_per_range=200).count() == 15_000
