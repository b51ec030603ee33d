import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.columns import add_audit_columns
from millrace.operators.quality import (
    check_layers,
    column_checksums,
    compare_checksums,
    compare_counts,
    compare_key_aggregates,
    difference_sample,
    null_profile,
    parity_report,
    row_parity,
    synthetic,
    validate,
)

SCHEMA = "CustomerID int, TotalSales double, TransactionCount int"


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame([(1, 10.0, 1), (1, 20.5, 1), (2, 5.0, 1), (3, None, 1)], SCHEMA)


def test_drift_in_one_value_is_one_mismatch(source):
    target = source.withColumn("TotalSales", F.when(F.col("TotalSales") == 20.5, 24.5).otherwise(F.col("TotalSales")))
    out = compare_key_aggregates(source, target, ["CustomerID"], ["TotalSales", "TransactionCount"])
    assert rows(out) == [(1, "TotalSales", "sum", 30.5, 34.5)]
    assert compare_key_aggregates(source, target, ["CustomerID"], ["TotalSales"], "count").isEmpty()
    assert compare_key_aggregates(source, target, ["CustomerID"], ["TotalSales"], "min").isEmpty()
    with pytest.raises(ValueError):
        compare_key_aggregates(source, target, ["CustomerID"], ["TotalSales"], "median")


def test_rounding_is_tolerated_and_a_missing_key_is_not(spark, source):
    near = source.withColumn("TotalSales", F.col("TotalSales") * (1 + 1e-12))
    assert compare_key_aggregates(source, near, ["CustomerID"], ["TotalSales"]).isEmpty()
    lost = source.where("CustomerID <> 3")
    assert rows(compare_key_aggregates(source, lost, ["CustomerID"], ["TotalSales"])) == [(3, "TotalSales", "sum", None, None)]


def test_checksums_see_values_nulls_and_copies(spark, source):
    assert all(r.matches for r in compare_checksums(source, source.repartition(3), source.columns).collect())
    other = source.fillna(0.0)
    assert {r.column: r.matches for r in compare_checksums(source, other, source.columns).collect()} == {
        "CustomerID": True, "TotalSales": False, "TransactionCount": True,
    }
    swapped = source.select(F.col("TransactionCount").alias("CustomerID"), F.col("CustomerID").alias("TransactionCount"))
    sums, own = column_checksums(source).first(), column_checksums(swapped).first()
    assert sums.CustomerID != own.CustomerID
    pair = spark.createDataFrame([(1,), (1,)], "CustomerID int")
    other_pair = spark.createDataFrame([(2,), (2,)], "CustomerID int")
    assert column_checksums(pair).first() != column_checksums(other_pair).first()
    assert column_checksums(pair.limit(0)).first()[0] == 0


def test_counts_and_gate(source):
    assert rows(compare_counts(source, source.limit(2))) == [(4, 2, False)]
    assert rows(compare_counts(source.limit(0), source.limit(0))) == [(0, 0, True)]
    good = parity_report(source, source.repartition(2), ["CustomerID"], ["TotalSales"]).collect()
    assert all(r.passed for r in good) and {r.check for r in good} == {"row_count", "checksum", "key_aggregate", "all"}
    bad = parity_report(source, source.limit(3), ["CustomerID"], ["TotalSales"])
    assert bad.where("check = 'all' and not passed").count() == 1


def test_row_parity(spark, source):
    copies = source.unionAll(source.limit(1)).withColumn("Loaded", F.lit("now"))
    out = row_parity(copies, source.withColumn("TransactionCount", F.col("TransactionCount").cast("string")))
    assert out.compared == ["CustomerID", "TotalSales", "TransactionCount"]
    assert rows(out.summary) == [(5, 4, 1, 0, False)]
    assert rows(out.extra) == [("1", "10.0", "1", 1)] and out.missing.isEmpty()
    assert row_parity(source, source.repartition(2)).summary.first().passed
    assert row_parity(copies, source.limit(3), ignore=["totalsales "]).compared == ["CustomerID", "TransactionCount"]
    assert difference_sample(row_parity(source, source.limit(0)).extra, 2).count() == 2
    with pytest.raises(ValueError):
        row_parity(source.select("CustomerID"), source.select("TotalSales"))


def test_profiles(source):
    assert rows(null_profile(source)) == [
        ("CustomerID", 4, 0, 0.0), ("TotalSales", 4, 1, 0.25), ("TransactionCount", 4, 0, 0.0),
    ]
    report = validate(source.unionAll(source.limit(2))).first()
    assert (report.row_count, report.column_count, report.duplicate_rows, report.passed) == (6, 3, 2, True)
    assert report.null_counts.TotalSales == 1
    empty = validate(source.limit(0)).first()
    assert (empty.row_count, empty.duplicate_rows, empty.passed) == (0, 0, False)


def test_layers(spark, source):
    bronze = add_audit_columns(source, "desk")
    good = check_layers(bronze, bronze.dropDuplicates(["CustomerID"]), source.dropDuplicates(["CustomerID"]), ["CustomerID"], ["CustomerID"])
    assert all(r.passed for r in good.collect())
    two = bronze.unionAll(add_audit_columns(source, "other"))
    bad = check_layers(two, source, two, ["CustomerID"], ["CustomerID"])
    assert {(r.layer, r.rule) for r in bad.where("not passed").collect()} == {
        ("bronze", "single_source"), ("silver", "audit_columns"), ("silver", "unique_keys"),
        ("gold", "one_row_per_group"), ("gold", "not_larger_than_silver"),
    }


def test_synthetic_rows_do_not_depend_on_the_layout(spark):
    schema = T.StructType(
        [
            T.StructField("k", T.IntegerType(), False, {"key": True}),
            T.StructField("name", T.StringType(), True, {"key": True}),
            T.StructField("b", T.BooleanType()),
            T.StructField("at", T.TimestampType(), False),
            T.StructField("x", T.DoubleType(), False),
        ]
    )
    once = rows(synthetic(spark, schema, 90))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert rows(synthetic(spark, schema, 90)) == once
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert rows(synthetic(spark, schema, 90, seed=1)) != once
    assert [r[0] for r in once] == [i // 3 for i in range(90)]
    assert any(r[1] is None for r in once) and {r[1] for r in once} - {None} == {f"K{i}" for i in range(7)}
    assert all(r[3].year in range(2020, 2031) and abs(r[4]) <= 1000 for r in once)
    with pytest.raises(ValueError):
        synthetic(spark, T.StructType([T.StructField("m", T.BinaryType())]), 1)
