from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.functions import vocabulary as fn
from millrace.operators.cleanse import cleanse
from millrace.operators.columns import (
    Col,
    add_audit_columns,
    drop_columns,
    rename_columns,
    select_columns,
    snake_case,
    spark_type,
    standardize_column_names,
)
from millrace.operators.filters import filter_false, filter_true, split
from millrace.operators.formulas import multi_field, with_formulas


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [(1, 10.5, 2, "x"), (2, None, 3, None), (3, -1.0, 1, "7")], "CustomerID int, Amount double, Quantity int, Notes string"
    )


def test_select_renames_casts_and_keeps_the_rest(sales):
    out = select_columns(
        sales, [Col("Amount", cast="int"), Col("CustomerID", rename="Cust [Id]"), Col("Notes", drop=True)], keep_rest=True
    )
    assert out.dtypes == [("Amount", "int"), ("Cust [Id]", "int"), ("Quantity", "int")]
    assert select_columns(sales, ["Quantity", "Amount"]).columns == ["Quantity", "Amount"]
    assert drop_columns(sales, ["Notes"]).columns == ["CustomerID", "Amount", "Quantity"]


def test_failing_casts(sales):
    bad = [Col("Notes", cast="int")]
    assert rows(select_columns(sales, bad, on_error="null")) == [(None,), (None,), (7,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        select_columns(sales, bad).collect()


def test_column_mistakes_are_errors(sales):
    for call in (
        lambda: select_columns(sales, ["nope"]),
        lambda: select_columns(sales, ["Amount", Col("Quantity", rename="amount")]),
        lambda: rename_columns(sales, {"Amount": "Notes"}),
        lambda: spark_type("SpatialObj"),
        lambda: spark_type("FixedDecimal"),
    ):
        with pytest.raises(ValueError):
            call()
    assert spark_type("FixedDecimal", 19, 6) == "decimal(19,6)" and spark_type("Int64") == "bigint"


def test_snake_case(spark):
    names = ["BatchID", "HTTPStatus Code", "already_snake", "Order[Total Price]", "lineNo2"]
    assert [snake_case(n) for n in names] == [
        "batch_id", "http_status_code", "already_snake", "order_total_price", "line_no2",
    ]
    one = spark.createDataFrame([(1,)], ["BatchID"])
    assert standardize_column_names(one).columns == ["batch_id"]
    with pytest.raises(ValueError, match="repeated"):
        standardize_column_names(spark.createDataFrame([(1, 2)], ["Cust ID", "custId"]))


def test_audit_columns(spark):
    df = spark.createDataFrame([(7, "pine")], ["tree", "kind"])
    out = add_audit_columns(df, "desk")
    assert out.columns == ["tree", "kind", "_ingested_at", "_source_system"]
    fixed = add_audit_columns(df, "desk", datetime(2024, 1, 2, 3)).first()
    assert fixed["_source_system"] == "desk" and fixed["_ingested_at"] == datetime(2024, 1, 2, 3)


def test_filter_streams(sales):
    assert rows(filter_true(sales, "Amount > 0"), "CustomerID") == [(1,)]
    assert rows(filter_false(sales, "Amount > 0"), "CustomerID") == [(3,)]
    assert filter_true(sales) is sales
    true, false = split(sales, F.col("Amount") > 0, nulls="false")
    assert rows(true.union(false)) == rows(sales) and rows(false, "CustomerID") == [(2,), (3,)]


def test_formulas_see_earlier_results(sales):
    out = with_formulas(
        sales, [("LineTotal", "Amount * Quantity"), ("Amount", F.lit(0)), ("Tax", "LineTotal / 4 + Amount", "decimal(9,2)")]
    )
    assert out.schema["Tax"].dataType.simpleString() == "decimal(9,2)"
    assert [float(r.Tax) for r in out.where("Tax is not null").orderBy("CustomerID").collect()] == [5.25, -0.25]


def test_multi_field(spark):
    df = spark.createDataFrame([(" a ", "b'c ")], "`A x` string, B string")
    assert multi_field(df, ["A x", "B"], "trim({current})").first() == ("a", "b'c")
    named = multi_field(df, ["A x"], "concat({name}, trim({current}))", prefix="New_")
    assert named.columns == ["A x", "B", "New_A x"] and named.first()[2] == "A xa"
    assert multi_field(df, ["B"], lambda value, name: F.concat(name, value)).first()[1] == "Bb'c "


def test_cleanse(spark):
    df = spark.createDataFrame(
        [("  many   words\there ", None, 1.5), (None, 4, None)], "name string, age int, size double"
    )
    out = cleanse(df, trim=True, collapse_whitespace=True, nulls_to_blank=True, numeric_nulls_to_zero=True, case="title")
    assert rows(out) == [("", 4, 0.0), ("Many Words Here", 0, 1.5)]
    assert out.dtypes == df.dtypes
    assert cleanse(df, ["name"], remove_all_whitespace=True, case="upper").first().name == "MANYWORDSHERE"
    assert rows(cleanse(df, ["age"], numeric_nulls_to_zero=True), "age", "size") == [(0, 1.5), (4, None)]
    assert cleanse(df) is df
    with pytest.raises(ValueError):
        cleanse(df, case="camel")


def test_vocabulary_beyond_the_oracle_queries(spark):
    df = spark.createDataFrame([("  Ab", None, date(2024, 2, 29), "abc", "xyz")], "s string, n string, d date, t string, u string")
    out = df.select(
        fn.title_case(F.lit("joHN smith")),
        fn.replace_char(F.col("t"), "abc", "x"),
        fn.pad_left(F.col("u"), 2, "*"),
        fn.is_empty(F.col("n")),
        fn.iif(F.col("n") == "a", "yes", "no"),
        fn.date(fn.date_time_add(F.col("d"), 1, "year")),
        fn.date_time_diff(F.col("d"), F.lit("2024-01-30").cast("date"), "days"),
        fn.to_number(F.col("u"), on_error="null"),
        fn.plus(F.col("t"), F.col("n")),
        fn.substring(F.col("t"), F.length("t") - 1),
        fn.date_time_to_utc(F.lit("2024-07-01 12:00:00").cast("timestamp"), "Europe/Berlin").cast("string"),
        fn.null().isNull(),
        fn.size(fn.array(F.lit(1), F.lit(2))),
    ).first()
    assert tuple(out) == (
        "John Smith", "x", "xy", True, "no", date(2025, 2, 28), 30, None, None, "c", "2024-07-01 10:00:00", True, 2,
    )
    clock = spark.range(1).select(fn.date_time_now().alias("now"), fn.date_time_today().alias("today")).first()
    assert abs((clock.now.date() - clock.today).days) <= 1
    with pytest.raises(ValueError):
        fn.date_time_add(F.col("d"), 1, "fortnight")
