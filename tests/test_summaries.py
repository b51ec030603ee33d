from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.relate import lineage_edges, similar_sets, tag_counts
from millrace.operators.reshape import cross_tab, transpose
from millrace.operators.sets import except_all, union_all
from millrace.operators.summarize import Agg, category_counts, count_records, latest_by, summarize
from millrace.operators.text import (
    parse_datetime,
    regex_parse,
    regex_tokenize,
    regex_tokenize_columns,
    spark_date_format,
    text_to_columns,
    text_to_rows,
)


@pytest.fixture(scope="module")
def sales(spark):
    data = [("a", 1, 5.0, "x"), ("a", 2, None, "y"), ("a", 3, 7.0, None), (None, 1, 1.0, "z"), ("b", 9, None, None)]
    return spark.createDataFrame(data, "k string, at int, v double, s string")


def test_every_function(sales):
    out = summarize(
        sales,
        [("k", "key")],
        [
            Agg("v", "sum", "sum"), Agg("v", "count", "n"), Agg("v", "avg"), Agg("v", "min"), Agg("v", "max"),
            Agg("v", "std"), Agg("v", "var"), Agg("s", "countDistinct", "d"), Agg("s", "countDistinct", "ad", approx=True),
            Agg("v", "first", "first", ("at",)), Agg("v", "last", "last", ("at",)), Agg("s", "concat", "s", ("at",), "-"),
        ],
    )
    assert out.columns[:4] == ["key", "sum", "n", "avg_v"]
    assert rows(out) == [
        (None, 1.0, 1, 1.0, 1.0, 1.0, None, None, 1, 1, 1.0, 1.0, "z"),
        ("a", 12.0, 2, 6.0, 5.0, 7.0, 2.0**0.5, 2.0, 2, 2, 5.0, 7.0, "x-y"),
        ("b", None, 0, None, None, None, None, None, 0, 0, None, None, None),
    ]


def test_whole_table_and_empty_table(sales):
    total = [Agg("v", "sum", "sum"), Agg("v", "count", "n")]
    assert rows(summarize(sales, [], total)) == [(13.0, 3)]
    assert rows(summarize(sales.limit(0), [], total)) == [(None, 0)]
    assert rows(count_records(sales)) == [(5,)] and count_records(sales).columns == ["Count"]


def test_unknown_function_and_missing_order(sales):
    for agg in (Agg("v", "median"), Agg("v", "first"), Agg("s", "concat"), Agg("nope", "sum")):
        with pytest.raises(ValueError):
            summarize(sales, ["k"], [agg])


def test_concat_of_hot_groups(spark):
    data = [("hot" if i % 4 else f"k{i}", i, None if i % 7 == 0 else f"w{i}") for i in range(120)]
    df = spark.createDataFrame(data, "k string, at int, w string").repartition(3)
    for keys in (["k"], []):
        aggs = [Agg("w", "concat", "text", ("at",), "|"), Agg("at", "max", "last")]
        assert rows(summarize(df, keys, aggs, concat_rows=9)) == rows(summarize(df, keys, aggs, concat_rows=None))


def test_latest_and_counts(spark):
    df = spark.createDataFrame(
        [("red", "first", 1), ("red", "second", 2), ("blue", "only", 1), ("blue", None, None)], "fmt string, code string, at int"
    )
    assert rows(latest_by(df, ["fmt"], ["at"])) == [("blue", "only", 1), ("red", "second", 2)]
    assert [tuple(r) for r in category_counts(df.unionAll(df.limit(1)), "fmt", "n").collect()] == [("red", 3), ("blue", 2)]


def test_union_and_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None)], "id int, s string")
    b = spark.createDataFrame([("x", 1), ("q", 4)], "s string, id int")
    assert rows(union_all(a, b.drop("s")), "id", "s").count((1, None)) == 1
    assert union_all(a) is a
    assert rows(except_all(a, b)) == [(1, "x"), (1, "x"), (2, None)] and rows(except_all(b.select("id", "s"), a)) == [(4, "q")]
    with pytest.raises(ValueError):
        union_all()


def test_transpose_and_cross_tab(spark):
    wide = spark.createDataFrame([(1, 2, "x"), (2, None, "y")], "id int, n int, s string")
    assert rows(transpose(wide, ["id"])) == [(1, "n", "2"), (1, "s", "x"), (2, "n", None), (2, "s", "y")]
    assert transpose(wide, ["id"], ["n"]).dtypes[2] == ("Value", "int")
    long = transpose(wide, ["id"])
    back = cross_tab(long, ["id"], "Name", "Value", "first", headers=["n", "s"], order_by=["Value"])
    assert rows(back) == [(1, "2", "x"), (2, None, "y")]
    assert cross_tab(long, ["id"], "Name", "Value", "count").columns == ["id", "n", "s"]
    with pytest.raises(ValueError):
        cross_tab(long, ["id"], "Name", "Value", "first")


def test_splitting(spark):
    df = spark.createDataFrame([("a.b.c.d",), ("x",), ("",), (None,)], "t string")
    assert rows(text_to_columns(df, "t", ".", 2, prefix="p", extra="drop"), "p1", "p2") == [(None, None), ("", None), ("a", "b"), ("x", None)]
    assert text_to_columns(df, "t", ".", 3).first()["t3"] == "c.d"
    assert rows(text_to_rows(df, "t", ".", position="at")) == [
        (None, None), ("", 1), ("a", 1), ("b", 2), ("c", 3), ("d", 4), ("x", 1),
    ]
    with pytest.raises(ValueError):
        text_to_rows(df, "t", "")


def test_regex(spark):
    df = spark.createDataFrame([("ab12-cd34",), ("none",), (None,)], "t string")
    parsed = regex_parse(df, "t", r"([a-z]+)(\d+)", ["word", "number"])
    assert rows(parsed, "word", "number") == [(None, None), (None, None), ("ab", "12")]
    assert rows(regex_tokenize(df, "t", r"[a-z]+\d", alias="token"), "token") == [("ab1",), ("cd3",)]
    assert regex_tokenize_columns(df, "t", r"\d+", 3, prefix="n").first()[1:] == ("12", "34", None)


def test_dates(spark):
    assert spark_date_format("%d of %B %Y, %H:%M") == "dd' of 'MMMM yyyy, HH:mm".replace("' of '", " 'of' ")
    assert spark_date_format("yyyy-MM") == "yyyy-MM"
    df = spark.createDataFrame([("31.12.2024 23:05",), ("soon",), (None,)], "t string")
    assert rows(parse_datetime(df, "t", "%d.%m.%Y %H:%M", alias="d", on_error="null"), "d") == [(None,), (None,), (date(2024, 12, 31),)]
    readable = spark.createDataFrame([("31.12.2024 23:05",)], "t string")
    stamp = parse_datetime(readable, "t", "%d.%m.%Y %H:%M", to="timestamp").first()[0]
    assert stamp == datetime(2024, 12, 31, 23, 5)
    with pytest.raises(Exception, match="CANNOT_PARSE|could not be parsed"):
        parse_datetime(df, "t", "%d.%m.%Y %H:%M").collect()
    with pytest.raises(ValueError):
        spark_date_format("%Q")


def test_tag_sets(spark):
    df = spark.createDataFrame(
        [(4, ["fig", "pear"]), (7, ["kiwi", "lime"]), (2, ["pear", "plum", "plum"]), (9, None), (1, [])],
        "id int, tags array<string>",
    )
    best = similar_sets(df, "id", "tags", ["pear", "fig", "pear"], k=3).collect()
    assert [(r.id, round(r.score, 4)) for r in best] == [(4, 1.0), (2, 0.3333)]
    assert [r.id for r in similar_sets(df, "id", "tags", ["pear"], k=1).collect()] == [2]
    assert similar_sets(df, "id", "tags", ["none"], k=2).isEmpty() and similar_sets(df, "id", "tags", [], k=2).isEmpty()
    counts = [tuple(r) for r in tag_counts(df, "tags").collect()]
    assert counts == [("pear", 2), ("fig", 1), ("kiwi", 1), ("lime", 1), ("plum", 1)]


def test_lineage(spark):
    io = spark.createDataFrame(
        [("silver", "b", "read"), ("bronze", "b", "write"), ("bronze", "raw", "read"), ("silver", "s", "write"),
         ("silver", "s", "read"), ("gold", "s", "read"), ("gold", "s", "read"), ("gold", "b", "read")],
        "object string, table string, role string",
    )
    assert rows(lineage_edges(io)) == [("gold", "bronze"), ("gold", "silver"), ("silver", "bronze")]
