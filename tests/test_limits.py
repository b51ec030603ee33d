"""Limits that only choose a plan must not show in results, and large inputs must not meet in one place."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators.joins import join
from millrace.operators.lookup import find_replace
from millrace.operators.ordered import record_id
from millrace.operators.positions import heavy_keys
from millrace.operators.quality import column_checksums, parity_report
from millrace.operators.sampling import sample, sort
from millrace.operators.scripts import multi_row_fold
from millrace.operators.summarize import Agg, summarize
from millrace.operators.text import regex_tokenize_columns
from millrace.session import scratch_root
from millrace.sources.readers import read_csv_strings, read_many
from millrace.sources.writers import merge_rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def files(spark, tmp_path):
    """Files under names with a blank and a percent sign, a folder of two, and one that nobody lists."""
    for i, name in enumerate(["with blank", "with%41percent", "folder/a", "folder/b", "unlisted"]):
        df = spark.range(i * 10, i * 10 + 3).withColumnRenamed("id", "other" if name == "unlisted" else "id")
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return str(tmp_path)


@pytest.mark.parametrize("max_paths", [100_000, 2, 1])
def test_lists_of_files_mean_the_same_at_every_length(spark, files, max_paths):
    listed = [f"{files}/with blank", f"{files}/with%41percent", f"{files}/folder/*"]
    paths = spark.createDataFrame([(p,) for p in listed], "p string")
    got = read_many(spark, paths, fmt="parquet", max_paths=max_paths)
    assert got.columns == ["id"] and sorted(r.id for r in got.collect()) == [0, 1, 2, 10, 11, 12, 20, 21, 22, 30, 31, 32]
    missing = paths.unionAll(spark.createDataFrame([(f"{files}/nowhere",)], "p string"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_many(spark, missing, fmt="parquet", max_paths=max_paths).collect()


def test_csv_files_with_other_headers_are_errors(spark, tmp_path):
    for name, text in {"x/a.csv": "A,B\n1,2\n", "x/b.csv": "B,A\n3,4\n", "y/a.csv": "A,A\n1,2\n", "z/a.csv": "A,B\n1,2\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    for folder in "xy":
        with pytest.raises(Exception, match="(?i)header"):
            read_csv_strings(spark, f"{tmp_path}/{folder}").collect()
    assert rows(read_csv_strings(spark, f"{tmp_path}/z")) == [("1", "2")]


def test_large_csv_files_are_divided(spark, tmp_path):
    (tmp_path / "long.csv").write_text("A,B\n" + "".join(f"{i},{'x' * 200}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        assert read_csv_strings(spark, f"{tmp_path}/long.csv").rdd.getNumPartitions() > 4
        assert read_csv_strings(spark, f"{tmp_path}/long.csv", multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("concat_rows", [100_000, 3])
def test_concatenation_alone(spark, concat_rows):
    df = spark.range(20).withColumn("k", F.col("id") % 2)
    one = Agg("id", "concat", "all", ("id",))
    assert rows(summarize(df, ["k"], [one], concat_rows), "k", "all") == [
        (k, ",".join(str(i) for i in range(k, 20, 2))) for k in (0, 1)
    ]
    assert rows(summarize(df, [], [one], concat_rows)) == [(",".join(map(str, range(20))),)]


@pytest.mark.parametrize("limit", [500, 0])
def test_phrases_of_odd_characters(spark, limit):
    phrases = [(r"ü\E.*", "1"), (r"\Qa", "2"), ("🎉🎉", "3"), ("[x]#", "4"), ("_-", "5"), ("é", "6")]
    lookup = spark.createDataFrame(phrases, "p string, by string")
    text = r"ü\E.* \Qa 🎉🎉🎉 [x]# x _- é ü\E!"
    df = spark.createDataFrame([(text,)], "t string")
    got = find_replace(df, lookup, "t", "p", "by", mode="any", phrases_in_pattern=limit).first()[0]
    want = text
    for p, by in phrases:
        want = want.replace(p, by)
    assert got == want


def test_no_text_is_a_range_key(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"long text {i}", "en" if i % 3 else "de") for i in range(50)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = re.findall(r"rangepartitioning\((.*)\)", _plan(sort(docs, ["lang"])))
    assert found and all(not re.search(r"text#\d+ ASC", x) for x in found)
    ids = record_id(docs, order_by=["lang"], rows_per_partition=7)
    assert sorted(r.RecordID for r in ids.collect()) == list(range(1, 51))
    assert [r.lang for r in ids.orderBy("RecordID").collect()] == sorted(r.lang for r in docs.collect())
    in_order = sort(docs, [("lang", True), "doc_id"]).collect()
    assert [(r.lang, r.doc_id) for r in in_order] == [(r.lang, r.doc_id) for r in sorted(in_order, key=lambda r: (-ord(r.lang[0]), r.doc_id))]


def test_sorting_a_joined_frame_writes_nothing(spark):
    import os

    def copies():
        root = scratch_root(spark).removeprefix("file://")
        return set(os.listdir(root)) if os.path.exists(root) else set()

    a = spark.range(100).repartition(3)
    before = copies()
    joined = join(a, a.withColumn("x", -F.col("id")), ["id"], hot_rows=None)
    assert [r.id for r in sort(joined, ["x"]).collect()] == list(range(99, -1, -1))
    assert copies() == before


@pytest.mark.parametrize("n", [5, 12_000])
def test_first_rows_come_in_order(spark, n):
    df = spark.range(15_000).repartition(5)
    assert [r.id for r in sample(df, n, "first", [("id", True)]).collect()] == list(range(14_999, 14_999 - n, -1))


@pytest.mark.parametrize("group_rows", [None, 4])
def test_additive_folds_are_exact_and_stay_on_the_jvm(spark, group_rows):
    rows_ = [(1, i, 9_007_199_254_740_993 if i == 0 else 1, "0.10") for i in range(10)] + [(2, 0, None, None)]
    df = spark.createDataFrame(rows_, "k int, at int, n long, d string").withColumn("d", F.col("d").cast("decimal(10,2)"))
    longs = multi_row_fold(df, "f", 0, "n", ["k"], ["at"], group_rows=group_rows)
    assert "Python" not in _plan(longs) and "Arrow" not in _plan(longs)
    assert [r.f for r in longs.where("k = 1").orderBy("at").collect()] == [9_007_199_254_740_993 + i for i in range(10)]
    assert [r.f for r in longs.where("k = 2").collect()] == [0]
    decimals = multi_row_fold(df, "f", 1, "d", ["k"], ["at"], group_rows=group_rows)
    assert [str(r.f) for r in decimals.where("k = 1").orderBy("at").collect()] == [f"{1 + (i + 1) / 10:.2f}" for i in range(10)]


def test_checksums_have_room(spark):
    df = spark.range(10).withColumn("same", F.lit("x"))
    assert {f.dataType.simpleString() for f in column_checksums(df).schema} == {"decimal(38,0)"}


def test_parity_reads_each_side_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 AS k", "id AS v").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    report = parity_report(t, t.repartition(3), ["k"], ["v"])
    assert _plan(report).count("FileScan") == 2
    assert all(r.passed for r in report.collect())
    other = parity_report(t, t.withColumn("v", F.when(F.col("v") == 3, 4).otherwise(F.col("v"))), ["k"], ["v"])
    assert {(r.check, r.column): r.passed for r in other.collect()} == {
        ("row_count", "*"): True, ("checksum", "k"): True, ("checksum", "v"): False, ("key_aggregate", "v"): False, ("all", "*"): False,
    }
    empty = parity_report(t.limit(0), t.limit(0), ["k"], ["v"])
    assert all(r.passed for r in empty.collect())


def test_ties_do_not_depend_on_batches(spark):
    def change(*values):
        return spark.createDataFrame([(1, 5, v) for v in values], "k int, seq int, v string")

    for order in (["x", "y", "x"], ["y", "x"], ["x", None, "y"]):
        state = change(order[0])
        for v in order[1:]:
            state = merge_rows(change(v), state, ["k"], "seq")
        at_once = merge_rows(change(*order), state.limit(0), ["k"], "seq")
        assert rows(state) == rows(at_once)


def test_heavy_keys_are_found_in_a_sample(spark):
    df = spark.range(400_000).select(F.when(F.col("id") < 150_000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert [tuple(r) for r in heavy_keys(df, ["k"], 120_000).collect()] == [("hot", 150_000)]
    assert [tuple(r) for r in heavy_keys(df, ["k"], 1000).collect()] == [("hot", 150_000)]


def test_further_tokens_are_kept(spark):
    df = spark.createDataFrame([("a1 b2 c3 d4",), ("a1",), (None,)], "t string")
    out = regex_tokenize_columns(df, "t", "[a-z][0-9]", 2, prefix="p", extra="more")
    assert [tuple(r) for r in out.select("p1", "p2", "more").collect()] == [("a1", "b2", ["c3", "d4"]), ("a1", None, []), (None, None, None)]
