"""Hot groups: the block way must give what a plain window gives."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.ordered import (
    dedupe_by_key,
    fill_down,
    multi_row,
    record_id,
    row_delta,
    row_tag,
    running_total,
)
from millrace.operators.positions import POSITION, numbered, split_by_group_size
from millrace.operators.sampling import sample, sample_exact, sample_fraction, sort
from millrace.operators.scripts import map_groups, map_pandas, multi_row_fold, scan_groups
from millrace.operators.sets import unique
from millrace.naming import sort_keys
from millrace.session import with_row_tag

SCHEMA = "id long, k string, ts int, v int, note string"


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; NULL keys, NULL values, equal times."""
    rng = random.Random(5)
    data = []
    for i in range(600):
        key = "hot" if i % 3 else rng.choice(["a", "b", "c", None, f"k{i}"])
        value = None if rng.random() < 0.2 else rng.randint(-9, 9)
        data.append((i, key, rng.randint(0, 40), value, rng.choice([None, "x", "y"])))
    rng.shuffle(data)
    return spark.createDataFrame(data, SCHEMA).repartition(5).persist()


def w():
    return Window.partitionBy("k").orderBy("ts", "id")


def so_far():
    return w().rowsBetween(Window.unboundedPreceding, 0)


ORDER = ["ts", "id"]


@pytest.mark.parametrize("hot_rows", [None, 7, 50, 10_000])
def test_running_total(skewed, hot_rows):
    got = running_total(skewed, "v", ["k"], ORDER, alias="total", hot_rows=hot_rows)
    assert got.schema["total"].dataType.simpleString() == "bigint"
    assert rows(got, "id", "total") == rows(skewed.withColumn("total", F.sum("v").over(so_far())), "id", "total")


@pytest.mark.parametrize("hot_rows", [None, 7, 50])
def test_fill_down(skewed, hot_rows):
    got = fill_down(skewed, "note", ["k"], ORDER, hot_rows=hot_rows)
    want = skewed.withColumn("note", F.last("note", ignorenulls=True).over(so_far()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("hot_rows", [None, 1, 2, 7, 50])
def test_neighbours(skewed, hot_rows):
    got = multi_row(
        skewed,
        "n",
        lambda row: F.concat_ws("/", row(-3, "id"), row(-1, "v"), F.col("id"), row(2, "id")),
        ["k"],
        ORDER,
        hot_rows=hot_rows,
    )
    want = F.concat_ws("/", F.lag("id", 3).over(w()), F.lag("v").over(w()), F.col("id"), F.lead("id", 2).over(w()))
    assert rows(got, "id", "n") == rows(skewed.withColumn("n", want), "id", "n")


def test_neighbours_of_the_whole_table(skewed):
    got = multi_row(skewed, "n", lambda row: row(-1, "id"), [], ["id"], hot_rows=25)
    assert rows(got, "id", "n") == [(i, i - 1 if i else None) for i in range(600)]


def test_expression_strings_and_overwriting(skewed):
    got = multi_row(skewed, "v", lambda row: "v * 2", ["k"], ORDER, hot_rows=10)
    assert rows(got, "id", "v") == rows(skewed.withColumn("v", F.expr("v * 2")), "id", "v")


@pytest.mark.parametrize("hot_rows", [None, 11])
def test_row_delta(skewed, hot_rows):
    got = row_delta(skewed, "v", ["k"], ORDER, hot_rows=hot_rows)
    assert rows(got, "id", "v_delta") == rows(
        skewed.withColumn("v_delta", F.col("v") - F.lag("v").over(w())), "id", "v_delta"
    )


@pytest.mark.parametrize("hot_rows", [None, 13])
def test_duplicates_and_first_rows_make_the_input(skewed, hot_rows):
    out = unique(skewed, ["k"], ORDER, hot_rows)
    assert rows(out.unique) == rows(
        skewed.withColumn("r", F.row_number().over(w())).where("r = 1").drop("r")
    )
    both = out.unique.unionByName(out.duplicates)
    assert both.exceptAll(skewed).isEmpty() and skewed.exceptAll(both).isEmpty()


def test_unique_whole_rows_with_many_copies(spark):
    df = spark.createDataFrame([(1, "a")] * 40 + [(2, None)] * 3 + [(3, "c")], "a int, b string")
    out = unique(df)
    assert rows(out.unique) == [(1, "a"), (2, None), (3, "c")]
    assert rows(out.duplicates) == [(1, "a")] * 39 + [(2, None)] * 2


@pytest.mark.parametrize("rows_per_partition", [10, 97, 10_000])
def test_record_id_is_dense_and_ordered(skewed, rows_per_partition):
    got = record_id(skewed, order_by=[("ts", True), "id"], start=1, rows_per_partition=rows_per_partition)
    want = skewed.withColumn("RecordID", F.row_number().over(Window.orderBy(F.desc("ts"), "id")).cast("long"))
    assert rows(got, "id", "RecordID") == rows(want, "id", "RecordID")


def test_record_id_plan_has_no_single_partition(skewed):
    plan = record_id(skewed, order_by=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_positions_of_a_group_of_copies(spark):
    copies = spark.createDataFrame([("same",)] * 200, "k string").repartition(4)
    got = numbered(copies, ["k"], sort_keys(copies, ["k"]), 200, 20)
    assert [r[0] for r in got.select(POSITION).orderBy(POSITION).collect()] == list(range(200))


def test_tags_are_given_to_written_rows(spark, skewed, tmp_path):
    """A retried task must tag a row alike: files are tagged as they are, shuffled rows once written."""
    skewed.write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert str(tmp_path) in with_row_tag(scan.where("v > 0"), "tag").inputFiles()[0]
    shuffled = with_row_tag(scan.groupBy("k").count(), "tag")
    assert str(tmp_path) not in shuffled.inputFiles()[0] and shuffled.select("tag").distinct().count() == shuffled.count()


def test_group_split(skewed):
    parts = split_by_group_size(skewed, ["k"], 100)
    assert parts.hot_groups == 1 and parts.hot_rows == 400
    assert {r.k for r in parts.hot.collect()} == {"hot"} and parts.cold.count() == 200
    whole = split_by_group_size(skewed, ["k"], 1000)
    assert whole.hot is None and whole.cold is skewed


def test_row_tag_is_unique(skewed):
    assert row_tag(skewed).select("RowTag").distinct().count() == 600


def test_order_is_asked_for(skewed):
    for call in (
        lambda: multi_row(skewed, "n", lambda row: row(-1, "id"), ["k"]),
        lambda: record_id(skewed),
        lambda: sample(skewed, 3),
    ):
        with pytest.raises(ValueError):
            call()


def test_dedupe_by_key(spark):
    df = spark.createDataFrame(
        [("p", 10, "c"), ("p", 30, "b"), ("p", 30, "a"), ("q", None, "z"), (None, 5, "n"), (None, 6, "m")],
        "part string, rev int, who string",
    )
    assert rows(dedupe_by_key(df, ["part"], "rev")) == [(None, 6, "m"), ("p", 30, "a"), ("q", None, "z")]
    assert rows(dedupe_by_key(df, ["part"], "rev", descending=False), "who") == [("c",), ("n",), ("z",)]
    assert rows(dedupe_by_key(df, ["part"], [("rev", True), ("who", True)]), "who") == [("b",), ("m",), ("z",)]
    plan = dedupe_by_key(df, ["part"], "rev")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("n", [2, 1500])
@pytest.mark.parametrize("how", ["first", "last"])
def test_sample_per_group(skewed, n, how):
    order = [F.col("ts"), F.col("id")] if how == "first" else [F.desc("ts"), F.desc("id")]
    want = skewed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where(f"r <= {n}").drop("r")
    assert rows(sample(skewed, n, how, ORDER, ["k"], hot_rows=30)) == rows(want)


def test_sample_and_sort(skewed):
    assert [r.id for r in sample(skewed, 3, "last", ["id"]).collect()] == [599, 598, 597]
    got = [tuple(r) for r in sort(skewed, [("v", True), "id"]).select("v", "id").collect()]
    want = [tuple(r) for r in skewed.orderBy(F.desc("v"), "id").select("v", "id").collect()]
    assert got == want and sort(skewed, []) is skewed


def test_sample_fraction_ignores_the_layout(skewed):
    taken = rows(sample_fraction(skewed, 0.3, ["id"], seed=3))
    assert taken == rows(sample_fraction(skewed.repartition(3, "v"), 0.3, ["id"], seed=3))
    assert 100 < len(taken) < 260
    assert sample_fraction(skewed, 0, ["id"]).isEmpty() and sample_fraction(skewed, 1, ["id"]).count() == 600


def _folded(data, init, step):
    """Brute force: the fold per key over (ts, id)."""
    out, state = {}, {}
    for r in sorted(data, key=lambda r: (r.ts, r.id)):
        state[r.k] = step(state.get(r.k, init), r)
        out[r.id] = state[r.k]
    return sorted(out.items())


@pytest.mark.parametrize("group_rows", [None, 9, 60])
def test_fold_with_bounds(skewed, group_rows):
    got = multi_row_fold(skewed, "f", 3.0, "v", ["k"], ORDER, low=F.lit(-5), high="ts / 4.0", group_rows=group_rows)
    want = _folded(skewed.collect(), 3.0, lambda p, r: min(r.ts / 4, max(-5.0, p + (r.v or 0))))
    assert rows(got, "id", "f") == want
    assert got.columns == [*skewed.columns, "f"]


@pytest.mark.parametrize("group_rows", [None, 9])
def test_fold_with_restarts_and_changes_of_sign(skewed, group_rows):
    scale = "case when id % 11 = 0 then 0 when id % 7 = 0 then -1 else 0.5 end"
    got = multi_row_fold(skewed, "f", 8.0, "v", ["k"], ORDER, scale=scale, low="-6", group_rows=group_rows)

    def step(p, r):
        s = 0.0 if r.id % 11 == 0 else -1.0 if r.id % 7 == 0 else 0.5
        return max(-6.0, s * p + (r.v or 0))

    assert [(i, round(f, 9)) for i, f in rows(got, "id", "f")] == [
        (i, round(f, 9)) for i, f in _folded(skewed.collect(), 8.0, step)
    ]


def test_fold_is_a_running_total(skewed):
    got = multi_row_fold(skewed, "v", 0.0, "v", ["k"], ORDER, group_rows=20)
    want = skewed.select("id", F.coalesce(F.sum("v").over(so_far()), F.lit(0)).cast("double").alias("v"))
    assert rows(got, "id", "v") == rows(want, "id", "v")


@pytest.mark.parametrize("group_rows", [None, 8])
def test_scan_counts_rows_before(skewed, group_rows):
    import pyarrow as pa

    def emit(table, before):
        start = before["n"] if before else 0
        return table.append_column("at", pa.array(range(start, start + table.num_rows), pa.int64()))

    got = scan_groups(
        skewed,
        ["k"],
        ORDER,
        lambda table: {"n": table.num_rows},
        lambda before, block: {"n": (before["n"] if before else 0) + block["n"]},
        emit,
        "n long",
        f"{SCHEMA}, at long",
        group_rows=group_rows,
    )
    want = skewed.withColumn("at", (F.row_number().over(w()) - 1).cast("long"))
    assert rows(got) == rows(want)


def test_map_groups_streams_in_order(skewed, spark):
    """Batches smaller than the group still arrive in order, one group after another."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        def script(key, frames):
            n, last = 0, None
            for frame in frames:
                for pair in zip(frame["ts"], frame["id"], strict=True):
                    assert last is None or last < pair
                    last, n = pair, n + 1
            import pandas as pd

            yield pd.DataFrame({"k": [key[0]], "n": [n]})

        got = map_groups(skewed, ["k"], ORDER, script, "k string, n long")
        assert rows(got) == rows(skewed.groupBy("k").count())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_map_pandas(skewed):
    got = map_pandas(skewed.select("id"), lambda f: f.assign(twice=f.id * 2), "id long, twice long")
    assert rows(got) == [(i, 2 * i) for i in range(600)]


def test_exact_samples(spark):
    df = spark.range(600).selectExpr("id", "IF(id % 3 = 0, NULL, id % 2) AS g", "id % 5 AS copy")

    def drawn(n, source=df, **more):
        return rows(sample_exact(source, n, ["id"], **more))

    for n in (0, 1, 50, 600, 900):
        assert len(drawn(n)) == min(n, 600) and drawn(n) == drawn(n, df.repartition(9, "copy"))
    assert set(drawn(20)) <= set(drawn(50)) and drawn(50, seed=1) != drawn(50)
    for n, hot in ((7, 10), (1500, 10), (40, None)):  # beyond 1000 by numbering
        got = sample_exact(df, n, ["id"], group_by=["g"], hot_rows=hot)
        assert got.columns == df.columns
        assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == dict.fromkeys((None, 0, 1), min(n, 200))
    copies = df.select(F.lit(1).alias("id"), "copy")
    assert len(drawn(33, copies)) == 33 and drawn(5, df.limit(0)) == []
    with pytest.raises(ValueError):
        sample_exact(df, -1, ["id"])
