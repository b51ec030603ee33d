import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.operators.joins import append_fields, join, join_anchors
from millrace.operators.lookup import find_replace


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n"), (5, "e")], "key int, v string")
    right = spark.createDataFrame([(1, "A"), (2, "B"), (None, "N"), (7, "G")], "k int, v string")
    return left, right


def test_null_keys_match(spark):
    codes = spark.createDataFrame([("x",), (None,), ("y",), (None,)], "code string")
    names = spark.createDataFrame([("x", "ex"), (None, "blank"), ("z", "zed")], "code string, name string")
    out = join(codes, names, ["code"])
    assert out.columns == ["code", "name"]
    assert rows(out) == [(None, "blank"), (None, "blank"), ("x", "ex")]
    assert rows(join(codes, names, ["code"], null_safe=False)) == [("x", "ex")]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_outer_joins_native_and_put_together(sides, how, null_safe):
    left, right = sides
    native = join(left, right, ["key"], ["k"], how=how, null_safe=null_safe, hot_rows=None)
    composed = join(left, right, ["key"], ["k"], how=how, null_safe=null_safe, hot_rows=0)
    assert native.columns == composed.columns == ["key", "v", "v_right"]
    assert rows(native) == rows(composed)
    same = left.key.eqNullSafe(right.k) if null_safe else left.key == right.k
    want = left.join(right, same, how).select(F.coalesce(left.key, right.k), left.v, right.v)
    assert rows(native) == rows(want)


def test_anchors_cover_both_sides(sides):
    left, right = sides
    out = join_anchors(left, right, ["key"], ["k"])
    assert rows(out.joined.select("key", "v").distinct().union(out.left_only)) == rows(left)
    assert rows(out.left_only) == [(5, "e")] and rows(out.right_only) == [(7, "G")]
    assert rows(join(left, right, ["key"], ["k"], how="left_anti")) == [(5, "e")]


def test_join_mistakes(sides):
    left, right = sides
    for call in (
        lambda: join(left, right, ["key"], ["k", "v"]),
        lambda: join(left, right, []),
        lambda: join(left, right, ["key"], ["k"], how="cross"),
        lambda: join(left.withColumn("v_right", F.lit(1)), right, ["key"], ["k"]),
        lambda: join(left, right, ["key"]),
    ):
        with pytest.raises(ValueError):
            call()


def test_null_safe_join_is_an_equi_join(sides, spark):
    left, right = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join(left, right, ["key"], ["k"])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_self_join_keeps_names_apart(sides):
    left, _ = sides
    out = join(left, left, ["key"], suffix="_again")
    assert out.columns == ["key", "v", "v_again"] and out.count() == 7


def test_append_fields(spark, sides):
    left, right = sides
    one = spark.createDataFrame([(3, "p")], "limit int, v string")
    assert append_fields(left, one).columns == ["key", "v", "limit", "v_source"]
    many = append_fields(left, right.withColumnRenamed("v", "w"), broadcast_rows=1)
    assert rows(many) == rows(left.crossJoin(right.withColumnRenamed("v", "w")))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert append_fields(left, one.where("limit > 3")).isEmpty()
    stamped = one.select(F.lit("2024-05-01 10:00:00").cast("timestamp").alias("at"), F.lit(None).cast("int").alias("none"))
    assert rows(append_fields(left, stamped), "at", "none") == rows(left.crossJoin(stamped), "at", "none")


def test_appended_scalars_reach_the_scan(spark, sides, tmp_path):
    sides[1].where("k is not null").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    mean = table.agg(F.avg("k").alias("mean"), F.max("v").alias("last"), F.lit(None).cast("date").alias("day"))
    above = append_fields(table, mean).where("k > mean and v < last")
    assert above.dtypes[2:] == [("mean", "double"), ("last", "string"), ("day", "date")]
    assert above.isEmpty() and rows(append_fields(table, mean).where("k > mean"), "k", "last") == [(7, "G")]
    plan = above._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "LessThan(v,G)" in plan


@pytest.fixture(scope="module")
def lookup(spark):
    data = [("cat", "dog", 2), ("cat", "lion", 1), ("at", "AT", 1), ("hen", None, 1), (None, "never", 1), ("", "never", 1)]
    return spark.createDataFrame(data, "find string, by string, rank int")


def test_find_replace_exact(spark, lookup):
    df = spark.createDataFrame([("cat",), ("catty",), ("hen",), (None,), ("at",)], "Child string")
    out = find_replace(df, lookup, "Child", "find", "by", order_by=["rank"])
    assert rows(out) == [(None,), ("AT",), ("catty",), ("hen",), ("lion",)]


@pytest.mark.parametrize("limit", [500, 0])
def test_find_replace_any_small_and_large(spark, lookup, limit):
    texts = ["the cat sat", "CAT cat", "", None, "hen", "a.b(c) at\nat", "ééat–cat", "catatcat", "no"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = find_replace(df, lookup, "text", "find", "by", mode="any", order_by=["rank"], phrases_in_pattern=limit)
    want = [t and t.replace("cat", "\0").replace("at", "AT").replace("\0", "lion") for t in texts]
    assert [r.text for r in out.orderBy("id").collect()] == want


@pytest.mark.parametrize("limit", [500, 0])
def test_replacements_are_not_searched_again(spark, limit):
    swap = spark.createDataFrame(
        [("a", "b"), ("b", "a"), ("a+", "[plus]"), ("\\E.", "$1"), ("é", "e"), ("long phrase of words", "L")], "f string, t string"
    )
    df = spark.createDataFrame([("ab a+ ba \\E. é a long phrase of words a long phrase",)], "x string")
    out = find_replace(df, swap, "x", "f", "t", mode="any", phrases_in_pattern=limit).first().x
    assert out == "ba [plus] ab $1 e b L b long phrbse"


def test_find_replace_any_against_brute_force(spark):
    import random

    rng = random.Random(3)
    phrases = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))): f"<{i}>" for i in range(40)}
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in range(60)]

    def brute(text):
        out, at = "", 0
        while at < len(text):
            hit = max((p for p in phrases if text.startswith(p, at)), key=len, default=None)
            out += phrases[hit] if hit else text[at]
            at += len(hit) if hit else 1
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    table = spark.createDataFrame(list(phrases.items()), "f string, t string")
    for limit in (500, 0):
        out = find_replace(df, table, "x", "f", "t", mode="any", phrases_in_pattern=limit)
        assert [r.x for r in out.orderBy("id").collect()] == [brute(t) for t in texts]


def test_find_append(spark, lookup):
    df = spark.createDataFrame([("cat",), ("cow",)], "Child string")
    out = find_replace(df, lookup, "Child", "find", mode="append", fields=["by", "rank"], order_by=["rank"])
    assert rows(out) == [("cat", "lion", 1), ("cow", None, None)]
    with pytest.raises(ValueError):
        find_replace(df, lookup, "Child", "find", mode="append")
    with pytest.raises(ValueError):
        find_replace(df, lookup, "Child", "find", "by", mode="fuzzy")
