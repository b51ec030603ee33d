import glob
import random

import pytest

from millrace.sources.incremental import read_gold, refresh_gold
from millrace.streaming.changes import read_stream

_SCHEMA = "g string, x int, y double, gone boolean"


def _load(spark, base, data, **options):
    frame = spark.createDataFrame(data, _SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(f"{base}/in")
    query = refresh_gold(read_stream(spark, f"{base}/in", frame.schema), f"{base}/out", ["g"], ["x", "y"], "gone", **options)
    query.awaitTermination()
    return query


def _gold(spark, base):
    return {r.g: r for r in read_gold(spark, f"{base}/out", ["g"], ["x", "y"]).collect()}


def test_a_run_reads_only_new_rows(spark, tmp_path):
    base = str(tmp_path)
    _load(spark, base, [("a", i, 1.0, False) for i in range(50)])
    query = _load(spark, base, [("a", 70, None, False), (None, 5, 2.0, False)])
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2
    gold = _gold(spark, base)
    assert (gold["a"].row_count, gold["a"].sum_x, gold["a"].max_x, gold["a"].count_y) == (51, 49 * 25 + 70, 70, 50)
    assert (gold[None].row_count, gold[None].min_x, gold[None].sum_y) == (1, 5, 2.0)


@pytest.mark.parametrize("compact_after", [1, 2, 16])
def test_rows_taken_back(spark, tmp_path, compact_after):
    random.seed(1)
    base, there = str(tmp_path), []
    for _ in range(4):
        back = random.sample(there, len(there) // 2)
        new = [(random.choice("abc"), random.randint(0, 9), random.choice([None, 0.5, 2.5])) for _ in range(30)]
        for row in back:
            there.remove(row)
        there += new
        _load(spark, base, [(*r, True) for r in back] + [(*r, False) for r in new], compact_after=compact_after)
    gold = _gold(spark, base)
    for g in "abc":
        x, y = [r[1] for r in there if r[0] == g], [r[2] for r in there if r[0] == g and r[2] is not None]
        r = gold[g]
        assert (r.row_count, r.sum_x, r.min_x, r.max_x) == (len(x), sum(x), min(x), max(x))
        assert (r.count_y, r.sum_y, r.min_y, r.max_y) == (len(y), sum(y) if y else None, min(y, default=None), max(y, default=None))
    kept = glob.glob(f"{base}/out/states/batch=*")
    assert len(kept) < max(compact_after, 1) or compact_after == 16


def test_a_batch_sent_again_counts_once_and_empty_groups_go(spark, tmp_path):
    base = str(tmp_path)
    _load(spark, base, [("a", 1, 1.0, False), ("b", 2, 1.0, False)])
    _load(spark, base, [("a", 1, 1.0, True), ("b", 3, 1.0, False)])
    before = _gold(spark, base)
    assert set(before) == {"b"}
    commits = sorted(glob.glob(f"{base}/out/checkpoint/commits/[0-9]*"))
    spark._jvm.java.io.File(commits[-1]).delete()  # as if the driver had died before the commit
    for crc in glob.glob(f"{base}/out/checkpoint/commits/.{commits[-1].rsplit('/', 1)[1]}.crc"):
        spark._jvm.java.io.File(crc).delete()
    _load(spark, base, [("c", 9, None, False)])
    after = _gold(spark, base)
    assert after["b"] == before["b"] and after["c"].sum_y is None and set(after) == {"b", "c"}


def test_no_states_and_bad_arguments(spark, tmp_path):
    with pytest.raises(ValueError, match="no states"):
        read_gold(spark, str(tmp_path), ["g"], ["x"])
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        refresh_gold(stream, str(tmp_path), ["nowhere"], [])
    with pytest.raises(ValueError):
        refresh_gold(stream, str(tmp_path), ["value"], [], compact_after=0)
