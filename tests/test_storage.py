import shutil

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.session import materialize, release_scratch, scratch_root
from millrace.sources.layers import layer_name, medallion
from millrace.sources.readers import inline_table, list_files, read_csv_strings, read_files, read_many, read_query, read_table
from millrace.sources.writers import merge_rows, needs_column_mapping, read_latest, upsert, write_path, write_table
from millrace.streaming.changes import append_stream, apply_changes, read_stream


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Anna", 3), (2, "Ben", 3)], "id int, name string, seq int")


def test_csv_export(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ Name , Amount\nAnna,10\n\"O'Neil, \"\"x\"\"\",30\nBen\nC,1,2\n,\n".encode())
    out = read_csv_strings(spark, str(tmp_path / "a.csv"))
    assert out.dtypes == [("Name", "string"), ("Amount", "string")]
    assert rows(out) == [("", ""), ("Anna", "10"), ("Ben", ""), ("C", "1"), ("O'Neil, \"x\"", "30")]
    (tmp_path / "empty.csv").write_bytes(b"")
    with pytest.raises(ValueError, match="empty"):
        read_csv_strings(spark, str(tmp_path / "empty.csv"))


def test_formats_by_extension(spark, people, tmp_path):
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / f"people.{fmt}")
        write_path(people, path, fmt=fmt) if fmt != "csv" else people.write.option("header", True).csv(path)
        assert rows(read_files(spark, path, schema=people.schema), *people.columns) == rows(people)
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "t.txt").write_text("line one\nline two\n")
    assert rows(read_files(spark, str(tmp_path / "t.tsv"))) == [("1", "2")]
    assert read_files(spark, str(tmp_path / "t.txt")).count() == 2
    with pytest.raises(ValueError):
        read_files(spark, "what.ever")


def test_many_files_and_listing(spark, people, tmp_path):
    write_path(people, f"{tmp_path}/one.parquet")
    write_path(people.withColumn("extra", F.lit(1)), f"{tmp_path}/two.parquet")
    out = read_many(spark, [f"{tmp_path}/one.parquet", f"{tmp_path}/two.parquet"], path_column="file")
    assert out.count() == 4 and out.where("extra is null and file like '%one.parquet%'").count() == 2
    files = list_files(spark, str(tmp_path), glob="*.parquet")
    assert files.columns == ["name", "path", "length", "modificationTime"] and files.where("length > 0").count() == files.count()
    again = read_many(spark, files.select("path"), fmt="parquet")
    assert again.count() == 4
    write_path(people, f"{tmp_path}/three.parquet")
    longer = read_many(spark, files.select("path"), fmt="parquet", path_column="file", max_paths=1)
    assert rows(longer, "id", "extra") == rows(again, "id", "extra") and longer.where("file like '%three%'").isEmpty()
    with pytest.raises(ValueError):
        read_many(spark, [])


def test_tables_and_queries(spark, people):
    odd = people.withColumnRenamed("name", "Full [Name]")
    assert needs_column_mapping(odd) and not needs_column_mapping(people)
    write_table(odd, "odd_people")
    write_table(odd.limit(1), "odd_people", mode="append")
    assert read_table(spark, "odd_people").count() == 3
    write_table(odd, "odd_people")
    assert rows(read_table(spark, "odd_people")) == rows(people)
    assert rows(read_query(spark, "select count(*) from {p} where id > 1", {"p": people})) == [(1,)]
    assert rows(inline_table(spark, [(1, None)], "a int, b string")) == [(1, None)]
    with pytest.raises(ValueError, match="upsert"):
        write_table(people, "x", mode="merge")
    spark.sql("drop table odd_people")


def test_merge_rows(spark, people):
    changes = spark.createDataFrame(
        [(1, "Ann", 2), (2, "Benno", 5), (2, "Benny", 4), (3, "Cy", 1), (None, "No", 1)], people.schema
    )
    assert rows(merge_rows(changes, people, ["id"], "seq")) == [(None, "No", 1), (1, "Anna", 3), (2, "Benno", 5), (3, "Cy", 1)]
    again = merge_rows(changes, merge_rows(changes, people, ["id"], "seq"), ["id"], "seq")
    assert rows(again) == rows(merge_rows(changes, people, ["id"], "seq"))
    assert rows(merge_rows(changes.where("id = 1"), people, ["id"])) == [(1, "Ann", 2), (2, "Ben", 3)]


def test_upsert_replays_late_changes_and_deletions(spark, people, tmp_path):
    target = str(tmp_path / "t")
    gone = people.where("id = 2").withColumns({"seq": F.lit(7), "name": F.lit("-")})
    late = people.where("id = 2").withColumns({"seq": F.lit(6), "name": F.lit("late")})
    for batch in (people, gone, gone, late, people):
        upsert(spark, batch, target, ["id"], "seq", delete_when="name = '-'")
    assert rows(read_latest(spark, target)) == [(1, "Anna", 3)]
    back = late.withColumn("seq", F.lit(9))
    assert rows(upsert(spark, back, target, ["id"], "seq", delete_when="name = '-'")) == [(1, "Anna", 3), (2, "late", 9)]
    (tmp_path / "t" / "_pending" / "buckets=16").mkdir(parents=True)  # an interrupted write does not count
    assert read_latest(spark, target).count() == 2
    assert rows(upsert(spark, late, target, ["id"], "seq")) == [(1, "Anna", 3), (2, "late", 9)]
    assert not (tmp_path / "t" / "_pending").exists()
    with pytest.raises(ValueError):
        read_latest(spark, str(tmp_path / "none"))


def _bucket_files(folder):
    return {p.parent.name: sorted(q.name for q in p.parent.glob("*.parquet")) for p in folder.glob("buckets=*/*/*.parquet")}


def test_upsert_keeps_untouched_buckets(spark, tmp_path):
    target = str(tmp_path / "t")
    start = spark.range(200).selectExpr("id", "id * 2 AS v", "1 AS seq")
    upsert(spark, start, target, ["id"], "seq", buckets=16)
    before = _bucket_files(tmp_path / "t")
    assert len(before) == 16
    change = spark.createDataFrame([(7, -1, 2), (7, -2, 2), (1000, 5, 2)], start.schema)
    hit = {f"__bucket={r[0]}" for r in change.selectExpr("pmod(xxhash64(id), 16)").collect()}
    for _ in range(2):  # sent twice
        got = upsert(spark, change, target, ["id"], "seq", buckets=3)  # the count of the first call holds
        assert got.count() == 201 and rows(got.where("id IN (7, 1000)")) == [(7, -2, 2), (1000, 5, 2)]
        after = _bucket_files(tmp_path / "t")
        assert {b for b in after if after[b] != before[b]} == hit and len(after) == 16
    assert rows(upsert(spark, change.limit(0), target, ["id"], "seq")) == rows(got)


def test_upsert_finishes_what_was_interrupted(spark, people, tmp_path):
    target = str(tmp_path / "t")
    upsert(spark, people, target, ["id"], "seq", buckets=1)
    shutil.copytree(tmp_path / "t", tmp_path / "copy")
    changed = people.withColumns({"seq": F.lit(50), "name": F.lit("z")})
    upsert(spark, changed, str(tmp_path / "copy"), ["id"], "seq")
    # All is written, then the writer dies half way: the only bucket is gone.
    (tmp_path / "t" / "_pending").mkdir()
    shutil.copytree(tmp_path / "copy" / "buckets=1", tmp_path / "t" / "_pending" / "buckets=1")
    (tmp_path / "t" / "_pending" / "buckets=1" / "_SUCCESS").touch()
    shutil.rmtree(tmp_path / "t" / "buckets=1" / "__bucket=0")
    assert rows(upsert(spark, people, target, ["id"], "seq")) == rows(read_latest(spark, str(tmp_path / "copy")))


def test_upsert_of_nothing(spark, people, tmp_path):
    target = str(tmp_path / "t")
    assert rows(upsert(spark, people.limit(0), target, ["id"], "seq")) == []
    assert rows(upsert(spark, people, target, ["id"], "seq")) == rows(people)


def test_medallion(spark, people, tmp_path):
    out = medallion(
        spark,
        "My Flow",
        {"people": people, "people!": people.limit(1), "again": people},
        lambda bronze: bronze["people"].unionAll(bronze["people!"]),
        {"a b": lambda clean, bronze: clean.groupBy("id").count(), "a-b": lambda clean, bronze: bronze["again"]},
        str(tmp_path),
    )
    names = [p.rsplit("/", 1)[1] for p in (*out.bronze.values(), out.silver, *out.gold.values())]
    assert names == ["bronze_people", "bronze_people_2", "bronze_people", "silver_my_flow", "gold_a_b", "gold_a_b_2"]
    assert rows(spark.read.parquet(out.gold["a b"])) == [(1, 2), (2, 1)]
    assert rows(spark.read.parquet(out.gold["a-b"])) == rows(people)
    assert layer_name("[x]") == "x"


def test_streams_pick_up_what_is_new(spark, people, tmp_path):
    source = str(tmp_path / "in")
    write_path(people, source)
    kept, target = str(tmp_path / "kept"), str(tmp_path / "latest")

    def run():
        stream = read_stream(spark, source, people.schema, files_per_batch=1)
        append_stream(stream, lambda df: df.where("id > 0"), kept, str(tmp_path / "c1")).awaitTermination()
        changes = read_stream(spark, source, people.schema)
        apply_changes(changes, target, ["id"], "seq", str(tmp_path / "c2")).awaitTermination()

    run()
    run()
    assert rows(spark.read.parquet(kept)) == rows(people) == rows(read_latest(spark, target))
    write_path(people.withColumns({"seq": F.lit(1), "name": F.lit("old")}).where("id = 1"), source, mode="append")
    write_path(people.withColumns({"seq": F.lit(4), "name": F.lit("new")}).where("id = 2"), source, mode="append")
    run()
    assert spark.read.parquet(kept).count() == 4
    assert rows(read_latest(spark, target)) == [(1, "Anna", 3), (2, "new", 4)]


def test_scratch_area(spark, people):
    copy = materialize(people)
    assert rows(copy) == rows(people) and copy.inputFiles()[0].startswith("file:")
    assert scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    release_scratch(spark)
    with pytest.raises(Exception):
        copy.count()
