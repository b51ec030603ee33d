"""Writing tables and files, and upserts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.naming import cols, require
from millrace.operators.ordered import dedupe_by_key

WRITE_MODES = ("overwrite", "append")

# Table properties that let a Delta table hold any column name (fixed values).
_COLUMN_MAPPING = {
    "delta.columnMapping.mode": "name",
    "delta.minReaderVersion": "2",
    "delta.minWriterVersion": "5",
}
# Characters that such a table needs the properties for (fixed values).
_UNSAFE = re.compile(r"[ ,;{}()\[\]\t\n=]")


def needs_column_mapping(df: DataFrame) -> bool:
    """Whether a column name holds a space, bracket or another special character."""
    return any(_UNSAFE.search(c) for c in df.columns)


def write_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    fmt: str | None = None,
    partition_by: Sequence[str] = (),
    column_mapping: bool | None = None,
) -> None:
    """Save as a catalog table, replacing it (default) or appending by column name.

    Special characters in names need table properties where the format is Delta;
    parquet tables take them as they are.
    """
    _save_options(df, mode, fmt, partition_by, column_mapping).saveAsTable(name)


def write_path(
    df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    _save_options(df, mode, fmt, partition_by, None).save(path)


def merge_rows(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    sequence_by: str | None = None,
) -> DataFrame:
    """``target`` after the changes in ``source``: update where the key exists, else insert.

    Of several changes to a key the latest by ``sequence_by`` counts, and of those that
    tie the one with the smallest remaining columns.  The same holds against the stored
    row, so the result does not depend on how changes are cut into batches, and replayed
    or late batches do no harm.  Without ``sequence_by`` the batch always wins.

    State and changes meet in one shuffle by key, before which Spark drops all but the
    first row of a key in every task.
    """
    names = target.columns
    require(target, [*keys, *([sequence_by] if sequence_by else [])])
    require(source, names)
    both = target.withColumn(_NEW, F.lit(False)).unionByName(source.select(*cols(names)).withColumn(_NEW, F.lit(True)))
    return dedupe_by_key(both, keys, [sequence_by or _NEW]).drop(_NEW)


DELETED = "_deleted"
BUCKETS = 16
_BUCKET, _NEW = "__bucket", "__new"
_DATA, _PENDING = "buckets=", "_pending"


def upsert(
    spark: SparkSession,
    source: DataFrame,
    target: str,
    keys: Sequence[str],
    sequence_by: str | None = None,
    delete_when: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Apply changes to the parquet table at path ``target``; returns the new state.

    A change for which ``delete_when`` (an expression) holds hides its row.  The row
    stays stored with its sequence, so that an older change arriving late cannot
    bring it back.

    The table is partitioned by a hash of the keys into ``buckets``, which the first
    call fixes.  A batch reads and replaces only the buckets that it has keys of; the
    files of all others stay.  Choose so many that a bucket is a few files.

    The new buckets are written beside the table first and then put in place.  If that is
    interrupted, the next call begins by finishing it, so a batch applies whole or, sent
    again, once more with the same result.  One writer at a time.  Readers may see a
    part of the buckets replaced while a call runs.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    _finish(spark, target)
    gone = F.coalesce(F.expr(delete_when), F.lit(False)) if delete_when else F.lit(False)
    changes = source.withColumn(DELETED, gone)
    held = _bucket_count(spark, target)
    changes = changes.withColumn(_BUCKET, F.pmod(F.xxhash64(*cols(keys)), F.lit(held or buckets)).cast("int"))
    if held is None:
        if changes.isEmpty():
            return source.limit(0)  # no table yet
        new = dedupe_by_key(changes, keys, [sequence_by] if sequence_by else [])
    else:
        hit = [r[0] for r in changes.select(_BUCKET).distinct().collect()]  # at most one per bucket
        if not hit:
            return read_latest(spark, target)
        stored = spark.read.parquet(f"{target}/{_DATA}{held}")
        new = merge_rows(changes, stored.where(F.col(_BUCKET).isin(hit)), keys, sequence_by)
    pending = f"{target}/{_PENDING}/{_DATA}{held or buckets}"
    # Rebalanced by bucket: about one file each, several where a bucket is large.
    new.hint("rebalance", F.col(_BUCKET)).write.mode("overwrite").partitionBy(_BUCKET).parquet(pending)
    _finish(spark, target)
    return read_latest(spark, target)


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The current state of a table kept by ``upsert``."""
    held = _bucket_count(spark, target)
    if held is None:
        raise ValueError(f"no table at {target}")
    stored = spark.read.parquet(f"{target}/{_DATA}{held}")
    return stored.where(~F.col(DELETED)).drop(DELETED, _BUCKET)


def _finish(spark: SparkSession, target: str) -> None:
    """Put completely written buckets in place and forget them; incomplete ones are dropped."""
    files, path = _files(spark, target)
    pending = path(f"{target}/{_PENDING}")
    if not files.exists(pending):
        return
    for status in files.listStatus(pending):
        name = status.getPath().getName()
        if files.exists(path(f"{target}/{_PENDING}/{name}/_SUCCESS")):
            writer = spark.read.parquet(f"{target}/{_PENDING}/{name}").write.mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(f"{target}/{name}")
    files.delete(pending, True)


def _bucket_count(spark: SparkSession, target: str) -> int | None:
    files, path = _files(spark, target)
    if not files.exists(path(target)):
        return None
    names = [s.getPath().getName() for s in files.listStatus(path(target))]
    return next((int(n[len(_DATA) :]) for n in names if n.startswith(_DATA)), None)


def _files(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _save_options(df, mode, fmt, partition_by, column_mapping):
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}, not {mode!r}; for updates see upsert")
    writer = df.write.mode(mode)
    if fmt:
        writer = writer.format(fmt)
    wanted = needs_column_mapping(df) if column_mapping is None else column_mapping
    if wanted and fmt == "delta":
        writer = writer.options(**_COLUMN_MAPPING)
    return writer.partitionBy(*partition_by) if partition_by else writer
