"""Gold tables refreshed from new rows only, by partial states that merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.naming import all_equal, col, cols, require
from millrace.session import materialize

COMPACT_AFTER = 16
"""Batches whose states are kept apart before they are merged into one."""

_SIGN, _BATCH, _ROWS = "__sign", "__batch", "__rows"
_PARTS = ("sum", "count", "min", "max", "gone_min", "gone_max")


def refresh_gold(
    source: DataFrame,
    base: str,
    keys: Sequence[str],
    values: Sequence[str],
    delete_when: str | None = None,
    compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Take in what has arrived at the stream ``source`` since the last run, then stop.

    Below the folder ``base`` every batch lands twice under its number: its rows in
    ``bronze`` and one partial state per group in ``states``. A batch sent again after a
    failure replaces its own folders, so it counts once. Earlier rows are not read, except
    as told for ``read_gold``. States of ``compact_after`` batches are merged into one.

    A row for which ``delete_when`` holds takes back an earlier row, whose keys and values
    it repeats. One writer at a time, and no reader during a run.
    """
    if compact_after < 1:
        raise ValueError("compact_after must be at least 1")
    require(source, [*keys, *values])
    gone = F.coalesce(F.expr(delete_when), F.lit(False)) if delete_when else F.lit(False)

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        landed = f"{base}/bronze/{_BATCH}={number}"
        signed = batch.withColumn(_SIGN, F.when(gone, F.lit(-1)).otherwise(F.lit(1)).cast("long"))
        signed.write.mode("overwrite").parquet(landed)
        rows = spark.read.schema(signed.schema).parquet(landed)
        _partial(rows, keys, values).write.mode("overwrite").parquet(f"{base}/states/batch={number}")
        whole, single = _state_folders(spark, base)
        if len(single) >= compact_after:
            merged = _settled(spark, base, keys, values, whole, single)
            merged.write.mode("overwrite").parquet(f"{base}/states/upto={number}")
            files, path = _files(spark, base)
            for name in [f"upto={n}" for n in whole] + [f"batch={n}" for n in single]:
                files.delete(path(f"{base}/states/{name}"), True)

    writer = source.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/checkpoint")
    return writer.trigger(availableNow=True).start()


def read_gold(spark: SparkSession, base: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The keys, ``row_count``, and per value column its ``sum_``, ``count_``, ``min_`` and ``max_``.

    NULL keys are a group, NULL values are skipped, sums of columns that
    are no numbers are NULL, groups without rows are left out. Where
    the smallest or largest value of a group was taken back, the extremes of that group, and of no
    other, are counted again from the bronze rows.
    """
    whole, single = _state_folders(spark, base)
    if not whole and not single:
        raise ValueError(f"no states at {base}")
    settled = _settled(spark, base, keys, values, whole, single).where(F.col(_ROWS) > 0)
    shown = [F.col(_ROWS).alias("row_count")]
    for i, v in enumerate(values):
        shown += [
            F.when(F.col(f"__count_{i}") > 0, F.col(f"__sum_{i}")).alias(f"sum_{v}"),
            *[F.col(f"__{p}_{i}").alias(f"{p}_{v}") for p in ("count", "min", "max")],
        ]
    return settled.select(*cols(keys), *shown)


def _partial(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    added, sign = F.col(_SIGN) > 0, F.col(_SIGN)
    parts = [F.sum(sign).alias(_ROWS)]
    for i, v in enumerate(values):
        x = col(v)
        kind = rows.schema[v].dataType
        if isinstance(kind, T.NumericType):
            total = F.sum(F.when(added, x).otherwise(-x))
        else:
            total = F.lit(None).cast("long")
        if isinstance(kind, T.DecimalType):  # the type that sums of sums keep
            total = total.cast(T.DecimalType(38, kind.scale))
        parts += [
            total.alias(f"__sum_{i}"),
            F.coalesce(F.sum(F.when(x.isNotNull(), sign)), F.lit(0).cast("long")).alias(f"__count_{i}"),
            F.min(F.when(added, x)).alias(f"__min_{i}"),
            F.max(F.when(added, x)).alias(f"__max_{i}"),
            F.min(F.when(~added, x)).alias(f"__gone_min_{i}"),
            F.max(F.when(~added, x)).alias(f"__gone_max_{i}"),
        ]
    return rows.groupBy(*cols(keys)).agg(*parts)


def _settled(spark, base, keys, values, whole, single) -> DataFrame:
    """All states merged, with extremes that no deletion has touched or that were counted again."""
    folders = [f"{base}/states/upto={n}" for n in whole[-1:]] + [f"{base}/states/batch={n}" for n in single]
    last = max([*whole[-1:], *single])
    states = spark.read.parquet(folders[0])
    states = spark.read.schema(states.schema).parquet(*folders)
    adding = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "gone_min": F.min, "gone_max": F.max}
    parts = [F.sum(_ROWS).alias(_ROWS)]
    parts += [adding[p](f"__{p}_{i}").alias(f"__{p}_{i}") for i in range(len(values)) for p in _PARTS]
    merged = materialize(states.groupBy(*cols(keys)).agg(*parts))
    for i, v in enumerate(values):
        lost = (F.col(f"__gone_min_{i}") <= F.col(f"__min_{i}")) | (F.col(f"__gone_max_{i}") >= F.col(f"__max_{i}"))
        touched = merged.where(lost)
        if not touched.isEmpty():
            merged = _with_extremes(merged, _recount(spark, base, keys, v, touched, last), keys, i, lost)
        none = {f"__{p}_{i}": F.lit(None).cast(merged.schema[f"__{p}_{i}"].dataType) for p in ("gone_min", "gone_max")}
        merged = merged.withColumns(none)
    return merged


def _recount(spark, base, keys, value, touched: DataFrame, last: int) -> DataFrame:
    """The extremes of the touched groups among the bronze rows that are still there."""
    bronze = spark.read.parquet(f"{base}/bronze").where(F.col(_BATCH) <= last)
    named = {k: f"__key_{i}" for i, k in enumerate(keys)}
    groups = touched.select(*[col(k).alias(a) for k, a in named.items()])
    rows = bronze.join(groups, _same(named), "left_semi").select(
        *[col(k).alias(a) for k, a in named.items()], col(value).alias("__value"), _SIGN
    )
    left = rows.groupBy(*named.values(), "__value").agg(F.sum(_SIGN).alias("__left")).where("__left > 0")
    return left.groupBy(*named.values()).agg(F.min("__value").alias("__low"), F.max("__value").alias("__high"))


def _with_extremes(merged: DataFrame, counted: DataFrame, keys, i: int, lost: Column) -> DataFrame:
    named = {k: f"__key_{n}" for n, k in enumerate(keys)}
    joined = merged.join(counted, _same(named), "left")
    is_lost = F.coalesce(lost, F.lit(False))
    return joined.withColumns(
        {
            f"__min_{i}": F.when(is_lost, F.col("__low")).otherwise(F.col(f"__min_{i}")),
            f"__max_{i}": F.when(is_lost, F.col("__high")).otherwise(F.col(f"__max_{i}")),
        }
    ).drop(*named.values(), "__low", "__high")


def _same(named: dict[str, str]) -> Column:
    return all_equal((col(k), F.col(a)) for k, a in named.items())


def _state_folders(spark: SparkSession, base: str) -> tuple[list[int], list[int]]:
    """Numbers of the merged states and of the batches that came after the last of them."""
    files, path = _files(spark, base)
    if not files.exists(path(f"{base}/states")):
        return [], []
    names = [s.getPath().getName() for s in files.listStatus(path(f"{base}/states"))]
    whole_names = [n for n in names if files.exists(path(f"{base}/states/{n}/_SUCCESS"))]
    numbers = {p: sorted(int(n.partition("=")[2]) for n in whole_names if n.startswith(p)) for p in ("upto=", "batch=")}
    newest = max(numbers["upto="], default=-1)
    return numbers["upto="], [n for n in numbers["batch="] if n > newest]


def _files(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(base).getFileSystem(spark._jsc.hadoopConfiguration()), path
