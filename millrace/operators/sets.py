"""Union, unique and duplicate streams, multiset difference."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.naming import OrderBy, cols, require, sort_keys
from millrace.operators.positions import HOT_ROWS, POSITION, in_ordered_groups

_COPIES_PER_TASK_ROW = 10_000


class UniqueOut(NamedTuple):
    unique: DataFrame
    duplicates: DataFrame


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column one of them lacks is NULL there."""
    if not frames:
        raise ValueError("union_all needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unique(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    order_by: OrderBy = (),
    hot_rows: int | None = HOT_ROWS,
) -> UniqueOut:
    """First row per key, and all the later ones; together they are the input.

    Without keys whole rows are compared.  Which row comes first is decided by
    ``order_by`` and then by the remaining columns, never by chance.
    """
    all_columns = not keys
    keys = list(df.columns if all_columns else keys)
    require(df, keys)
    if all_columns:
        return UniqueOut(df.dropDuplicates(), _surplus_copies(df))
    order = sort_keys(df, order_by) or [F.lit(0).asc()]
    first = Window.partitionBy(*cols(keys)).orderBy(*order)

    def later(part: DataFrame, window: WindowSpec) -> DataFrame:
        return part.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") > 1).drop("__rank")

    def later_by_position(rows: DataFrame, block_rows: int) -> DataFrame:
        return rows.where(F.col(POSITION) > 0)

    return UniqueOut(
        df.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") == 1).drop("__rank"),
        in_ordered_groups(df, keys, order, later, later_by_position, hot_rows),
    )


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` left after removing each row of ``b`` once (multiset difference)."""
    names = a.columns
    require(b, names)
    sides = a.select(*cols(names), F.lit(1).alias("__n")).unionAll(b.select(*cols(names), F.lit(-1).alias("__n")))
    surplus = sides.groupBy(*cols(names)).agg(F.sum("__n").alias("__n")).where(F.col("__n") > 0)
    return _repeat(surplus, names)


def _surplus_copies(df: DataFrame) -> DataFrame:
    counted = df.groupBy(*cols(df.columns)).agg((F.count(F.lit(1)) - 1).alias("__n")).where(F.col("__n") > 0)
    return _repeat(counted, df.columns)


def _repeat(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Write each row out ``__n`` times, sharing the copies of one row among tasks."""
    size = _COPIES_PER_TASK_ROW
    shares = counted.withColumn("__share", F.explode(F.expr(f"sequence(0L, (__n - 1) div {size})")))
    spread = shares.repartition(*cols(names), F.col("__share"))
    copies = F.expr(f"cast(least({size}L, __n - __share * {size}L) as int)")
    return spread.select(*cols(names), F.explode(F.array_repeat(F.lit(1), copies)).alias("__copy")).drop("__copy")
