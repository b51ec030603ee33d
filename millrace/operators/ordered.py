"""Operators that look along the order of rows inside a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.naming import OrderBy, col, cols, expression, order_names, require, row_hash, sort_keys
from millrace.operators.positions import (
    BLOCK,
    HOT_ROWS,
    POSITION,
    block_window,
    carry_into_blocks,
    in_ordered_groups,
    numbered,
    with_block,
)

RowRef = Callable[..., Column]


def multi_row(
    df: DataFrame,
    field: str,
    formula: Callable[[RowRef], Column | str],
    group_by: Sequence[str] = (),
    order_by: OrderBy = (),
    tie_break: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Compute ``field`` from neighbouring rows; rows outside the group count as NULL.

    ``formula`` receives ``row(offset, column)``: ``row(-1, "x")`` is x one row
    earlier, ``row(2, "x")`` two rows later.  Example:
    ``multi_row(df, "step", lambda row: F.col("x") - row(-1, "x"), ["k"], ["ts"])``.
    """
    if not order_by:
        raise ValueError("multi_row needs order_by")
    require(df, group_by)
    order = sort_keys(df, order_by, tie_break)

    def value(window: WindowSpec, reach: list[int]) -> Column:
        def row(offset: int, name: str) -> Column:
            reach.append(abs(offset))
            return F.lag(col(name), -offset).over(window) if offset < 0 else F.lead(col(name), offset).over(window)

        return expression(formula(row))

    def on_window(part: DataFrame, window: WindowSpec) -> DataFrame:
        return part.withColumn(field, value(window, []))

    def on_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
        reach: list[int] = []
        computed = value(Window.partitionBy(*cols(group_by), F.col(BLOCK)).orderBy(POSITION), reach)
        span = max(reach, default=0)
        length = max(block_rows, span, 1)
        home = F.expr(f"{POSITION} div {length}")
        at = F.expr(f"{POSITION} % {length}")
        # the edge rows of each block are also visible to the block next to it
        visible = F.array(
            home, F.when(at < span, home - 1), F.when(at >= length - span, home + 1)
        )
        seen = rows.withColumn(BLOCK, F.explode(F.array_compact(visible)))
        return seen.withColumn(field, computed).where(F.col(BLOCK) == home)

    return in_ordered_groups(df, group_by, order, on_window, on_blocks, hot_rows)


def row_delta(
    df: DataFrame,
    column: str,
    group_by: Sequence[str],
    order_by: OrderBy,
    alias: str | None = None,
    tie_break: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Difference to the previous row of the group; NULL on its first row."""
    return multi_row(
        df,
        alias or f"{column}_delta",
        lambda row: col(column) - row(-1, column),
        group_by,
        order_by,
        tie_break,
        hot_rows,
    )


def running_total(
    df: DataFrame,
    column: str,
    group_by: Sequence[str],
    order_by: OrderBy,
    alias: str | None = None,
    tie_break: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Cumulative sum along the order, NULLs skipped.

    Longs and decimals are exact.  The last bits of doubles depend on the order of
    additions, which differs beyond ``hot_rows``: sum decimals where they matter.
    """
    name = alias or f"RunTot_{column}"
    order = sort_keys(df, order_by, tie_break)

    def on_window(part: DataFrame, window: WindowSpec) -> DataFrame:
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return part.withColumn(name, F.sum(col(column)).over(frame))

    def on_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
        return sum_over_blocks(rows, column, group_by, block_rows, name)

    return in_ordered_groups(df, group_by, order, on_window, on_blocks, hot_rows)


def sum_over_blocks(
    rows: DataFrame, column: str, group_by: Sequence[str], block_rows: int, name: str
) -> DataFrame:
    """The cumulative sum over rows with positions: each block adds its own to what earlier blocks carry."""
    frame = block_window(group_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = carry_into_blocks(
        with_block(rows, block_rows),
        group_by,
        F.sum(col(column)),
        lambda total, earlier: F.sum(total).over(earlier),
        "__before",
    )
    inside = F.sum(col(column)).over(frame)
    kind = rows.select(F.sum(col(column)).alias("s")).schema["s"].dataType
    total = F.coalesce(inside + F.col("__before"), inside, F.col("__before")).cast(kind)
    return carried.withColumn(name, total).drop("__before")


def fill_down(
    df: DataFrame,
    column: str,
    group_by: Sequence[str],
    order_by: OrderBy,
    alias: str | None = None,
    tie_break: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Replace NULL by the last value seen above it in the group."""
    name = alias or column
    order = sort_keys(df, order_by, tie_break)

    def on_window(part: DataFrame, window: WindowSpec) -> DataFrame:
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return part.withColumn(name, F.last(col(column), ignorenulls=True).over(frame))

    def on_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
        frame = block_window(group_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        carried = carry_into_blocks(
            with_block(rows, block_rows),
            group_by,
            F.max_by(col(column), F.when(col(column).isNotNull(), F.col(POSITION))),
            lambda last, earlier: F.last(last, ignorenulls=True).over(earlier),
            "__before",
        )
        inside = F.last(col(column), ignorenulls=True).over(frame)
        return carried.withColumn(name, F.coalesce(inside, F.col("__before"))).drop("__before")

    return in_ordered_groups(df, group_by, order, on_window, on_blocks, hot_rows)


def record_id(
    df: DataFrame,
    column: str = "RecordID",
    order_by: OrderBy = (),
    start: int = 1,
    tie_break: bool = True,
    rows_per_partition: int = HOT_ROWS,
) -> DataFrame:
    """Dense ids ``start, start + 1, ...`` over the whole table in ``order_by``.

    Rows are range-partitioned and numbered per partition; no task sees the whole
    table, unlike ``row_number()`` over an unpartitioned window.  With ``tie_break``
    rows that tie are ordered by a hash of their other columns, then by these.
    """
    if not order_by:
        raise ValueError("record_id needs order_by; use row_tag where any unique id will do")
    keys = sort_keys(df, order_by, tie_break=False)
    dealt = [*keys, row_hash(df, order_names(order_by))] if tie_break else keys
    order = [*dealt, *sort_keys(df, order_by, tie_break)[len(keys) :]]
    rows = numbered(df, [], order, df.count(), rows_per_partition, dealt)
    return rows.withColumn(column, F.col(POSITION) + F.lit(start).cast("long")).drop(POSITION)


def row_tag(df: DataFrame, column: str = "RowTag") -> DataFrame:
    """A unique but not dense id; costs no shuffle.

    The ids follow the layout of the input: write the result down before using it twice.
    """
    return df.withColumn(column, F.monotonically_increasing_id())


def dedupe_by_key(
    df: DataFrame, keys: Sequence[str], order_by: str | OrderBy, descending: bool = True
) -> DataFrame:
    """Keep one row per key: the latest by ``order_by``, or the earliest.

    ``row_number() = 1`` lets Spark drop the losers before the shuffle, so a
    repeated key costs one row per input task.
    """
    wanted = [order_by] if isinstance(order_by, str) else list(order_by)
    ranked = [(k, descending) if isinstance(k, str) else k for k in wanted]
    window = Window.partitionBy(*cols(keys)).orderBy(*sort_keys(df, ranked))
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") == 1).drop("__rank")
