"""Sorting, first/last rows and random samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.naming import OrderBy, cols, order_names, require, row_hash, sort_keys
from millrace.operators.positions import HOT_ROWS, POSITION, in_ordered_groups, numbered

_TOP_K = 10_000  # up to here every task's first N go to one; beyond, rows are numbered
_GROUP_TOP_K = 1000  # up to here Spark trims groups before the shuffle


def sort(df: DataFrame, order_by: OrderBy, tie_break: bool = True) -> DataFrame:
    """Total sort; NULLs first ascending, last descending.

    With ``tie_break`` rows that tie are ordered by a hash of their other columns, then
    by these; so a value held by a third of the rows spreads over many range
    partitions, and no text is a range key.
    """
    if not order_by:
        return df
    keys = sort_keys(df, order_by, tie_break=False)
    if not tie_break:
        return df.orderBy(*keys)
    dealt = [*keys, row_hash(df, order_names(order_by))]
    return df.repartitionByRange(*dealt).sortWithinPartitions(*dealt, *sort_keys(df, order_by)[len(keys) :])


def sample(
    df: DataFrame,
    n: int,
    how: str = "first",
    order_by: OrderBy = (),
    group_by: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The first or last ``n`` rows, overall or of every group."""
    if how not in ("first", "last"):
        raise ValueError(f"how must be 'first' or 'last', not {how!r}")
    if not order_by:
        raise ValueError("sample needs order_by; use sample_fraction for a random share")
    order = sort_keys(df, order_by, reverse=how == "last")
    if not group_by:
        if n <= _TOP_K:
            return df.orderBy(*order).limit(n)
        first = numbered(df, [], order, df.count()).where(F.col(POSITION) < n).drop(POSITION)
        return first.orderBy(*order)

    def on_window(part: DataFrame, window: WindowSpec) -> DataFrame:
        ranked = part.withColumn("__rank", F.row_number().over(window))
        return ranked.where(F.col("__rank") <= n).drop("__rank")

    def on_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
        return rows.where(F.col(POSITION) < n)

    if n <= _GROUP_TOP_K:
        return on_window(df, Window.partitionBy(*cols(group_by)).orderBy(*order))
    return in_ordered_groups(df, group_by, order, on_window, on_blocks, hot_rows)


def sample_fraction(df: DataFrame, fraction: float, key_columns: Sequence[str], seed: int = 0) -> DataFrame:
    """A random share chosen by a hash of the key, the same under any partitioning."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    bucket = F.pmod(F.xxhash64(F.lit(seed).cast("long"), *cols(key_columns)), F.lit(1_000_000))
    return df.where(bucket < round(fraction * 1_000_000))


def sample_exact(
    df: DataFrame,
    n: int,
    key: Sequence[str],
    seed: int = 0,
    group_by: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Exactly ``n`` random rows (all, if fewer), overall or of every group.

    The rows with the smallest MD5 of the seed and their ``key`` columns: the same rows however the table is laid
    out, and as likely as any others.  Up to 10 000 rows (1000 per group) every task keeps only its own smallest;
    beyond, rows are numbered by range, so that no task sorts a large group.  Rows of one key rank by their other
    columns.  A table that is drawn from twice with one seed gives the smaller sample inside the larger.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    require(df, [*key, *group_by])
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols(key)])
    drawn = df.withColumn(_DRAW, F.md5(text))
    return sample(drawn, n, order_by=[_DRAW], group_by=group_by, hot_rows=hot_rows).drop(_DRAW)


_DRAW = "__draw"
