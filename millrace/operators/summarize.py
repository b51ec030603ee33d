"""Group-by summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.naming import OrderBy, all_equal, col, cols, require, sort_keys
from millrace.operators.ordered import dedupe_by_key
from millrace.operators.positions import BLOCK, POSITION, numbered, split_by_group_size, with_block

CONCAT_ROWS = 100_000
"""Largest group whose strings are concatenated in one step."""


@dataclass(frozen=True)
class Agg:
    """One summary: ``func`` of ``column`` under the name ``alias``.

    ``order_by`` (ascending names) says what first, last and concat mean; rows that
    tie are ordered by the value itself.
    """

    column: str
    func: str
    alias: str | None = None
    order_by: tuple[str, ...] = ()
    sep: str = ","
    approx: bool = False

    @property
    def name(self) -> str:
        return self.alias or f"{self.func}_{self.column}"


def _count_distinct(a: Agg) -> Column:
    return F.approx_count_distinct(col(a.column)) if a.approx else F.count_distinct(col(a.column))


_FUNCS = {
    "sum": lambda a: F.sum(col(a.column)),
    "avg": lambda a: F.avg(col(a.column)),
    "min": lambda a: F.min(col(a.column)),
    "max": lambda a: F.max(col(a.column)),
    "count": lambda a: F.count(col(a.column)),
    "stddev": lambda a: F.stddev(col(a.column)),
    "std": lambda a: F.stddev(col(a.column)),
    "variance": lambda a: F.variance(col(a.column)),
    "var": lambda a: F.variance(col(a.column)),
    "countDistinct": _count_distinct,
    "first": lambda a: F.min_by(col(a.column), _rank(a)),
    "last": lambda a: F.max_by(col(a.column), _rank(a)),
}


def summarize(
    df: DataFrame,
    group_by: Sequence[str | tuple[str, str]],
    aggs: Sequence[Agg],
    concat_rows: int | None = CONCAT_ROWS,
) -> DataFrame:
    """Aggregate per group; no group columns give one row for the whole table.

    Group columns may be renamed with ``(column, alias)``.  Everything but
    ``concat`` is a partial aggregation, which absorbs hot keys before the shuffle.
    """
    keys = dict((k, k) if isinstance(k, str) else k for k in group_by)
    require(df, [*keys, *[a.column for a in aggs]])
    unknown = [a.func for a in aggs if a.func not in _FUNCS and a.func != "concat"]
    if unknown:
        raise ValueError(f"unknown summary functions: {unknown}")
    unordered = [a.name for a in aggs if a.func in ("first", "last", "concat") and not a.order_by]
    if unordered:
        raise ValueError(f"first, last and concat need order_by: {unordered}")

    if any(a.func == "concat" for a in aggs) and not _all_small(df, list(keys), concat_rows):
        return _with_split_concat(df, keys, aggs, concat_rows)
    computed = [(_concat(a) if a.func == "concat" else _FUNCS[a.func](a)).alias(a.name) for a in aggs]
    return df.groupBy(*[col(k).alias(name) for k, name in keys.items()]).agg(*computed)


def count_records(df: DataFrame) -> DataFrame:
    """One row, one column ``Count``."""
    return df.agg(F.count(F.lit(1)).alias("Count"))


def latest_by(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The latest row per key; of rows that tie the one with the largest remaining columns."""
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    return dedupe_by_key(df, keys, [*order_by, *rest])


def category_counts(df: DataFrame, category: str, alias: str = "count") -> DataFrame:
    """Rows per category, most frequent first (ties by category)."""
    counts = df.groupBy(col(category)).agg(F.count(F.lit(1)).alias(alias))
    return counts.orderBy(col(alias).desc(), col(category).asc())


def _rank(a: Agg) -> Column:
    return F.struct(*[col(n).alias(f"o{i}") for i, n in enumerate(a.order_by)], col(a.column).alias("v"))


def _concat(a: Agg) -> Column:
    """Join the non-NULL values in order; NULL when there are none."""
    kept = F.collect_list(F.when(col(a.column).isNotNull(), _rank(a)))
    parts = F.transform(F.array_sort(kept), lambda r: r["v"].cast("string"))
    return F.when(F.count(col(a.column)) > 0, F.array_join(parts, a.sep))


def _all_small(df: DataFrame, keys: Sequence[str], limit: int | None) -> bool:
    if limit is None:
        return True
    sizes = df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("__size"))
    return sizes.where(F.col("__size") > limit).isEmpty()


def _with_split_concat(df, keys, aggs, limit):
    """Concatenate hot groups block by block; only the finished text meets in one row."""
    others = [a for a in aggs if a.func != "concat"]
    if others:
        out = summarize(df, list(keys.items()), others, None)
    elif keys:
        out = df.select(*[col(k).alias(name) for k, name in keys.items()]).distinct()
    else:
        out = count_records(df)
    for a in (a for a in aggs if a.func == "concat"):
        text = _concat_blocks(df, list(keys), a, limit)
        named = {k: f"__concat_{i}" for i, k in enumerate(keys)}
        text = text.select(*[col(k).alias(n) for k, n in named.items()], F.col("__text").alias(a.name))
        same = all_equal((col(keys[k]), F.col(n)) for k, n in named.items())
        out = out.join(text, same, "left").drop(*named.values())
    return out.select(*cols(keys.values()), *cols(a.name for a in aggs))


def _concat_blocks(df: DataFrame, keys: Sequence[str], a: Agg, limit: int) -> DataFrame:
    used = list(dict.fromkeys([*keys, *a.order_by, a.column]))
    narrow = df.select(*cols(used)).where(col(a.column).isNotNull())
    parts = split_by_group_size(narrow, keys, limit)
    texts = []
    if parts.cold is not None:
        texts.append(parts.cold.groupBy(*cols(keys)).agg(_concat(a).alias("__text")))
    if parts.hot is not None:
        order: OrderBy = [*a.order_by, *([] if a.column in a.order_by else [a.column])]
        rows = numbered(parts.hot, keys, sort_keys(narrow, order, tie_break=False), parts.hot_rows, limit)
        inside = Agg(a.column, "concat", "text", (POSITION,), a.sep)
        blocks = with_block(rows, limit).groupBy(*cols(keys), F.col(BLOCK)).agg(_concat(inside).alias("text"))
        whole = Agg("text", "concat", "text", (BLOCK,), a.sep)
        texts.append(blocks.groupBy(*cols(keys)).agg(_concat(whole).alias("__text")))
    return texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1])


