"""Wide to long and long to wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.naming import col, cols, require
from millrace.operators.summarize import Agg, summarize

_CROSS_TAB_FUNCS = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "countDistinct": F.count_distinct,
}


def transpose(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str] | None = None,
    cast: str | None = None,
    name: str = "Name",
    value: str = "Value",
) -> DataFrame:
    """One row per value column: the keys, the column's name and its value.

    The value columns are cast to one type: ``cast``, or string where they differ.
    """
    values = [c for c in df.columns if c not in keys] if values is None else list(values)
    require(df, [*keys, *values])
    kinds = {df.schema[v].dataType.simpleString() for v in values}
    target = cast or (kinds.pop() if len(kinds) == 1 else "string")
    narrowed = df.select(*cols(keys), *[col(v).cast(target).alias(v) for v in values])
    return narrowed.unpivot(cols(keys), cols(values), name, value)


def cross_tab(
    df: DataFrame,
    keys: Sequence[str],
    header: str,
    value: str,
    func: str = "sum",
    headers: Sequence[object] | None = None,
    order_by: Sequence[str] = (),
    sep: str = ",",
) -> DataFrame:
    """One row per key, one column per header value, aggregated with ``func``.

    Give ``headers`` where they are known: it fixes the columns and saves the job
    that lists them; without, more of them than ``spark.sql.pivotMaxValues`` (10 000)
    are an error.  ``first``, ``last`` and ``concat`` (with ``sep``) follow ``order_by``.
    """
    require(df, [*keys, header, value])
    if func == "concat":
        # every cell's text is put together first, which divides the rows of a large cell
        df = summarize(df, [*keys, header], [Agg(value, "concat", "__cell", tuple(order_by), sep)])
        value, func = "__cell", "max"
    return df.groupBy(*cols(keys)).pivot(header, list(headers) if headers is not None else None).agg(
        _cell(value, func, order_by)
    )


def _cell(value: str, func: str, order_by: Sequence[str]) -> Column:
    if func in ("first", "last"):
        if not order_by:
            raise ValueError(f"{func} needs order_by")
        pick = F.min_by if func == "first" else F.max_by
        return pick(col(value), F.struct(*cols(order_by), col(value).alias("__value")))
    if func not in _CROSS_TAB_FUNCS:
        raise ValueError(f"unknown cross tab function {func!r}")
    return _CROSS_TAB_FUNCS[func](col(value))
