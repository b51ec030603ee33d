"""Column references, column lists and sort keys shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OrderBy = Sequence[str | tuple[str, bool]]
"""Sort keys: a column name (ascending) or ``(name, descending)``."""


def quote(name: str) -> str:
    """Back-tick a column name, which may hold spaces, dots and brackets."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def expression(value: Column | str) -> Column:
    """A Column as it is; a string as a Spark SQL expression."""
    return F.expr(value) if isinstance(value, str) else value


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {missing}; have {df.columns}")


def all_equal(pairs: Iterable[tuple[Column, Column]], null_safe: bool = True) -> Column:
    """Conjunction of equalities, with NULL equal to NULL unless told otherwise."""
    condition = F.lit(True)
    for i, (a, b) in enumerate(pairs):
        clause = a.eqNullSafe(b) if null_safe else a == b
        condition = clause if i == 0 else condition & clause
    return condition


def sortable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return sortable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(sortable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def sort_keys(df: DataFrame, order_by: OrderBy, tie_break: bool = True, reverse: bool = False) -> list[Column]:
    """Sort expressions for ``order_by``; NULLs come first ascending, last descending.

    ``tie_break`` appends every other sortable column, which makes the order the
    same on every run and lets a range partitioning split a repeated key.
    """
    wanted = [(k, False) if isinstance(k, str) else k for k in order_by]
    require(df, [name for name, _ in wanted])
    named = {name for name, _ in wanted}
    if tie_break:
        wanted += [(f.name, False) for f in df.schema.fields if f.name not in named and sortable(f.dataType)]
    return [col(n).desc() if desc != reverse else col(n).asc() for n, desc in wanted]


def row_hash(df: DataFrame, but: Iterable[str] = ()) -> Column:
    """A fixed-width stand-in for all columns but ``but``, for range keys that Spark samples to the driver."""
    left = set(but)
    hashed = [col(f.name) for f in df.schema.fields if f.name not in left and sortable(f.dataType)]
    return F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")


def order_names(order_by: OrderBy) -> list[str]:
    return [k if isinstance(k, str) else k[0] for k in order_by]
