"""Computed columns: one formula after another, or one over many fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.naming import col, expression, quote, require

Formula = tuple[str, Column | str] | tuple[str, Column | str, str]


def with_formulas(df: DataFrame, formulas: Sequence[Formula]) -> DataFrame:
    """Add or replace columns in order; a later formula sees the earlier results.

    Each item is ``(name, expression)`` or ``(name, expression, cast_type)``.
    """
    out = df
    for name, value, *cast in formulas:
        computed = expression(value)
        out = out.withColumn(name, computed.cast(cast[0]) if cast else computed)
    return out


def multi_field(
    df: DataFrame,
    fields: Sequence[str],
    template: str | Callable[[Column, Column], Column],
    prefix: str | None = None,
    cast: str | None = None,
) -> DataFrame:
    """Apply one formula to several fields, in place or into ``prefix + field``.

    A string template is Spark SQL with ``{current}`` for the field and ``{name}``
    for its name as a string literal; a callable gets both as Columns.  Every
    field is computed from the input, in one projection.
    """
    require(df, fields)
    computed = {}
    for field in fields:
        if callable(template):
            value = template(col(field), F.lit(field))
        else:
            literal = "'" + field.replace("\\", "\\\\").replace("'", "\\'") + "'"
            value = F.expr(template.replace("{current}", quote(field)).replace("{name}", literal))
        computed[f"{prefix or ''}{field}"] = value.cast(cast) if cast else value
    return df.withColumns(computed)
