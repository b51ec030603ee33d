"""Bulk cleansing of text and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.naming import col, require

_CASES = {"upper": F.upper, "lower": F.lower, "title": F.initcap}


def cleanse(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    trim: bool = False,
    collapse_whitespace: bool = False,
    remove_all_whitespace: bool = False,
    nulls_to_blank: bool = False,
    numeric_nulls_to_zero: bool = False,
    case: str | None = None,
) -> DataFrame:
    """Cleanse the given columns (all by default) in a single projection.

    Text steps run on string columns in a fixed order: trim, collapse runs of
    whitespace, remove whitespace, case, NULL to ``''``.  Numeric NULLs become 0.
    """
    if case is not None and case not in _CASES:
        raise ValueError(f"case must be one of {sorted(_CASES)}, not {case!r}")
    names = list(df.columns if columns is None else columns)
    require(df, names)

    steps = []
    if trim:
        steps.append(F.trim)
    if collapse_whitespace:
        steps.append(lambda c: F.regexp_replace(c, r"\s+", " "))
    if remove_all_whitespace:
        steps.append(lambda c: F.regexp_replace(c, r"\s", ""))
    if case:
        steps.append(_CASES[case])
    if nulls_to_blank:
        steps.append(lambda c: F.coalesce(c, F.lit("")))

    changed: dict[str, Column] = {}
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType) and steps:
            value = col(name)
            for step in steps:
                value = step(value)
            changed[name] = value
        elif isinstance(kind, T.NumericType) and numeric_nulls_to_zero:
            changed[name] = F.coalesce(col(name), F.lit(0).cast(kind))
    return df.withColumns(changed) if changed else df
