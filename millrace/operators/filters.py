"""Filters with a true and a false stream."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.naming import expression


class SplitOut(NamedTuple):
    true: DataFrame
    false: DataFrame


def filter_true(df: DataFrame, condition: Column | str | None = None) -> DataFrame:
    """Rows for which the condition holds; no condition keeps everything."""
    return df if condition is None else df.where(expression(condition))


def filter_false(df: DataFrame, condition: Column | str, nulls: str = "drop") -> DataFrame:
    """Rows for which the condition is false.

    A NULL condition is neither true nor false: ``nulls="drop"`` leaves such rows
    out of both streams, ``nulls="false"`` counts them as false.
    """
    if nulls not in ("drop", "false"):
        raise ValueError(f"nulls must be 'drop' or 'false', not {nulls!r}")
    holds = expression(condition)
    return df.where(~holds if nulls == "drop" else ~F.coalesce(holds, F.lit(False)))


def split(df: DataFrame, condition: Column | str, nulls: str = "drop") -> SplitOut:
    """Both streams, lazily; ``nulls="false"`` makes them a partition of the input."""
    return SplitOut(filter_true(df, condition), filter_false(df, condition, nulls))
