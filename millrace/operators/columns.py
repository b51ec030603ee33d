"""Choosing, renaming, casting and standardising columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.naming import col, require


@dataclass(frozen=True)
class Col:
    """One line of a column selection."""

    name: str
    rename: str | None = None
    cast: str | None = None
    drop: bool = False

    @property
    def target(self) -> str:
        return self.rename or self.name


# Source field types and the Spark type each becomes (fixed values).
SPARK_TYPES = {
    "Bool": "boolean",
    "Byte": "tinyint",
    "Int16": "smallint",
    "Int32": "int",
    "Int64": "bigint",
    "Float": "float",
    "Double": "double",
    "String": "string",
    "V_String": "string",
    "WString": "string",
    "V_WString": "string",
    "Date": "date",
    "DateTime": "timestamp",
    "Time": "string",
}


def spark_type(source_type: str, precision: int | None = None, scale: int | None = None) -> str:
    """Spark type for a source field type; decimals must say their precision and scale."""
    if source_type == "FixedDecimal":
        if precision is None or scale is None:
            raise ValueError("FixedDecimal needs precision and scale")
        return f"decimal({precision},{scale})"
    if source_type not in SPARK_TYPES:
        raise ValueError(f"unknown field type {source_type!r}")
    return SPARK_TYPES[source_type]


def select_columns(
    df: DataFrame, columns: Sequence[Col | str], keep_rest: bool = False, on_error: str = "fail"
) -> DataFrame:
    """Keep, rename, cast and drop columns in one projection.

    Listed columns come in the order given; ``keep_rest`` then passes every
    unlisted column through.  ``on_error="null"`` turns failing casts into NULL.
    """
    if on_error not in ("fail", "null"):
        raise ValueError(f"on_error must be 'fail' or 'null', not {on_error!r}")
    listed = [Col(c) if isinstance(c, str) else c for c in columns]
    require(df, [c.name for c in listed])
    picked = [_projected(c, on_error) for c in listed if not c.drop]
    targets = [c.target for c in listed if not c.drop]
    if keep_rest:
        named = {c.name for c in listed}
        rest = [n for n in df.columns if n not in named]
        picked += [col(n) for n in rest]
        targets += rest
    _no_repeats(targets)
    return df.select(*picked)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return select_columns(df, [Col(n, drop=True) for n in names], keep_rest=True)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename in place, keeping the column order."""
    require(df, names)
    targets = [names.get(n, n) for n in df.columns]
    _no_repeats(targets)
    return df.toDF(*targets)


_WORD_STARTS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_NOT_WORD = re.compile(r"[^A-Za-z0-9]+")


def snake_case(name: str) -> str:
    """``CustomerID`` -> ``customer_id``, ``HTTPStatus Code`` -> ``http_status_code``."""
    words = _NOT_WORD.split(_WORD_STARTS.sub(" ", name))
    return "_".join(w.lower() for w in words if w)


def standardize_column_names(df: DataFrame) -> DataFrame:
    """Rename every column to lower snake case; two names becoming one is an error."""
    targets = [snake_case(n) for n in df.columns]
    if "" in targets:
        raise ValueError(f"no letters or digits in column name {df.columns[targets.index('')]!r}")
    _no_repeats(targets)
    return df.toDF(*targets)


def add_audit_columns(df: DataFrame, source_system: str, ingested_at: datetime | Column | None = None) -> DataFrame:
    """Add ``_ingested_at`` (the query's start unless given) and ``_source_system``."""
    stamp = F.current_timestamp() if ingested_at is None else ingested_at
    stamp = stamp if isinstance(stamp, Column) else F.lit(stamp)
    return df.withColumns({"_ingested_at": stamp.cast("timestamp"), "_source_system": F.lit(source_system)})


def _projected(c: Col, on_error: str) -> Column:
    value = col(c.name)
    if c.cast:
        value = value.cast(c.cast) if on_error == "fail" else value.try_cast(c.cast)
    return value.alias(c.target)


def _no_repeats(names: Sequence[str]) -> None:
    repeated = [n for n, count in Counter(n.lower() for n in names).items() if count > 1]
    if repeated:
        raise ValueError(f"repeated column names: {repeated}")
