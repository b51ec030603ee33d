"""Parsing text columns: splitting, regular expressions, dates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.naming import col

# Date specifiers and the Spark pattern letters they stand for (fixed values).
DATE_SPECIFIERS = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%B": "MMMM",
    "%b": "MMM",
    "%d": "dd",
    "%j": "DDD",
    "%A": "EEEE",
    "%a": "EEE",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%p": "a",
}


def text_to_columns(
    df: DataFrame, column: str, delimiter: str, n: int, prefix: str | None = None, extra: str = "last"
) -> DataFrame:
    """Split into ``prefix1 .. prefixN``; missing parts are NULL.

    Surplus parts stay unsplit in the last column, or with ``extra="drop"`` are left out.
    """
    if extra not in ("drop", "last"):
        raise ValueError(f"extra must be 'drop' or 'last', not {extra!r}")
    parts = F.split(col(column), _quoted(delimiter), n if extra == "last" else -1)
    return df.withColumns({f"{prefix or column}{i + 1}": F.get(parts, F.lit(i)) for i in range(n)})


def text_to_rows(
    df: DataFrame, column: str, delimiter: str, alias: str | None = None, position: str | None = None
) -> DataFrame:
    """One row per part; NULL text stays as one NULL row. ``position`` names a 1-based index."""
    return _exploded(df, F.split(col(column), _quoted(delimiter), -1), alias or column, position)


def regex_parse(df: DataFrame, column: str, pattern: str, outputs: Sequence[str]) -> DataFrame:
    """Marked groups of the first match into columns; no match gives NULL."""
    matched = col(column).rlike(pattern)
    return df.withColumns(
        {name: F.when(matched, F.regexp_extract(col(column), pattern, i + 1)) for i, name in enumerate(outputs)}
    )


def regex_match(df: DataFrame, column: str, pattern: str, alias: str) -> DataFrame:
    return df.withColumn(alias, col(column).rlike(pattern))


def regex_replace(
    df: DataFrame, column: str, pattern: str, replacement: str, alias: str | None = None
) -> DataFrame:
    return df.withColumn(alias or column, F.regexp_replace(col(column), pattern, replacement))


def regex_tokenize(
    df: DataFrame, column: str, pattern: str, alias: str | None = None, group: int = 0, position: str | None = None
) -> DataFrame:
    """One row per match; text without a match gives no row."""
    tokens = F.regexp_extract_all(col(column), F.lit(pattern), F.lit(group))
    return _exploded(df, tokens, alias or column, position, outer=False)


def regex_tokenize_columns(
    df: DataFrame,
    column: str,
    pattern: str,
    n: int,
    prefix: str | None = None,
    group: int = 0,
    extra: str | None = None,
) -> DataFrame:
    """The first ``n`` matches into ``prefix1 .. prefixN``; ``extra`` names an array of all further ones."""
    tokens = F.regexp_extract_all(col(column), F.lit(pattern), F.lit(group))
    parts = {f"{prefix or column}{i + 1}": F.get(tokens, F.lit(i)) for i in range(n)}
    if extra:
        parts[extra] = F.slice(tokens, n + 1, F.greatest(F.size(tokens) - n, F.lit(0)))
    return df.withColumns(parts)


def spark_date_format(fmt: str) -> str:
    """Translate ``%``-specifiers; a format without any is taken as a Spark pattern."""
    if "%" not in fmt:
        return fmt
    parts = []
    for spec, literal in re.findall(r"(%.)|([^%]+)", fmt):
        if spec and spec not in DATE_SPECIFIERS:
            raise ValueError(f"unknown date specifier {spec!r}")
        if spec:
            parts.append(DATE_SPECIFIERS[spec])
        else:
            parts.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", literal))
    return "".join(parts)


def parse_datetime(
    df: DataFrame, column: str, fmt: str, to: str = "date", alias: str | None = None, on_error: str = "fail"
) -> DataFrame:
    """Text to date or timestamp; unreadable text is an error, or NULL with ``on_error="null"``."""
    if to not in ("date", "timestamp"):
        raise ValueError(f"to must be 'date' or 'timestamp', not {to!r}")
    pattern = F.lit(spark_date_format(fmt))
    read = F.try_to_timestamp if on_error == "null" else F.to_timestamp
    stamp = read(col(column), pattern) if on_error == "null" else read(col(column), spark_date_format(fmt))
    return df.withColumn(alias or column, stamp.cast("date") if to == "date" else stamp)


def format_datetime(df: DataFrame, column: str, fmt: str, alias: str | None = None) -> DataFrame:
    return df.withColumn(alias or column, F.date_format(col(column), spark_date_format(fmt)))


def _quoted(delimiter: str) -> str:
    if not delimiter:
        raise ValueError("empty delimiter")
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|" else c for c in delimiter)


def _exploded(df: DataFrame, items: Column, alias: str, position: str | None, outer: bool = True) -> DataFrame:
    explode = F.posexplode_outer if outer else F.posexplode
    kept = [col(c) for c in df.columns if c != alias]
    rows = df.select(*kept, explode(items).alias("__at", alias))
    at = [(F.col("__at") + 1).alias(position)] if position else []
    order = [col(c) for c in df.columns] + ([] if alias in df.columns else [col(alias)])
    return rows.select(*order, *at)
