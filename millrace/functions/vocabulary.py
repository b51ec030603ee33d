"""The formula vocabulary as Column functions.

Each takes and returns Columns and is built from Spark functions only, so it stays
inside generated code.  Names that Spark already has under the same name and
meaning (``trim``, ``round``, ``coalesce``, ``greatest`` ...) are re-exported.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import (
    abs,
    array,
    ceil,
    coalesce,
    concat,
    contains,
    date_add,
    date_format,
    date_sub,
    datediff,
    endswith,
    exp,
    floor,
    greatest,
    isnan,
    least,
    left,
    length,
    ln,
    log,
    log10,
    md5,
    now,
    nullif,
    power,
    regexp_extract,
    replace,
    right,
    round,
    size,
    split,
    sqrt,
    startswith,
    to_date,
    to_timestamp,
    trim,
)

# Units of date arithmetic (fixed values).
DATE_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def _column(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# --- conditions and NULL -------------------------------------------------

def iif(condition: Column, then: object, otherwise: object) -> Column:
    """``then`` where the condition holds, else ``otherwise`` (also when it is NULL)."""
    return F.when(condition, _column(then)).otherwise(_column(otherwise))


def case_when(*branches: tuple[Column, object], otherwise: object = None) -> Column:
    """IF .. ELSEIF .. ELSE: the first branch whose condition holds."""
    if not branches:
        raise ValueError("case_when needs a branch")
    result = F
    for condition, value in branches:
        result = result.when(condition, _column(value))
    return result.otherwise(_column(otherwise))


def null() -> Column:
    return F.lit(None)


def is_null(value: Column) -> Column:
    return value.isNull()


def is_not_null(value: Column) -> Column:
    return value.isNotNull()


def is_empty(value: Column) -> Column:
    """NULL or the empty string."""
    return value.isNull() | (value == "")


# --- conversion ----------------------------------------------------------

def to_string(value: Column) -> Column:
    return value.cast("string")


def to_number(value: Column, on_error: str = "fail") -> Column:
    """Text to double; ``on_error="null"`` reads unreadable text as NULL."""
    return value.try_cast("double") if on_error == "null" else value.cast("double")


def cast(value: Column, kind: str) -> Column:
    return value.cast(kind)


# --- text ----------------------------------------------------------------

def uppercase(value: Column) -> Column:
    return F.upper(value)


def lowercase(value: Column) -> Column:
    return F.lower(value)


def title_case(value: Column) -> Column:
    return F.initcap(value)


def trim_left(value: Column) -> Column:
    return F.ltrim(value)


def trim_right(value: Column) -> Column:
    return F.rtrim(value)


def substring(value: Column, start: object, count: object = None) -> Column:
    """``count`` characters from the 0-based ``start``; to the end without a count."""
    first = _column(start) + 1
    return value.substr(first, F.length(value) if count is None else _column(count))


def pad_left(value: Column, width: int, pad: str) -> Column:
    """Pad to ``width``; longer text is cut to it."""
    return F.lpad(value, width, pad)


def pad_right(value: Column, width: int, pad: str) -> Column:
    return F.rpad(value, width, pad)


def replace_char(value: Column, chars: str, by: str) -> Column:
    """Replace character for character; characters without a partner are removed."""
    return F.translate(value, chars, by)


def regex_match(value: Column, pattern: str) -> Column:
    """Whether the pattern occurs anywhere in the text."""
    return value.rlike(pattern)


def regex_replace(value: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, pattern, replacement)


def plus(*parts: object) -> Column:
    """String ``+``: concatenation, NULL when any part is NULL."""
    return F.concat(*[_column(p).cast("string") for p in parts])


def md5_ascii(value: Column) -> Column:
    return F.md5(value)


def md5_unicode(value: Column) -> Column:
    """Like ``md5_ascii``: the hex digest of the UTF-8 bytes."""
    return F.md5(value)


# --- numbers -------------------------------------------------------------

def ceiling(value: Column) -> Column:
    return F.ceil(value)


def mod(value: Column, divisor: object) -> Column:
    return value % _column(divisor)


# --- dates ---------------------------------------------------------------

def date_time_year(value: Column) -> Column:
    return F.year(value)


def date_time_month(value: Column) -> Column:
    return F.month(value)


def date_time_day(value: Column) -> Column:
    return F.day(value)


def date_time_hour(value: Column) -> Column:
    return F.hour(value)


def date_time_now() -> Column:
    return F.current_timestamp()


def date_time_today() -> Column:
    return F.current_date()


def date(value: Column) -> Column:
    return value.cast("date")


def date_time_add(value: Column, n: object, unit: str) -> Column:
    """Shift by ``n`` units; the result is a timestamp, also for a date."""
    return F.timestamp_add(_unit(unit), _column(n).cast("bigint"), value)


dateadd = date_time_add


def date_time_diff(a: Column, b: Column, unit: str = "day") -> Column:
    """``a - b`` in whole units; days are calendar days, other units elapsed ones."""
    name = _unit(unit)
    return F.datediff(a, b) if name == "DAY" else F.timestamp_diff(name, b, a)


def date_time_to_utc(value: Column, tz: str = "UTC") -> Column:
    """Read the clock time as one in ``tz`` and give it in UTC."""
    return F.to_utc_timestamp(value, tz)


def date_time_to_local(value: Column, tz: str = "UTC") -> Column:
    return F.from_utc_timestamp(value, tz)


def _unit(unit: str) -> str:
    name = unit.strip().lower()
    name = name[:-1] if name.endswith("s") else name
    if name not in DATE_UNITS:
        raise ValueError(f"unknown date unit {unit!r}; have {DATE_UNITS}")
    return name.upper()


__all__ = [
    "DATE_UNITS", "abs", "array", "case_when", "cast", "ceil", "ceiling", "coalesce", "concat", "contains",
    "date", "date_add", "date_format", "date_sub", "date_time_add", "date_time_day", "date_time_diff",
    "date_time_hour", "date_time_month", "date_time_now", "date_time_to_local", "date_time_to_utc",
    "date_time_today", "date_time_year", "dateadd", "datediff", "endswith", "exp", "floor", "greatest", "iif",
    "is_empty", "is_not_null", "is_null", "isnan", "least", "left", "length", "ln", "log", "log10", "lowercase",
    "md5", "md5_ascii", "md5_unicode", "mod", "now", "null", "nullif", "pad_left", "pad_right", "plus", "power",
    "regex_match", "regex_replace", "regexp_extract", "replace", "replace_char", "right", "round", "size",
    "split", "sqrt", "startswith", "substring", "title_case", "to_date", "to_number", "to_string",
    "to_timestamp", "trim", "trim_left", "trim_right", "uppercase",
]
