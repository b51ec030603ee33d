"""Distinct counts that are kept per period and merged without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.naming import all_equal, col, cols, require

SKETCH_BITS = 14
"""Up to 2 ** bits distinct values a sketch is exact; beyond, its relative standard error is about 2 ** (-bits / 2)."""

_KEPT_AS_THEY_ARE = (T.IntegralType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType)


def distinct_sketches(
    df: DataFrame, keys: Sequence[str], column: str, sketch: str = "sketch", bits: int = SKETCH_BITS
) -> DataFrame:
    """Per group a sketch of the distinct values of ``column``, to be stored in place of the rows.

    NULL values do not count; a group of NULLs alone has an empty sketch. Values that are neither numbers nor
    text, as dates or decimals, are sketched as text. A sketch takes at most about 16 * 2 ** bits bytes.
    """
    require(df, [*keys, column])
    kind = df.schema[column].dataType
    value = col(column) if isinstance(kind, _KEPT_AS_THEY_ARE) else col(column).cast("string")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        value = value.cast("long")  # so that equal numbers of several widths are one value
    return df.groupBy(*cols(keys)).agg(F.theta_sketch_agg(value, bits).alias(sketch))


def merge_sketches(df: DataFrame, keys: Sequence[str], sketch: str = "sketch", bits: int = SKETCH_BITS) -> DataFrame:
    """Stored sketches rolled up to coarser ``keys``; the same as sketching all rows at once. NULL sketches are empty."""
    require(df, [*keys, sketch])
    return df.groupBy(*cols(keys)).agg(F.theta_union_agg(col(sketch), bits).alias(sketch))


def sketched_count(sketch: Column) -> Column:
    """The distinct values in a sketch, as a whole number; 0 where there is none."""
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("long"))


def compare_sketches(before: DataFrame, after: DataFrame, keys: Sequence[str], sketch: str = "sketch") -> DataFrame:
    """Per key of either side: how many values are in ``both``, only ``after`` (``joined``), only ``before`` (``left``).

    Keys must be unique on each side; NULL keys match each other. Beyond 2 ** bits values of a sketch the counts are
    estimates whose error is relative to the size of the union.
    """
    for side in (before, after):
        require(side, [*keys, sketch])
    named = {k: f"__before_{i}" for i, k in enumerate(keys)}
    old = before.select(*[col(k).alias(a) for k, a in named.items()], col(sketch).alias("__old"), F.lit(True).alias("__was"))
    new = after.select(*cols(keys), col(sketch).alias("__new"), F.lit(True).alias("__is"))
    rows = new.join(old, all_equal((col(k), F.col(a)) for k, a in named.items()), "full")
    was, now = F.col("__old"), F.col("__new")
    known = was.isNotNull() & now.isNotNull()
    none = F.lit(0).cast("long")
    return rows.select(
        *[F.when(F.col("__is"), col(k)).otherwise(F.col(a)).alias(k) for k, a in named.items()],
        F.when(known, F.theta_sketch_estimate(F.theta_intersection(now, was))).otherwise(none).alias("both"),
        F.when(known, F.theta_sketch_estimate(F.theta_difference(now, was))).otherwise(sketched_count(now)).alias("joined"),
        F.when(known, F.theta_sketch_estimate(F.theta_difference(was, now))).otherwise(sketched_count(was)).alias("left"),
    )
