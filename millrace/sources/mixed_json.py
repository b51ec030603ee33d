"""JSON lines whose fields differ in type from file to file: typed columns, and a column of all that did not fit."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_QUOTED = re.compile(r"(`(?:[^`]|``)*`)")


def json_types(lines: DataFrame, column: str = "value") -> T.StructType:
    """The type of every field of the objects in ``column``, from one pass without a shuffle of rows.

    Fields that hold numbers alone have the narrowest type for all of them, fields of several kinds are text, objects and
    arrays are VARIANT, fields that are always null are text. Lines that hold no JSON object do not count.
    """
    objects = lines.select(F.try_parse_json(F.col(column)).alias("v")).where(_fields(F.col("v")).isNotNull())
    found = objects.agg(F.schema_of_variant_agg("v")).first()[0]
    if not found.startswith("OBJECT<"):  # no object at all
        return T.StructType([])
    # names in back ticks may hold any text
    ddl = "".join(p if p.startswith("`") else p.replace("OBJECT<", "STRUCT<") for p in _QUOTED.split(found))
    return T.StructType([T.StructField(f.name, _column_type(f.dataType)) for f in T.DataType.fromDDL(ddl).fields])


def read_json_typed(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    unfit: str = "_unfit",
    path_column: str | None = None,
) -> DataFrame:
    """JSON lines as typed columns; no line is lost and no value becomes NULL unseen.

    Without a ``schema`` the types are those of ``json_types``. Fields of a line that are not in the schema, or whose value is
    not one of the column's type, stand as a JSON object in the text column ``unfit``; a line that holds no JSON object (or
    one that repeats a name) stands there whole. Otherwise ``unfit`` is NULL. ``path_column`` names each row's file.

    Numbers fit whole-number and decimal columns only without rounding, texts where they spell a value of the column's type.
    Booleans fit boolean, text and VARIANT columns, dates and times come from texts alone, text and VARIANT columns take
    everything, objects and arrays as JSON text. Missing fields and JSON nulls are NULL. Blank lines are skipped.
    """
    text = spark.read.text(path if isinstance(path, str) else list(path))
    files = [F.col("_metadata.file_path").alias("__file")] if path_column else []
    lines = text.select("value", *files).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    if schema is None:
        schema = json_types(lines)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.names
    added = [unfit, *([path_column] if path_column else [])]
    if len({n.lower() for n in [*names, *added]}) < len(names) + len(added):
        raise ValueError(f"columns would repeat a name: {[*names, *added]}")
    rows = lines.withColumn("__fields", _fields(F.try_parse_json("value")))
    values = [F.try_element_at("__fields", F.lit(f.name)) for f in schema.fields]
    typed = [_typed(v, f.dataType) for v, f in zip(values, schema.fields, strict=True)]
    wrong = [
        F.when(~_fits(v, c, f.dataType), F.lit(f.name)) for v, c, f in zip(values, typed, schema.fields, strict=True)
    ]
    bad = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
    known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    rows = rows.withColumn("__bad", bad)
    left = F.map_filter(
        "__fields",
        lambda k, v: F.array_contains("__bad", k) | (~F.array_contains(known, k) & ~_is_null(v)),
    )
    leftover = F.when(F.col("__fields").isNull(), F.col("value")).when(F.size(left) > 0, F.to_json(left))
    # a value that does not fit is told once, in the leftover column
    columns = [
        F.when(~F.array_contains("__bad", F.lit(f.name)), c).alias(f.name) for f, c in zip(schema.fields, typed, strict=True)
    ]
    return rows.select(*columns, leftover.alias(unfit), *([F.col("__file").alias(path_column)] if path_column else []))


def _fields(v: Column) -> Column:
    """The fields of an object; NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string, variant>")


def _column_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return T.VariantType()
    return T.StringType() if isinstance(kind, (T.VariantType, T.NullType)) else kind


def _is_null(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def _typed(v: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return F.when(~_is_null(v), v)
    if not isinstance(kind, (T.StringType, T.BooleanType, T.NumericType, *_TIMES)):
        raise ValueError(f"no column type for JSON fields: {kind.simpleString()}; take VARIANT")
    return F.try_variant_get(v, "$", kind.simpleString())


def _fits(v: Column, typed: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.VariantType)):
        return F.lit(True)
    found = F.schema_of_variant(v)
    rules = [typed.isNotNull()]
    if isinstance(kind, T.BooleanType):
        rules.append(found.isin("BOOLEAN", "STRING"))
    elif isinstance(kind, _TIMES):
        rules.append(found == "STRING")
    else:
        rules.append(found != "BOOLEAN")
    if isinstance(kind, _WHOLE):
        same = F.try_variant_get(v, "$", "double") == typed.cast("double")
        rules.append((found == "BIGINT") | same)
    elif isinstance(kind, T.DecimalType):
        rules.append(F.try_variant_get(v, "$", f"decimal(38, {min(38, kind.scale + 6)})") == typed)
    return _is_null(v) | F.coalesce(reduce(and_, rules), F.lit(False))
