"""Reading tables, files, queries and listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import islice
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.naming import col
from millrace.session import local_table

# File extensions and the Spark format and options each stands for (fixed values).
FORMATS = {
    "csv": ("csv", {"header": "true"}),
    "tsv": ("csv", {"header": "true", "sep": "\t"}),
    "txt": ("text", {}),
    "json": ("json", {}),
    "parquet": ("parquet", {}),
    "avro": ("avro", {}),
    "orc": ("orc", {}),
}


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by its one- to three-part name."""
    return spark.table(name)


def read_files(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Files of one format, told by the extension unless given.

    Give a ``schema`` where it is known: reading text formats without one costs a
    pass over the data.
    """
    paths = [path] if isinstance(path, str) else list(path)
    name, defaults = _format(fmt or _extension(paths[0]))
    reader = spark.read.format(name).options(**{**defaults, **options})
    return (reader.schema(schema) if schema is not None else reader).load(paths)


def read_many(
    spark: SparkSession,
    paths: Sequence[str] | DataFrame,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    path_column: str | None = None,
    max_paths: int = 100_000,
    **options: str,
) -> DataFrame:
    """Many files; missing columns are NULL. ``path_column`` names each row's file.

    The list may come from a DataFrame with one string column.  Entries mean what they
    mean to Spark's readers, however many there are: files, folders and globs are read,
    one that does not exist is an error.  A scan keeps its file listing on the driver,
    so a list is read ``max_paths`` entries at a time, and the scans are united.
    """
    if max_paths < 1:
        raise ValueError("max_paths must be at least 1")
    if isinstance(paths, DataFrame):
        listed = paths.select(col(paths.columns[0]).alias("__listed")).distinct().orderBy("__listed")
        found = (r[0] for r in listed.toLocalIterator())
    else:
        found = iter(paths)
    out, known = None, fmt
    while chunk := list(islice(found, max_paths)):
        known = known or _extension(chunk[0])
        merge = {"mergeSchema": "true"} if schema is None and known in ("parquet", "orc") else {}
        df = read_files(spark, chunk, known, schema, **{**merge, **options})
        if path_column:
            df = df.withColumn(path_column, F.col("_metadata.file_path"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths to read")
    return out


def inline_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A small hand-typed table."""
    return local_table(spark, list(rows), schema)


def read_query(spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The rows of a SELECT; ``{name}`` in the text stands for a DataFrame given in ``views``."""
    return spark.sql(sql, **(views or {}))


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Files as rows: name, path, length, modification time; contents stay unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", "modificationTime"
    )


def read_csv_strings(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = False, **options: str
) -> DataFrame:
    """A CSV export with every column as text.

    Header names are trimmed, cells missing at the end of a short row are ``''``,
    surplus cells are cut, and a file without a header line is an error.  So is a file
    whose header differs from the others', and one that repeats a name.

    Large files are read by many tasks.  Where cells hold line breaks ``multi_line`` is
    needed, and each file is read by one.
    """
    fixed = {"header": "true", "inferSchema": "false", "enforceSchema": "false", "escape": '"'}
    reader = spark.read.options(**{**fixed, "multiLine": str(multi_line).lower(), **options})
    # an unquoted empty cell is '' like a missing one, so both NULLs mean ''
    raw = reader.csv(path if isinstance(path, str) else list(path))
    names = [c.strip().lstrip("﻿") for c in raw.columns]
    if not names:
        raise ValueError(f"CSV file is empty: {path}")
    if len(set(names)) < len(names):
        raise ValueError(f"repeated header names: {names}")
    return raw.select(*[F.coalesce(col(c), F.lit("")).alias(n) for c, n in zip(raw.columns, names, strict=True)])


def _extension(path: str) -> str:
    suffixes = [s.lstrip(".").lower() for s in PurePosixPath(path).suffixes]
    known = [s for s in suffixes if s in FORMATS]
    if not known:
        raise ValueError(f"cannot tell the format of {path!r}; pass fmt")
    return known[-1]


def _format(name: str) -> tuple[str, dict[str, str]]:
    return FORMATS.get(name.lower(), (name, {}))
