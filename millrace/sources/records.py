"""CSV records that span lines, put together by many tasks from one file.

A line starts a record if an even number of quotes precedes it in its file. A task knows the quotes before a line only
within its own block of the file, so it works out both cases, a block that begins outside of quotes and one that begins
inside. One row per block then tells which case holds. Records of one line, nearly all, never move; the lines of the
others meet by the line that starts them.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.positions import fits_broadcast
from millrace.session import materialize

_BLOCK_BYTES = "spark.sql.files.maxPartitionBytes"
_LINES = "file string, block long, no long, inside boolean, odd boolean, if_out long, if_in long, line string"


def read_records(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", quote: str = '"', block_bytes: int | None = None
) -> DataFrame:
    """Rows (file, block, no, record): the records of text files, in which quoted line breaks do not end a record.

    ``quote`` stands round cells and is doubled inside them. A file that ends inside quotes is an error, and so is a
    record of several lines with a quote inside an unquoted cell, which would join lines by mistake. ``block`` and ``no`` order a file's records. Records end at a line feed, a carriage return before it is cut;
    inside quotes both stay. Lines of blanks alone outside of quotes are skipped.

    Files are cut into blocks of ``block_bytes`` (the session's setting unless given); compressed ones cannot be cut.
    The lines are written to the scratch area once, so that a block means the same in every pass.
    """
    for name, mark in (("quote", quote), ("sep", sep)):
        if len(mark) != 1 or not mark.isascii():
            raise ValueError(f"{name} must be one ASCII character: {mark!r}")
    with _setting(spark, _BLOCK_BYTES, block_bytes):
        text = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
        lines = text.select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), "value")
        lines = materialize(lines.mapInArrow(_both_cases(quote), _LINES))
    blocks = materialize(_cases(lines))
    open_files = blocks.where("last and ends_inside").select("file").limit(3).collect()
    if open_files:
        raise ValueError(f"files end inside quotes: {[r.file for r in open_files]}")
    sizes = blocks.agg(F.count(F.lit(1)), F.sum(F.octet_length("file") + 40)).first()
    known = blocks.select("file", "block", "begins_inside", "carried")
    placed = lines.join(F.broadcast(known) if fits_broadcast(*sizes) else known, ["file", "block"])
    starts = F.col("inside") == F.col("begins_inside")
    alone = starts & ~F.col("odd")
    whole = placed.where(alone).select("file", "block", "no", F.col("line").alias("record"))
    own = F.when(F.col("begins_inside"), F.col("if_in")).otherwise(F.col("if_out"))
    first = F.when(own.isNotNull(), F.struct("block", own.alias("no"))).otherwise(F.col("carried"))
    parts = placed.where(~alone).select("file", first.alias("first"), F.struct("block", "no", "line").alias("part"))
    met = parts.groupBy("file", "first").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = met.select("file", "first.block", "first.no", F.array_join("parts.line", "\n").alias("record"))
    whole, joined = (r.withColumn("record", F.regexp_replace("record", r"\r\z", "")) for r in (whole, joined))
    message = F.concat(F.lit("a quote stands inside an unquoted cell: "), "file", F.lit(" near "), F.left("record", F.lit(80)))
    strict = F.when(_has_stray_quote("record", sep, quote), F.raise_error(message)).otherwise(F.col("record"))
    return whole.where(F.trim("record") != "").unionByName(joined.withColumn("record", strict))


def read_csv_records(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", quote: str = '"', block_bytes: int | None = None
) -> DataFrame:
    """A CSV export with line breaks inside cells, every column as text; large files are read by many tasks.

    As ``read_csv_strings``: header names are trimmed, short rows are filled with ``''``, surplus cells are cut. Paths
    without any record, files whose headers differ, and repeated names are errors. For the quotes see ``read_records``.
    """
    records = read_records(spark, path, sep, quote, block_bytes).withColumn("record", _without_mark(F.col("record")))
    # a header that spans blocks is still numbered by its first line
    at = F.struct("block", "no")
    firsts = records.where("block = 0").groupBy("file").agg(F.min_by("record", at).alias("header"), F.min(at).alias("at"))
    firsts = materialize(firsts)
    headers = [r.header for r in firsts.select("header").distinct().limit(2).collect()]
    if not headers:
        raise ValueError(f"CSV file is empty: {path}")
    if len(headers) > 1:
        raise ValueError(f"files have different headers: {headers}")
    names = [n.strip() for n in next(csv.reader([headers[0]], delimiter=sep, quotechar=quote, strict=True))]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated header names: {names}")
    sizes = firsts.agg(F.count(F.lit(1)), F.sum(F.octet_length("file") + 16)).first()
    heads = firsts.select("file", F.col("at.block").alias("block"), F.col("at.no").alias("no"))
    rows = records.join(F.broadcast(heads) if fits_broadcast(*sizes) else heads, ["file", "block", "no"], "left_anti")
    # numbered fields: names may be anything, and a NULL text is none that a record can hold
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    parsed = rows.select(F.from_csv("record", schema.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("r"))
    return parsed.select(*[F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])


def _both_cases(quote: str):
    """Per line: whether an odd number of the block's quotes precedes it, whether it holds an odd number itself, and the
    last line up to it that starts a record if the block begins outside of quotes (``if_out``) or inside (``if_in``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, count, odd, last = None, 0, 0, [-1, -1]
        for batch in batches:
            files, blocks, lines = batch.columns
            # the lines of a block follow each other: cut the batch where file or block changes
            names, numbers = pc.dictionary_encode(files).indices.to_numpy(), blocks.to_numpy()
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a == b:
                    continue
                if here != (here := (files[a].as_py(), int(numbers[a]))):
                    count, odd, last = 0, 0, [-1, -1]
                part = lines.slice(a, b - a)
                own = pc.count_substring(part, quote).to_numpy() & 1
                before = (odd + np.r_[0, np.cumsum(own)]) & 1
                no = np.arange(count, count + b - a)
                found = []
                for case in (0, 1):
                    seen = np.maximum.accumulate(np.r_[last[case], np.where(before[:-1] == case, no, -1)])
                    last[case] = seen[-1]
                    found.append(pa.array(seen[1:], mask=seen[1:] < 0))
                yield pa.RecordBatch.from_arrays(
                    [files.slice(a, b - a), blocks.slice(a, b - a), pa.array(no), pa.array(before[:-1] == 1),
                     pa.array(own == 1), *found, part],
                    [f.split()[0] for f in _LINES.split(", ")],
                )
                count, odd = count + b - a, int(before[-1])

    return work


def _cases(lines: DataFrame) -> DataFrame:
    """One row per block: whether it begins inside quotes, and the (block, no) of the record that is then open."""
    blocks = lines.groupBy("file", "block").agg(
        F.sum(F.col("odd").cast("long")).alias("quotes"), F.max("if_out").alias("if_out"), F.max("if_in").alias("if_in")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("quotes").over(earlier), F.lit(0).cast("long"))
    cases = blocks.withColumn("begins_inside", before % 2 == 1).withColumn("ends_inside", (before + F.col("quotes")) % 2 == 1)
    started = F.when(F.col("begins_inside"), F.col("if_in")).otherwise(F.col("if_out"))
    cases = cases.withColumn("started", F.when(started.isNotNull(), F.struct("block", started.alias("no"))))
    return cases.select(
        "file", "block", "begins_inside", "ends_inside",
        F.last("started", ignorenulls=True).over(earlier).alias("carried"),
        F.lead("block").over(following).isNull().alias("last"),
    )


def _has_stray_quote(record: str, sep: str, quote: str) -> Column:
    """Whether something other than a separator stands beside a quoted cell; every quoted run is first cut to one quote."""
    s, q = (f"\\x{ord(c):02x}" for c in (sep, quote))
    cells = F.regexp_replace(record, f"{q}[^{q}]*{q}", f"\\{quote}" if quote in "$\\" else quote)
    return cells.rlike(f"[^{s}{q}\ufeff]{q}|{q}[^{s}{q}]")


def _without_mark(record: Column) -> Column:
    """A byte order mark stands only at the start of a file, before the first header name."""
    return F.when((F.col("block") == 0) & (F.col("no") == 0), F.regexp_replace(record, "^﻿", "")).otherwise(record)


@contextmanager
def _setting(spark: SparkSession, key: str, value: int | None) -> Iterator[None]:
    """A session setting for the time of a scan."""
    before = spark.conf.get(key)
    if value is not None:
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)
