"""Incremental targets: append streams and change streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.writers import upsert


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New files in a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def append_stream(
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Append what has arrived since the last run, through row-wise steps, then stop.

    The checkpoint remembers what was read and the file sink what was committed, so
    each source row lands once whatever fails in between.
    """
    writer = transform(source).writeStream.format(fmt).outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def apply_changes(
    source: DataFrame,
    target: str,
    keys: Sequence[str],
    sequence_by: str,
    checkpoint: str,
    delete_when: str | None = None,
) -> StreamingQuery:
    """Keep the latest row per key at path ``target`` from a stream of changes.

    Every batch is one upsert. A batch that is replayed after a failure, or holds
    changes older than the stored rows, leaves the result unchanged.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.sparkSession, batch, target, keys, sequence_by, delete_when)

    writer = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
