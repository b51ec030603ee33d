"""Text buffers, stable samples and settings shared by the operators of this package."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import configure

# Rows and bytes of one Arrow batch: what a Python worker holds at a time.
_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.python.filterPushdown.enabled": "true",
}
_SLICE_BYTES = 2 << 20
T = TypeVar("T")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the library, and Arrow batches that stay small where texts are long."""
    # Python workers start elsewhere: without an installed package they need the driver's path to it.
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return configure(spark)


_HELD: dict[object, object] = {}


def held_by_worker(key: object, make: Callable[[], T]) -> T:
    """The one large object, such as a vocabulary with its word cache, that a Python worker keeps between tasks."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give up what the worker keeps: called by work that needs none of it, and returned to the system where it can be."""
    if _HELD:
        _HELD.clear()
        trim()


def trim() -> None:
    """Return freed memory to the system where it can be."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind each other, and len+1 offsets into them; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    values = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = _SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = max(first + 1, min(last, rows))
        yield first, last
        first = last


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with remainder 2 are held out from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id) == 2


def share(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
