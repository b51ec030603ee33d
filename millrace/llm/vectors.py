"""Vectors as packed doubles: which rows take part, and blocks of them in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


BLOCK_BYTES = 32 << 20
"""Most bytes of doubles in a block, however many components a vector has."""


def block_rows(most: int, dimension: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Rows of a block: at most ``most``, and at most ``block_bytes`` of doubles; one vector always fits."""
    return max(1, min(most, block_bytes // (8 * max(1, dimension))))


def usable(vector: Column) -> Column:
    """Neither NULL nor empty, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def packed(vector: Column) -> Column:
    """Little-endian doubles of a usable vector, minus zero as zero."""

    def pack(vectors: pa.Array) -> pa.Array:
        values = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
        ends = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)) * 8
        body = values.astype("<f8").tobytes()
        return pa.array([body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())

    return F.arrow_udf(pack, T.BinaryType())(vector)


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dimension)


def groups(batches, keys: list[str]):
    """Tables of the rows that are equal in ``keys``; rows must come sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values = np.stack([table.column(k).to_numpy() for k in keys])
        cuts = np.r_[0, np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1, len(table)]
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = table.slice(first, last - first)
            if not len(part):
                continue
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)
