"""Links between all vectors of a cosine threshold, through int8 tile products with rigorous bounds.

Equal vectors form one class.  Classes are dealt to blocks, and every pair of blocks meets in one tile.  A unit vector
u is held as scale * q with q in int8 and the error e = |u - scale * q|, so that a pair's cosine differs from
scale_u * scale_v * (q_u . q_v) by at most e_u + e_v + e_u * e_v.  A tile multiplies the int8 codes (as float32, where
sums of up to 2**24 are exact) and works out in double precision only pairs whose bound reaches the threshold.

A tile returns a row per class that has links there: how many vectors it links to, and a root within the tile.  Pairs
are never listed, however many vectors are near each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.forest import Forest
from millrace.llm.vectors import block_rows, groups, matrix, packed, usable
from millrace.session import materialize

BLOCK_ROWS, LEAST_BLOCKS = 32_768, 8
_STRIPE = 512
_PAIRS = 1 << 16
_SLACK = 1e-9  # double rounding in scales and errors


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, their int8 codes, scales and error bounds."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1) + _SLACK
    return unit, codes, scale, error


def _tile(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    dimension, block = rows.column("dimension")[0].as_py(), rows.column("block").to_numpy()
    i, j = (rows.column(c)[0].as_py() for c in ("i", "j"))
    many, node = rows.column("many").to_numpy(), rows.column("node").to_numpy()
    unit, codes, scale, error = quantised(matrix(rows.column("vector"), dimension))
    if dimension * 127 * 127 >= 1 << 24:
        codes = codes.astype(np.float64)
    else:
        codes = codes.astype(np.float32)
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    right = right[np.argsort(scale[right])]
    counts, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
    for c in range(0, len(right), 4 * _STRIPE):
        there = right[c : c + 4 * _STRIPE]
        widest, worst = scale[there].max(), error[there].max()
        for r in range(0, len(left), _STRIPE):
            here = left[r : r + _STRIPE]
            product = codes[here] @ codes[there].T
            # scale_v <= widest and error_v <= worst: what no pair of this stripe can do without.
            need = (threshold - error[here] - worst - error[here] * worst) / (scale[here] * widest)
            at_here, at_there = np.nonzero(product >= need[:, None])
            a, b, p = here[at_here], there[at_there], product[at_here, at_there]
            bound = scale[a] * scale[b] * p + error[a] + error[b] + error[a] * error[b]
            open_ = bound >= threshold
            if i == j:
                open_ &= a < b
            a, b = a[open_], b[open_]
            for k in range(0, len(a), _PAIRS):
                x, y = a[k : k + _PAIRS], b[k : k + _PAIRS]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                x, y = x[near], y[near]
                counts += np.bincount(x, many[y], len(counts)).astype(np.int64)
                counts += np.bincount(y, many[x], len(counts)).astype(np.int64)
                forest.link(x, y)
    linked = np.flatnonzero(counts)
    columns = [pa.array(node[linked]), pa.array(counts[linked]), pa.array(node[forest.root[linked]])]
    return pa.RecordBatch.from_arrays(columns, ["node", "links", "root"])


def near_vectors(df: DataFrame, key: str, vector: str, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``df``: the key (long), n_links, component_id, kept.

    Rows are linked where the cosine, in double precision, is at least ``threshold`` (above 0).  Vectors that are
    NULL, empty, zero or hold NULL or non-finite components, and vectors of other lengths, are not linked with each
    other: such rows have 0 links and their own key as component.  Rows that repeat a key count as different vectors;
    rows with a NULL key are counted as links but name no component.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    v = F.col(vector)
    part = usable(v) & F.exists(v, lambda x: x != 0)
    source = df.select(F.col(key).cast("long").alias("id"), F.when(part, v).alias("v"))
    held = source.where(F.col("v").isNotNull())
    rows = materialize(held.select("id", F.size("v").alias("dimension"), packed(F.col("v")).alias("vector")))
    rows = rows.withColumn("class", F.sha2("vector", 256))
    found = rows.groupBy("class").agg(
        F.first("dimension").alias("dimension"), F.first("vector").alias("vector"), F.min("id").alias("id"), F.count("*").alias("many")
    )
    # The numbers are written with their classes: a later job may split the files otherwise.
    classes = materialize(found.withColumn("node", F.monotonically_increasing_id()))
    count, widest = classes.agg(F.count("*"), F.max("dimension")).first()
    blocks = max(LEAST_BLOCKS, -(-count // block_rows(BLOCK_ROWS, widest or 1)))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = dealt.select(
        "dimension", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "many", "vector"
    )
    order = ["dimension", "i", "j"]
    parts = blocks * (blocks + 1) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups(batches, order):
            yield _tile(tile, threshold)

    sorted_tiles = tiles.repartition(parts, *order).sortWithinPartitions(*order)
    met = materialize(sorted_tiles.mapInArrow(work, "node long, links long, root long"))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met, "node", "root")
    labelled = classes.select("class", "node", "id", "many").join(links, "node", "left").join(roots, "node", "left")
    labelled = materialize(labelled.withColumn("root", F.coalesce("root", "node")))
    least = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = labelled.join(least, "root").select(
        "class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")
    )
    linked = rows.select("id", "class").join(by_class, "class").select("id", "n_links", "component_id")
    alone = source.where(F.col("v").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select(F.col("id").alias(key), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
