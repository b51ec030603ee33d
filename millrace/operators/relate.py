"""Lineage edges and tag-set analyses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.naming import col, cols, require
from millrace.operators.tag_blocks import Best, Block, numbered, plain
from millrace.session import materialize, with_row_tag


def lineage_edges(io: DataFrame, obj: str = "object", table: str = "table", role: str = "role") -> DataFrame:
    """``(object, depends_on)`` where the object reads a table that the other writes.

    ``io`` holds one row per object, table and role (``read`` or ``write``).  An
    object does not depend on itself.  Where several objects write a table, each
    is a dependency.
    """
    pairs = io.select(col(obj).alias("object"), col(table).alias("table"), col(role).alias("role")).distinct()
    reads = pairs.where(F.col("role") == "read").select(F.col("object"), F.col("table").alias("read_table"))
    writes = pairs.where(F.col("role") == "write").select(F.col("object").alias("depends_on"), "table")
    edges = reads.join(writes, F.col("read_table") == F.col("table")).where(F.col("object") != F.col("depends_on"))
    return edges.select("object", "depends_on").distinct()


def similar_sets(
    df: DataFrame, id_column: str, set_column: str, query: Sequence[str], k: int = 2, score: str = "score"
) -> DataFrame:
    """The ``k`` records whose tag sets overlap the query most, by Jaccard index.

    Records without overlap never qualify; ties go to the smaller id.
    """
    wanted = sorted(set(query))
    asked = F.array(*[F.lit(q) for q in wanted]).cast("array<string>")
    shared = F.size(F.array_intersect(col(set_column), asked))
    either = F.size(F.array_distinct(col(set_column))) + len(wanted) - shared
    jaccard = F.try_divide(shared, either)  # NULL for two empty sets
    # ranked before the filter, which would otherwise score every record twice
    best = df.withColumn(score, jaccard).orderBy(col(score).desc_nulls_last(), col(id_column).asc()).limit(k)
    return best.where(col(score) > 0)


ROUNDS = tuple(range(5, 101, 5))
"""Similarities, in percent, at which ``similar_sets_many`` leaves out records whose sizes lie too far apart."""

BLOCK_ROWS, BLOCK_TAGS, BLOCK_BEST = 8192, 1 << 22, 1 << 22
"""Most queries, tags and kept records of a block of queries; one query always fits."""

TASK_ROWS = 1 << 15
"""About how many records meet a block in a task, fewer where tasks would be too few: each task returns its own best."""

LOOKUP = 1 << 20
"""Most tags that are looked up at once when sets are numbered."""


def similar_sets_many(
    queries: DataFrame,
    records: DataFrame,
    id_column: str,
    set_column: str,
    k: int = 2,
    exclude_same_id: bool = False,
    rounds: Sequence[int] = ROUNDS,
) -> DataFrame:
    """For every query the ``k`` records whose tag sets overlap it most, by Jaccard index.

    Both tables hold an id and an array of tags. Returns ``query_id``, ``rank`` from 1,
    ``id`` and ``score``. Records without overlap never qualify; ties go to the smaller id.
    NULL and repeated tags do not count, NULL and empty sets match nothing. Ids should be
    unique: rows of one id are ranked apart. ``exclude_same_id`` keeps a record from answering itself.

    The driver sees all distinct tags of the queries and numbers them; sets are written down
    as numbers. Queries are cut into blocks of bounded size. One block after the other is sent to
    all tasks, and each compares its share of the records with the whole block and
    returns at most ``k`` of them per query. Records are never shuffled, pairs never written.
    The comparisons grow with queries times records. A pair of similarity t has sizes
    within t of each other: once all queries of a stripe have ``k`` records at one of ``rounds``,
    records of other sizes are left out, as they lie below.
    """
    if k < 1 or any(not 0 < p <= 100 for p in rounds):
        raise ValueError("k must be at least 1 and rounds in percent above 0")
    for side in (queries, records):
        require(side, [id_column, set_column])
    asked, stored = (_plain_sets(df, id_column, set_column) for df in (queries, records))
    # only then filtered, or the sets would be made twice
    asked = materialize(with_row_tag(asked, "q")).where(F.size("set") > 0)
    tags, key = (_common_type(asked, stored, c) for c in ("set", "id"))
    left = asked.select("q", F.col("id").cast(key).alias("key"), F.col("set").cast(tags).alias("set"))
    right = stored.select("id", F.col("id").cast(key).alias("key"), F.col("set").cast(tags).alias("set"))
    numbers = _Numbers(left)
    left, right = (materialize(numbers.of(side)) for side in (left, right))
    tasks = max(3 * queries.sparkSession.sparkContext.defaultParallelism, -(-right.count() // TASK_ROWS))
    left, right = (side.where(F.size("set") > 0) for side in (left, right))
    # in this order an earlier record wins among equal scores
    right = right.coalesce(tasks).sortWithinPartitions("id")
    rows, held = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("set")), F.lit(0))).first()
    blocks = max(1, -(-rows // max(1, min(BLOCK_ROWS, BLOCK_BEST // k))), -(-held // BLOCK_TAGS))
    at = F.pmod(F.xxhash64("q"), F.lit(blocks))
    found = [_best_of_block(left.where(at == b), right, k, exclude_same_id, rounds) for b in range(blocks)]
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc())
    pairs = reduce(DataFrame.unionByName, found)
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = ranked.join(asked.select("q", F.col("id").alias("query_id")), "q")
    return named.select("query_id", "rank", "id", "score")


def _plain_sets(df: DataFrame, id_column: str, set_column: str) -> DataFrame:
    tags = F.array_compact(F.array_distinct(col(set_column)))
    return df.select(col(id_column).alias("id"), tags.alias("set"))


class _Numbers:
    """Numbers for the tags of ``queries``, under which all blocks compare them; -1 for all other tags."""

    def __init__(self, queries: DataFrame):
        tags = queries.select(F.explode("set").alias("tag")).distinct().toArrow().column("tag")
        known = pc.unique(plain(tags))
        parts = [known.slice(i, LOOKUP) for i in range(0, len(known), LOOKUP)]
        self.shared = queries.sparkSession.sparkContext.broadcast(parts)

    def of(self, df: DataFrame) -> DataFrame:
        """``df`` with numbers in place of the tags; sets keep their sizes."""
        shared = self.shared

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("set")
                sets = numbered(batch.column(at), shared.value)
                yield pa.RecordBatch.from_arrays([sets if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

        fields = [T.StructField("set", T.ArrayType(T.IntegerType())) if f.name == "set" else f for f in df.schema]
        return df.mapInArrow(work, T.StructType(fields))


def _common_type(left: DataFrame, right: DataFrame, column: str) -> T.DataType:
    """The type in which Spark compares the two sides."""
    return left.select(column).unionByName(right.select(column)).schema[column].dataType


def _best_of_block(asked: DataFrame, stored: DataFrame, k: int, exclude_same_id: bool, rounds: Sequence[int]) -> DataFrame:
    """``q, id, score``: at most ``k`` records per query and task, all of a query's best among them."""
    block = Block(asked.toArrow(), exclude_same_id)
    shared = asked.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids, seen = Best(shared.value, k, rounds), [], 0
        for batch in batches:
            for first, *rest in shared.value.slices(batch):
                best.see(seen + first, *rest)
            ids.append(batch.column("id").take(pa.array(np.arange(len(batch)))))  # a copy, which lets the sets go
            seen += len(batch)
        if seen:
            q, at, score = best.found()
            of = pa.chunked_array(ids).take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(q), of, pa.array(score)], ["q", "id", "score"])

    schema = T.StructType([T.StructField("q", T.LongType()), stored.schema["id"], T.StructField("score", T.DoubleType())])
    met = materialize(stored.mapInArrow(work, schema))
    shared.destroy()
    return met


def tag_counts(df: DataFrame, set_column: str, tag: str = "tag", count: str = "count") -> DataFrame:
    """In how many records each tag occurs, most frequent first (ties by tag)."""
    tags = df.select(F.explode(F.array_distinct(col(set_column))).alias(tag))
    counts = tags.groupBy(*cols([tag])).agg(F.count(F.lit(1)).alias(count))
    return counts.orderBy(col(count).desc(), col(tag).asc())
