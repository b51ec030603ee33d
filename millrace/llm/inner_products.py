"""Exact top-k by integer inner product.

Candidates are dealt to blocks and each block is worked through in order of descending length.  Vectors are rotated by
the singular vectors of a sample, which moves most of their length into the leading components.  A query keeps its
k-th best score t; a candidate is worked out only if

    (leading parts' product) + |rest of query| * |rest of candidate| >= t        (Cauchy-Schwarz)

and a block ends for all queries whose |query| * |longest candidate left| is below t.  Every query starts from the
score that the longest vectors of the whole table give it.  Scores themselves are sums of integers, never rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.vectors import block_rows, groups, matrix, packed, usable
from millrace.session import materialize, with_row_tag

BLOCK_ROWS, LEAST_BLOCKS, QUERY_ROWS = 16_384, 16, 4096
_HEAD, _SAMPLE, _STRIPE, _LEAD = 1024, 20_000, 1024, 16
_EXACT = float(1 << 52)


_whole = np.vectorize(int, otypes=[object])  # Python integers, of any size


def _scores(queries: np.ndarray, candidates: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products; doubles hold them where no partial sum can pass 2**52."""
    if bound < _EXACT:
        return queries @ candidates.T
    wide = _whole(queries) @ _whole(candidates).T
    if any(abs(x) >= 1 << 63 for x in wide.ravel()):
        raise OverflowError("a score does not fit a long")
    return wide.astype(np.int64)


def rotation(vectors: np.ndarray) -> np.ndarray:
    """Right singular vectors, the strongest first: the eigenvectors of the Gram matrix of the components."""
    return np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1]


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.queries = queries

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.q, self.id = np.r_[self.q, q], np.r_[self.id, ids]
        self.score = np.r_[self.score, score.astype(np.int64)]
        order = np.lexsort((self.id, -self.score, self.q))
        self.q, self.id, self.score = self.q[order], self.id[order], self.score[order]
        first = np.searchsorted(self.q, self.q)
        kept = np.arange(len(self.q)) - first < self.k
        self.q, self.id, self.score = self.q[kept], self.id[kept], self.score[kept]
        ends = np.searchsorted(self.q, np.arange(self.queries), side="right")
        full = ends - np.searchsorted(self.q, np.arange(self.queries)) == self.k
        self.floor[full] = np.maximum(self.floor[full], self.score[ends[full] - 1])


def search(
    queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int
) -> Best:
    """The best candidates of one block for each query, all whose score is at least ``floor``."""
    best = Best(len(queries), k, floor)
    length = np.linalg.norm(vectors, axis=1)
    order = np.argsort(-length, kind="stable")
    vectors, ids, length = vectors[order], ids[order], length[order]
    lead = min(_LEAD, vectors.shape[1])
    turned, asked = vectors @ turn, queries @ turn
    rest, asked_rest = np.linalg.norm(turned[:, lead:], axis=1), np.linalg.norm(asked[:, lead:], axis=1)
    asked_length = np.linalg.norm(queries, axis=1)
    for first in range(0, len(vectors), _STRIPE):
        at = slice(first, first + _STRIPE)
        slack = 1e-9 * asked_length * length[first] + 1e-6
        live = np.flatnonzero(asked_length * length[first] + slack >= best.floor)
        if not len(live):
            break
        bound = asked[live, :lead] @ turned[at, :lead].T + np.outer(asked_rest[live], rest[at])
        open_ = bound + slack[live, None] >= best.floor[live, None]
        open_ &= query_ids[live, None] != ids[None, at]
        columns = np.flatnonzero(open_.any(axis=0))
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(columns):
            continue
        score = _scores(queries[live[rows]], vectors[at][columns], float((asked_length * length[first]).max()))
        good = open_[np.ix_(rows, columns)] & (score >= best.floor[live[rows], None])
        if good.any():
            # Of a row's scores only those not below its own k-th can count; equal ones all stay.
            if len(columns) > k:
                lowest = np.iinfo(np.int64).min if score.dtype == np.int64 else -np.inf
                kth = np.partition(np.where(good, score, lowest), len(columns) - k, axis=1)[:, len(columns) - k]
                good &= score >= kth[:, None]
            r, c = np.nonzero(good)
            best.add(live[rows[r]], ids[at][columns[c]], score[r, c])
    return best


def _integers(column: pa.Array, dimension: int, factor: float) -> np.ndarray:
    return np.floor(matrix(column, dimension) * factor)


def top_products(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 5, factor: float = 256.0) -> DataFrame:
    """The ``k`` rows with the highest scores of every query row: query_id, rank (from 1), the key, score.

    Components become floor(factor * x); the score is their integer inner product, ties go to the smaller key.  A
    query's candidates are all rows of the same dimension with another key; it gets fewer than ``k`` rows if there
    are fewer.  Vectors that are NULL, empty or hold NULL or non-finite components, and NULL keys, take no part.
    Rows that repeat a key are candidates each; a query row that is repeated has its rows repeated.  A score beyond a
    long is an error.
    """
    usable_rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull())
    rows = materialize(
        usable_rows.select(
            F.col(key).cast("long").alias("id"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
            F.size(vector).alias("dimension"),
            packed(F.col(vector)).alias("vector"),
            F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("length"),
        )
    )
    rows = with_row_tag(rows, "tag")
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("dimension", "asks").count().collect()}
    total, asking = sum(counts.values()), sum(n for (_, asks), n in counts.items() if asks)
    dimensions = sorted({d for d, _ in counts})
    widest = max(dimensions, default=1)
    blocks = max(LEAST_BLOCKS, -(-total // block_rows(BLOCK_ROWS, widest)))
    chunks = max(1, -(-asking // block_rows(QUERY_ROWS, widest)))
    # A bounded start for each dimension: the longest vectors, and a sample for the rotation.
    heads, turns = {}, {}
    for d in dimensions:
        mine = rows.where(F.col("dimension") == d)
        head = mine.orderBy(F.desc("length"), "id").limit(block_rows(_HEAD, d)).select("id", "vector").toArrow()
        rate = min(1.0, block_rows(_SAMPLE, d) / max(1, total))
        sample = mine.where(F.pmod(F.xxhash64("tag"), F.lit(1 << 20)) < rate * (1 << 20)).select("vector").toArrow()
        heads[d] = (head.column("id").to_numpy(), _integers(head.column("vector"), d, factor))
        turns[d] = rotation(_integers(sample.column("vector"), d, factor))
    shared = df.sparkSession.sparkContext.broadcast((heads, turns))

    queries = rows.where("asks").select(
        "dimension",
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("tag"), F.lit(chunks)).cast("int").alias("chunk"),
        "id", "tag", F.lit(True).alias("asks"), "vector",
    )
    candidates = rows.select(
        "dimension",
        F.pmod(F.xxhash64("tag", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
        "id", "tag", F.lit(False).alias("asks"), "vector",
    )
    order = ["dimension", "block", "chunk"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups(batches, order):
            d = tile.column("dimension")[0].as_py()
            asks = tile.column("asks").to_numpy()
            ids, tags = tile.column("id").to_numpy(), tile.column("tag").to_numpy()
            vectors = _integers(tile.column("vector"), d, factor)
            (head_ids, head), turn = shared.value[0][d], shared.value[1][d]
            asked, own = vectors[asks], ids[asks]
            if not len(asked):
                continue
            nothing = np.full(len(asked), -np.inf)
            floor = search(asked, own, nothing, head, head_ids, turn, k).floor
            best = search(asked, own, floor, vectors[~asks], ids[~asks], turn, k)
            columns = [pa.array(own[best.q]), pa.array(tags[asks][best.q]), pa.array(best.id), pa.array(best.score)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "tag", "id", "score"])

    tiles = queries.unionByName(candidates).repartition(blocks * chunks, *order).sortWithinPartitions(*order)
    found = tiles.mapInArrow(work, "query_id long, tag long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
