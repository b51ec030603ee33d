"""Equal-size shards by histogram sort: count below probes, refine, exchange once.

Rows are ordered by (60-bit md5 key of the text, doc_id).  A row's *position* is the number of bytes before it, and
its shard is ``position * shards // total``.  A group of equal texts that weighs at most ``tolerance`` of a shard takes
the position of its first row as a whole, so that small groups of copies stay together; heavier groups are cut by
doc_id.  Shards thus differ from the mean by at most that tolerance plus one document.

The splitters are found without sorting: each round counts exact bytes between candidate keys over all partitions and
narrows the interval of every splitter that is still open, until a single key (or doc_id) remains.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh
from millrace.session import materialize

FANOUT = 32  # parts that a round cuts an open interval into
PROBES = 200_000  # that a round asks for at most, unless there are more splitters
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's md5; NULL counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Splitters:
    """Boundaries in ascending order: part p begins at the first row with (key, tie) >= boundary p-1."""

    keys: np.ndarray
    ties: np.ndarray

    def part(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        first = np.searchsorted(self.keys, key, side="left")
        last = np.searchsorted(self.keys, key, side="right")
        out = first.copy()
        split = last > first
        for f in np.unique(first[split]):  # the few keys that splitters cut
            rows = split & (first == f)
            ties = self.ties[f : last[rows][0]]
            out[rows] += np.searchsorted(ties, tie[rows], side="right")
        return out


def _counted(df: DataFrame, column: str, size: str, probes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(interval, bytes, rows, least, greatest) of every interval between probes that holds rows."""
    shared = df.sparkSession.sparkContext.broadcast(probes)

    def interval(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, values.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    parts = df.select(F.col(column).alias("v"), F.col(size).alias("s")).withColumn(
        "i", F.arrow_udf(interval, "int")(F.col("v"))
    )
    found = parts.groupBy("i").agg(F.sum("s"), F.count("*"), F.min("v"), F.max("v")).collect()
    return sorted(tuple(r) for r in found)


def _crossings(df: DataFrame, column: str, size: str, targets: list[int]) -> dict[int, tuple[int, int, int]]:
    """The value v at which the bytes of values <= v first reach a target: target -> (v, bytes before v, bytes of v).

    ``targets`` are ascending and lie in 1..total.  What is collected is bounded by targets and probes.
    """
    probes, open_, done = np.empty(0, np.int64), list(targets), {}
    while open_:
        below, wanted, at = 0, [], 0
        # Probes are dense around open targets only, so an interval may be wide where nothing is open.
        for _, held, _, least, greatest in _counted(df, column, size, probes):
            while at < len(open_) and open_[at] <= below + held:
                if least == greatest:
                    done[open_[at]] = (least, below, held)
                else:
                    wanted.append((least, greatest, open_[at]))
                at += 1
            below += held
        open_ = [t for _, _, t in wanted]
        spans = sorted({(lo, hi) for lo, hi, _ in wanted})
        # searchsorted(side="right") starts an interval at its probe: lo + 1 ... hi cut [lo, hi] anew.
        fanout = max(2, min(FANOUT, PROBES // max(1, len(spans))))
        steps = [lo + 1 + (hi - lo - 1) * k // fanout for lo, hi in spans for k in range(fanout + 1)]
        # One probe at each span's start keeps what lies before it apart.
        probes = np.unique(np.array(steps + [lo for lo, _ in spans] + [hi + 1 for _, hi in spans if hi < _HIGH], np.int64))
    return done


def find_splitters(df: DataFrame, key: str, tie: str, size: str, parts: int, slack: float) -> Splitters:
    """Splitters of ``parts`` equal shares; ``df`` is read some times, so it should be stored and narrow."""
    total = df.agg(F.sum(size)).first()[0] or 0
    targets = sorted({-(-total * p // parts) for p in range(1, parts)} - {0})
    crossed = _crossings(df, key, size, targets) if total else {}
    heavy: dict[int, list[int]] = {}
    at = {}
    for target, (value, _, held) in crossed.items():
        if held <= slack:  # the whole group begins before the target
            at[target] = (value, _HIGH)
        else:
            heavy.setdefault(value, []).append(target)
    for value, wanted in heavy.items():
        below = crossed[wanted[0]][1]
        inside = _crossings(df.where(F.col(key) == value), tie, size, [t - below for t in sorted(wanted)])
        at |= {t: (value, inside[t - below][0] + 1) for t in wanted}
    # Fewer bytes than parts: targets coincide, and so do their splitters.
    every = [-(-total * p // parts) for p in range(1, parts)]
    cuts = [at[t] if t else (_LOW, _LOW) for t in every] if total else []
    return Splitters(np.array([k for k, _ in cuts], np.int64), np.array([d for _, d in cuts], np.int64))


def shard(
    df: DataFrame,
    shards: int,
    key: Column,
    tie: Column,
    size: Column,
    tolerance: float = 0.01,
    part_bytes: int = 1 << 30,
) -> DataFrame:
    """Every row of ``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within the shard).

    ``key``, ``tie`` (both cast to long) and ``size`` (bytes, at least 1) must be deterministic; NULL keys and ties
    sort first.  Rows equal in key and tie are never parted.  An empty table stays empty, columns named ``shard`` or
    ``slot`` are replaced, all others are kept.  Each exchanged partition holds about ``part_bytes``: a large shard
    is made of several, and slots continue over them.
    """
    names = {n: fresh(df, n) for n in ("__key", "__tie", "__size", "__part", "__start")}
    k, t, s, p, start = names.values()
    kept = df.drop("shard", "slot")
    keyed = materialize(
        kept.withColumns(
            {k: F.coalesce(key.cast("long"), F.lit(_LOW)), t: F.coalesce(tie.cast("long"), F.lit(_LOW)), s: size.cast("long")}
        )
    )
    narrow = keyed.select(k, t, s)
    total = narrow.agg(F.sum(s)).first()[0] or 0
    per_shard = max(1, -(-total // (shards * part_bytes)))
    parts = shards * per_shard
    splitters = keyed.sparkSession.sparkContext.broadcast(
        find_splitters(narrow, k, t, s, parts, tolerance * total / shards)
    )

    def part(keys: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(splitters.value.part(keys.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False)), pa.int32())

    placed = keyed.withColumn(p, F.arrow_udf(part, "int")(F.col(k), F.col(t)))
    # At most `parts` rows: where each part of a shard begins to number.
    order = Window.partitionBy(F.floor(F.col(p) / per_shard)).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(p).count().select(p, F.coalesce(F.sum("count").over(order), F.lit(0)).alias(start))
    within = F.row_number().over(Window.partitionBy(p).orderBy(k, t))
    return placed.join(F.broadcast(starts), p).select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.floor(F.col(p) / per_shard).cast("int").alias("shard"),
        (F.col(start) + within - 1).cast("long").alias("slot"),
    )
