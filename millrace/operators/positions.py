"""Positions of rows inside ordered groups, safe for groups of any size.

A window over a group sorts that group in one task.  That is the right plan for
groups up to ``hot_rows`` rows and fatal for a key that holds a third of a large
table.  The operators here first measure the groups; groups above the limit are
range-partitioned by (keys, order), so that one group spreads over many tasks,
and each row gets its exact position in its group.  Position arithmetic then
cuts a hot group into equal blocks which windows can take one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.naming import all_equal, col, cols, quote
from millrace.session import local_table, materialize, with_row_tag

HOT_ROWS = 2_000_000
"""Largest group one window task sorts; also the rows per block of a larger one."""

RANGE_PARTITIONS = 20_000
"""Most partitions of a range shuffle; sorting spills, so larger ones cost disk, not memory."""

FREE_PARTITIONS = 64
PARTITION_ROWS = 100_000
"""Beyond so many partitions of a range shuffle none gets fewer rows than this: each costs a sample and a task."""

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
"""A side is broadcast only when both its counted rows and its measured bytes stay below these."""

POSITION = "__position"
BLOCK = "__block"
_SIZE, _PART, _OFFSET_IN_PART, _START, _TAG = "__size", "__part", "__at", "__start", "__tag"
_PART_ROW_MASK = (1 << 33) - 1


@dataclass(frozen=True)
class HotSplit:
    """The input divided by group size; either side may be None when empty."""

    cold: DataFrame | None
    hot: DataFrame | None
    hot_rows: int
    hot_groups: int
    key_bytes: int = 0

    def pieces_fit_broadcast(self, rows_per_piece: int) -> bool:
        """Whether one row per hot group and per ``rows_per_piece`` hot rows may be shipped to every task."""
        pieces = self.hot_groups + partitions_for(self.hot_rows, rows_per_piece)
        return fits_broadcast(pieces, pieces * (64 + self.key_bytes // max(1, self.hot_groups)))


def split_by_group_size(df: DataFrame, keys: Sequence[str], hot_rows: int | None = HOT_ROWS) -> HotSplit:
    """Find the groups above ``hot_rows`` and divide the rows.

    ``hot_rows=None`` skips the count for callers who know their groups are small.
    ``df`` is evaluated more than once, so it must be deterministic.
    """
    if hot_rows is None:
        return HotSplit(df, None, 0, 0)
    if not keys:
        total = df.count()
        return HotSplit(df, None, 0, 0) if total <= hot_rows else HotSplit(None, df, total, 1)
    sizes = heavy_keys(df, keys, hot_rows)
    groups, rows, key_bytes = sizes.agg(
        F.count(F.lit(1)), F.sum(_SIZE), F.sum(row_bytes(keys))
    ).first()
    if not groups:
        return HotSplit(df, None, 0, 0)
    renamed = {k: f"__hot_{i}" for i, k in enumerate(keys)}
    hot_keys = materialize(sizes.select(*[col(k).alias(a) for k, a in renamed.items()]))
    if fits_broadcast(groups, key_bytes):
        hot_keys = F.broadcast(hot_keys)
    same = all_equal((col(k), F.col(a)) for k, a in renamed.items())
    return HotSplit(df.join(hot_keys, same, "left_anti"), df.join(hot_keys, same, "left_semi"), rows, groups, key_bytes)


_SAMPLED_KEYS = 0.01


def heavy_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and their exact ``__size``.

    Large limits are looked for in a sample of the key columns first: of a key with
    100 000 rows a hundredth shows up, and only keys seen half as often are counted.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias(_SIZE))

    narrow = df.select(*cols(dict.fromkeys(keys)))
    if limit >= BROADCAST_ROWS:
        seen = counted(narrow.sample(_SAMPLED_KEYS, seed=1)).where(F.col(_SIZE) > limit * _SAMPLED_KEYS / 2)
        named = {k: f"__seen_{i}" for i, k in enumerate(keys)}
        seen = materialize(seen.select(*[col(k).alias(a) for k, a in named.items()]))
        same = all_equal((col(k), F.col(a)) for k, a in named.items())
        narrow = narrow.join(seen, same, "left_semi")
    return counted(narrow).where(F.col(_SIZE) > limit)


def row_bytes(names: Sequence[str]) -> Column:
    """Estimated size of the named columns of a row, from their text form."""
    return F.octet_length(F.to_json(F.struct(*cols(names))))


def fits_broadcast(rows: int, size: int | None, max_rows: int = BROADCAST_ROWS) -> bool:
    return rows <= max_rows and (size or 0) <= BROADCAST_BYTES


def partitions_for(rows: int, rows_per_partition: int) -> int:
    return max(1, -(-rows // max(1, rows_per_partition)))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    total_rows: int,
    rows_per_partition: int = HOT_ROWS,
    range_keys: Sequence[Column] | None = None,
    ship_offsets: bool = False,
) -> DataFrame:
    """Add ``__position``: 0, 1, 2 ... within each group, in ``order``.

    Range keys are sampled to the driver; where ``order`` ends in wide columns, ``range_keys``
    names the narrow beginning of it by which rows are dealt out.  ``ship_offsets`` tells
    that the groups are known to be so few that their pieces may be broadcast.

    One range shuffle sorts the rows, a scratch copy pins that layout (range
    bounds are sampled, so a second evaluation could differ), and the start of
    each group within each partition turns partition offsets into positions.
    """
    # equal rows carry distinct tags, so even a group of copies can be split
    tagged = with_row_tag(df, _TAG)
    most = min(RANGE_PARTITIONS, max(FREE_PARTITIONS, partitions_for(total_rows, PARTITION_ROWS)))
    parts = min(partitions_for(total_rows, rows_per_partition), most)
    layout = [*[col(k).asc() for k in keys], *order, F.col(_TAG).asc()]
    stored = materialize(
        tagged.repartitionByRange(parts, *(layout if range_keys is None else [*layout[: len(keys)], *range_keys, F.col(_TAG).asc()]))
        .sortWithinPartitions(*layout)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_OFFSET_IN_PART, F.monotonically_increasing_id().bitwiseAND(F.lit(_PART_ROW_MASK)))
        .drop(_TAG)
    )
    pieces = stored.groupBy(_PART, *cols(keys)).agg(
        F.min(_OFFSET_IN_PART).alias(_START), F.count(F.lit(1)).alias(_SIZE)
    )
    offsets = _piece_offsets(pieces, keys)
    renamed = {k: f"__piece_{i}" for i, k in enumerate(keys)}
    offsets = offsets.select(
        F.col(_PART).alias("__piece_part"),
        *[col(k).alias(a) for k, a in renamed.items()],
        F.col(_START),
    )
    same = (F.col(_PART) == F.col("__piece_part")) & all_equal((col(k), F.col(a)) for k, a in renamed.items())
    if ship_offsets:
        offsets = F.broadcast(offsets)
    return (
        stored.join(offsets, same)
        .withColumn(POSITION, F.col(_OFFSET_IN_PART) - F.col(_START))
        .select(*cols(df.columns), POSITION)
    )


def _piece_offsets(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rebase each (partition, group) start so that subtracting it yields the position.

    There is one piece per group plus at most one per partition, and a group has
    at most one piece per partition, so this window is small even for a hot group.
    """
    if keys:
        earlier = Window.partitionBy(*cols(keys)).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(_SIZE).over(earlier), F.lit(0).cast("long"))
        return pieces.withColumn(_START, F.col(_START) - before).drop(_SIZE)
    # a single group: one row per partition, summed up on the driver
    rebased, before = [], 0
    for part, start, size in sorted((r[_PART], r[_START], r[_SIZE]) for r in pieces.collect()):
        rebased.append((part, start - before))
        before += size
    return F.broadcast(local_table(pieces.sparkSession, rebased, f"{_PART} int, {_START} long"))


def in_ordered_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    on_window: Callable[[DataFrame, WindowSpec], DataFrame],
    on_blocks: Callable[[DataFrame, int], DataFrame],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Run ``on_window`` over ordinary groups and ``on_blocks`` over the hot ones.

    ``on_blocks`` gets the hot rows with ``__position`` and the block length.
    """
    parts = split_by_group_size(df, keys, hot_rows)
    results = []
    if parts.cold is not None:
        results.append(on_window(parts.cold, Window.partitionBy(*cols(keys)).orderBy(*order)))
    if parts.hot is not None:
        few = parts.pieces_fit_broadcast(hot_rows)
        rows = numbered(parts.hot, keys, order, parts.hot_rows, hot_rows, ship_offsets=few)
        results.append(on_blocks(rows, hot_rows).drop(POSITION, BLOCK))
    return results[0] if len(results) == 1 else results[0].unionByName(results[1])


def with_block(rows: DataFrame, block_rows: int) -> DataFrame:
    return rows.withColumn(BLOCK, F.expr(f"{quote(POSITION)} div {int(block_rows)}"))


def block_window(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*cols(keys), F.col(BLOCK)).orderBy(POSITION)


def carry_into_blocks(
    rows: DataFrame, keys: Sequence[str], summary: Column, carried: Callable[[Column, WindowSpec], Column], name: str
) -> DataFrame:
    """Add column ``name``: what the earlier blocks of its group hand to each block.

    ``summary`` aggregates one block; ``carried`` combines the summaries of all
    earlier blocks through a window that holds one row per block.
    """
    earlier = Window.partitionBy(*cols(keys)).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    renamed = {k: f"__carry_{i}" for i, k in enumerate(keys)}
    blocks = (
        rows.groupBy(*cols(keys), F.col(BLOCK))
        .agg(summary.alias("__summary"))
        .withColumn(name, carried(F.col("__summary"), earlier))
        .select(F.col(BLOCK).alias("__carry_block"), *[col(k).alias(a) for k, a in renamed.items()], col(name))
    )
    same = (F.col(BLOCK) == F.col("__carry_block")) & all_equal((col(k), F.col(a)) for k, a in renamed.items())
    return rows.join(blocks, same, "left").drop("__carry_block", *renamed.values())
