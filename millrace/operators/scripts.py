"""User code on the executors: whole table, per ordered group, or as a scan over blocks.

User functions and the wrappers here travel to the executors by value, so the
package need not be installed there.
"""

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.naming import OrderBy, all_equal, col, cols, require, sort_keys
from millrace.operators.ordered import sum_over_blocks
from millrace.operators.positions import (
    BLOCK,
    POSITION,
    in_ordered_groups,
    numbered,
    split_by_group_size,
    with_block,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCRIPT_ROWS = 200_000
"""Largest group, and largest block of a bigger group, handed to user code at once."""


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Chain DataFrame functions into one, for ``df.transform(...)``."""
    return lambda df: reduce(lambda out, step: out.transform(step), steps, df)


def map_pandas(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Run a row-wise pandas function over Arrow batches where the data lies."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(run, schema)


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    order_by: OrderBy,
    fn: Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: T.StructType | str,
    tie_break: bool = True,
) -> DataFrame:
    """Run ``fn(key, frames)`` over each group, its rows in order.

    A group arrives as a stream of bounded Arrow batches and is never held whole,
    so the function may be any sequential script.  Being sequential, one group
    stays in one task; a script whose state can be combined belongs in
    ``scan_groups``, which also divides a single group.
    """
    require(df, keys)

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fn(key, frames)

    ordered = df.repartition(*cols(keys)).sortWithinPartitions(*cols(keys), *sort_keys(df, order_by, tie_break))
    return ordered.groupBy(*cols(keys)).applyInPandas(run, schema)


def scan_groups(
    df: DataFrame,
    keys: Sequence[str],
    order_by: OrderBy,
    summarise: Callable[[pa.Table], dict],
    combine: Callable[[dict | None, dict], dict],
    emit: Callable[[pa.Table, dict | None], pa.Table],
    state: str,
    schema: T.StructType | str,
    tie_break: bool = True,
    group_rows: int | None = SCRIPT_ROWS,
) -> DataFrame:
    """A sequential script over ordered groups, run in parallel over blocks of a group.

    ``emit(rows, before)`` produces the output for a stretch of rows, given the state
    left by all rows before it (None at the start of a group).  Groups above
    ``group_rows`` are cut into blocks: ``summarise(rows)`` gives the effect of one
    block as a dict with the fields of the DDL ``state``, and ``combine(before,
    summary)`` the state after it.  Only summaries, one row per block, meet in order.
    One stretch is in memory at a time: choose fewer ``group_rows`` for very wide rows.
    """
    require(df, keys)
    order = sort_keys(df, order_by, tie_break)
    parts = split_by_group_size(df, keys, group_rows)
    results = []
    if parts.cold is not None:
        results.append(_emit_stretches(_opened(parts.cold, keys, order), df.columns, emit, [], schema))
    if parts.hot is not None:
        rows = with_block(numbered(parts.hot, keys, order, parts.hot_rows, group_rows), group_rows)
        carried = _opened(_carried_states(rows, keys, summarise, combine, state), [*keys, BLOCK], [F.col(POSITION)])
        fields = [f.name for f in T.StructType.fromDDL(state).fields]
        results.append(_emit_stretches(carried, df.columns, emit, fields, schema))
    return results[0] if len(results) == 1 else results[0].unionByName(results[1])


def multi_row_fold(
    df: DataFrame,
    field: str,
    init: float,
    shift: Column | str,
    group_by: Sequence[str],
    order_by: OrderBy,
    scale: Column | str | None = None,
    low: Column | str | None = None,
    high: Column | str | None = None,
    tie_break: bool = True,
    group_rows: int | None = SCRIPT_ROWS,
) -> DataFrame:
    """A field that refers to its own previous value.

    Row by row ``field = scale * previous + shift``, held between ``low`` and
    ``high``; ``previous`` starts at ``init``.  Each part may be an expression over
    the row: ``scale`` 0 restarts the fold, 1 (the default) accumulates, values in
    between decay.  A NULL part counts as its default.

    Such steps compose into steps of the same kind, so a group of any size is
    folded block by block in parallel.  The result is a double.

    Without ``scale``, ``low`` and ``high`` the fold is ``init`` plus a running total: Spark
    computes it as such, in the type that sums of ``shift`` have, so longs and decimals
    stay exact.
    """
    require(df, group_by)
    if scale is None and low is None and high is None:
        step = F.expr(shift) if isinstance(shift, str) else shift
        order = sort_keys(df, order_by, tie_break)
        return _additive_fold(df, field, init, step, group_by, order, group_rows)
    parts_of_step = {
        "__scale": (scale, 1.0),
        "__shift": (shift, 0.0),
        "__low": (low, -float("inf")),
        "__high": (high, float("inf")),
    }
    # the order is settled on the input columns before the step columns join them
    order = sort_keys(df, order_by, tie_break)
    stepped = df.withColumns({n: _number(part, default) for n, (part, default) in parts_of_step.items()})
    parts = split_by_group_size(stepped, group_by, group_rows)
    results = []
    if parts.cold is not None:
        window = Window.partitionBy(*cols(group_by)).orderBy(*order)
        opens = F.when(F.row_number().over(window) == 1, F.lit(float(init)))
        results.append(_fold_in_order(parts.cold.withColumn("__opens", opens), field))
    if parts.hot is not None:
        rows = with_block(numbered(parts.hot, group_by, order, parts.hot_rows, group_rows), group_rows)
        carried = _carried_states(rows, group_by, _compose_steps, _apply_block(float(init)), _STEP_STATE)
        window = Window.partitionBy(*cols(group_by), F.col(BLOCK)).orderBy(POSITION)
        before = F.coalesce(F.col("__state_value"), F.lit(float(init)))
        opens = F.when(F.row_number().over(window) == 1, before)
        kept = [c for c in carried.columns if c not in (POSITION, BLOCK, "__known") and not c.startswith("__state_")]
        results.append(_fold_in_order(carried.withColumn("__opens", opens).select(*cols(kept), "__opens"), field))
    return results[0] if len(results) == 1 else results[0].unionByName(results[1])


def _additive_fold(df, field, init, step, group_by, order, group_rows) -> DataFrame:
    kind = df.select(F.sum(step).alias("s")).schema["s"].dataType
    start = F.lit(init).cast(kind)
    stepped = df.withColumn("__step", F.coalesce(step, F.lit(0).cast(df.select(step.alias("s")).schema["s"].dataType)))

    def on_window(part: DataFrame, window: WindowSpec) -> DataFrame:
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return part.withColumn("__fold", (F.sum("__step").over(frame) + start).cast(kind))

    def on_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
        total = sum_over_blocks(rows, "__step", group_by, block_rows, "__sum")
        return total.withColumn("__fold", (F.col("__sum") + start).cast(kind)).drop("__sum")

    out = in_ordered_groups(stepped, group_by, order, on_window, on_blocks, group_rows)
    kept = [c for c in df.columns if c != field]
    return out.select(*cols(kept), F.col("__fold").alias(field))


_STEP_STATE = "a double, b double, lo double, hi double, value double"


def _number(part: Column | str | None, default: float) -> Column:
    if part is None:
        return F.lit(default)
    return F.coalesce((F.expr(part) if isinstance(part, str) else part).cast("double"), F.lit(default))


def _steps(rows: pa.Table | pa.RecordBatch) -> list[tuple[float, float, float, float]]:
    columns = [rows.column(n).to_pylist() for n in ("__scale", "__shift", "__low", "__high")]
    return list(zip(*columns, strict=True))


def _compose_steps(rows: pa.Table) -> dict:
    """A stretch of steps as one: x becomes a * x + b held between lo and hi."""
    a, b, lo, hi = 1.0, 0.0, -float("inf"), float("inf")
    for scale, shift, low, high in _steps(rows):
        if scale == 0.0:  # a restart forgets everything before it, bounds included
            a, b, lo, hi = 0.0, shift, shift, shift
        else:
            a, b, lo, hi = scale * a, scale * b + shift, scale * lo + shift, scale * hi + shift
            if scale < 0.0:
                lo, hi = hi, lo
        lo, hi = min(high, max(low, lo)), min(high, max(low, hi))
    return {"a": a, "b": b, "lo": lo, "hi": hi}


def _apply_block(init: float) -> Callable[[dict | None, dict], dict]:
    def combine(before: dict | None, block: dict) -> dict:
        value = init if before is None else before["value"]
        return {"value": min(block["hi"], max(block["lo"], block["a"] * value + block["b"]))}

    return combine


def _fold_in_order(rows: DataFrame, field: str) -> DataFrame:
    """Fold rows as they come: the window below has sorted every stretch.

    A row with a value in ``__opens`` starts a stretch from that value.  Partitions
    stream through in Arrow batches whatever the sizes of their groups.
    """
    helpers = ("__scale", "__shift", "__low", "__high", "__opens")
    kept = [f for f in rows.schema.fields if f.name not in (*helpers, field)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = 0.0
        for batch in batches:
            values = []
            for opens, (scale, shift, low, high) in zip(batch.column("__opens").to_pylist(), _steps(batch), strict=True):
                if opens is not None:
                    value = opens
                value = min(high, max(low, scale * value + shift))
                values.append(value)
            columns = [batch.column(n) for n in names] + [pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, field])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(field, T.DoubleType())]))


def _opened(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Sort every stretch (rows of the same keys) and mark its first row in ``__opens``."""
    window = Window.partitionBy(*cols(keys)).orderBy(*order)
    return rows.withColumn("__opens", F.row_number().over(window) == 1)


_BATCH_ROWS = 10_000


def _emit_stretches(rows: DataFrame, columns, emit, state_fields, schema) -> DataFrame:
    """Hand each stretch to ``emit``; small stretches share Arrow batches both ways."""
    target = to_arrow_schema(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))
    columns = list(columns)

    def emitted(table: pa.Table) -> pa.Table:
        before = None
        if state_fields and table.column("__known")[0].as_py():
            before = {f: table.column(f"__state_{f}")[0].as_py() for f in state_fields}
        return emit(table.select(columns), before).select(target.names).cast(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, ready_rows = [], 0
        for table in _stretches(batches):
            ready.append(emitted(table))
            ready_rows += ready[-1].num_rows
            if ready_rows >= _BATCH_ROWS:
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
                ready, ready_rows = [], 0
        if ready:
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The stretches that ``__opens`` marks, each as one table; one that batches cut is put together."""
    stretch: list[pa.RecordBatch] = []
    for batch in batches:
        cut = 0
        for start in np.flatnonzero(batch.column("__opens").to_numpy(zero_copy_only=False)).tolist():
            if start > cut:
                stretch.append(batch.slice(cut, start - cut))
            if stretch:
                yield pa.Table.from_batches(stretch).combine_chunks()
            stretch, cut = [], start
        if cut < batch.num_rows:
            stretch.append(batch.slice(cut))
    if stretch:
        yield pa.Table.from_batches(stretch).combine_chunks()


def _summed(batches, summarise, names) -> Iterator[tuple[pa.Table, dict]]:
    """The named columns of each block's first row, and the effect of the block."""
    for table in _stretches(batches):
        yield table.select(names).slice(0, 1), summarise(table.drop_columns([BLOCK, "__opens"]))


def _chunked(pairs: Iterator[tuple[Any, Any]], size: int) -> Iterator[tuple[tuple, tuple]]:
    """Up to ``size`` pairs at a time, as two sequences."""
    while some := list(islice(pairs, size)):
        yield tuple(zip(*some, strict=True))


def _carried_states(rows, keys, summarise, combine, state):
    """Add ``__state_*``, the state before each block, and ``__known``, false for a first block."""
    fields = T.StructType.fromDDL(state).fields
    names = [f.name for f in fields]
    ids = [T.StructField(f"__id_{i}", rows.schema[k].dataType) for i, k in enumerate(keys)]
    id_names = [f.name for f in ids]
    state_fields = [T.StructField(f"__state_{f.name}", f.dataType) for f in fields]
    summary_schema = T.StructType([*ids, T.StructField("__id_block", T.LongType()), *state_fields])
    carry_schema = T.StructType([*summary_schema.fields, T.StructField("__known", T.BooleanType())])
    key_list = list(keys)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(summary_schema)
        for heads, effects in _chunked(_summed(batches, summarise, [*key_list, BLOCK]), _BATCH_ROWS):
            head = pa.concat_tables(heads)
            out = {i: head.column(k) for i, k in zip(id_names, key_list, strict=True)}
            out["__id_block"] = head.column(BLOCK)
            for field in state_fields:
                name = field.name.removeprefix("__state_")
                out[field.name] = pa.array([e.get(name) for e in effects], target.field(field.name).type)
            yield from pa.table(out).select(target.names).cast(target).combine_chunks().to_batches()

    def carries(table: pa.Table) -> pa.Table:
        table = table.sort_by("__id_block")
        before, states = None, []
        for row in table.select([f"__state_{n}" for n in names]).to_pylist():
            states.append(before)
            before = combine(before, {n: row[f"__state_{n}"] for n in names})
        out = {n: table.column(n) for n in [*id_names, "__id_block"]}
        for n in names:
            out[f"__state_{n}"] = [None if s is None else s.get(n) for s in states]
        return pa.table({**out, "__known": [s is not None for s in states]})

    # Blocks stream through in order: a group of its own for each would cost more than a small block's work.
    blocks = _opened(rows, [*keys, BLOCK], [F.col(POSITION)]).drop(POSITION).mapInArrow(summaries, summary_schema)
    carried = blocks.groupBy(*id_names).applyInArrow(_cast_to(carries, carry_schema), carry_schema)
    pairs = zip(keys, id_names, strict=True)
    same = (F.col(BLOCK) == F.col("__id_block")) & all_equal((col(k), F.col(i)) for k, i in pairs)
    return rows.join(carried, same).drop("__id_block", *id_names)


def _cast_to(fn, schema: T.StructType):
    target = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        return fn(table).select(target.names).cast(target)

    return run
