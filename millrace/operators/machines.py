"""Folds over a finite set of states, for recursions that are no arithmetic."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.naming import OrderBy, cols, require
from millrace.operators.scripts import SCRIPT_ROWS, scan_groups

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_STATES = 4096
"""Most states of a machine; a block of rows is summed up in one number per state."""

_SYMBOL, _SLICE_ROWS = "__symbol", 1 << 20

Rule = Mapping[str, str] | str


def state_fold(
    df: DataFrame,
    field: str,
    rules: Mapping[str | None, Rule],
    init: str,
    symbol: Column | str,
    group_by: Sequence[str],
    order_by: OrderBy,
    tie_break: bool = True,
    group_rows: int | None = SCRIPT_ROWS,
) -> DataFrame:
    """Add ``field``: the state of a status machine after each row.

    Every group starts in ``init``. ``symbol`` (a column name or an expression) is read as text
    and names a rule: ``{state: next}``, where states not listed stay as they are, or one state
    that all go to. Symbols without a rule change nothing; NULL is the symbol ``None``.
    States are all that ``rules`` and ``init`` mention.

    The effect of a stretch of rows is a table from the state before to the state after, and two
    such tables compose into one. So a group above ``group_rows`` is cut into blocks whose tables
    are worked out in parallel, and only these, one per block, meet in order.

    An empty table gives an empty table. A column of the name ``field`` is replaced.
    """
    require(df, group_by)
    states = _states(rules, init)
    tables = _tables(rules, states)
    codes = {s: i + 1 for i, s in enumerate(rules)}  # 0: no rule
    start = states.index(init)
    names = [c for c in df.columns if c != field]
    read = F.expr(symbol) if isinstance(symbol, str) else symbol
    rows = df.withColumn(_SYMBOL, read.cast("string"))

    def codes_of(table: pa.Table) -> np.ndarray:
        words = table.column(_SYMBOL).combine_chunks().dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        known = np.array([codes.get(w, 0) for w in words.dictionary.to_pylist()] + [codes.get(None, 0)], np.int64)
        return known[words.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]

    def summarise(table: pa.Table) -> dict:
        return {"after": _composed(tables, codes_of(table)).tolist(), "state": None}

    def combine(before: dict | None, block: dict) -> dict:
        return {"after": None, "state": block["after"][start if before is None else before["state"]]}

    def emit(table: pa.Table, before: dict | None) -> pa.Table:
        state = start if before is None else before["state"]
        steps, out = tables.tolist(), []
        for code in codes_of(table).tolist():
            state = steps[code][state]
            out.append(states[state])
        return table.select(names).append_column(field, pa.array(out, pa.string()))

    kept = [f for f in df.schema.fields if f.name != field]
    schema = T.StructType([*kept, T.StructField(field, T.StringType())])
    # the order is settled on the input's columns
    ordered = rows.select(*cols(df.columns), _SYMBOL)
    return scan_groups(
        ordered, group_by, order_by, summarise, combine, emit, "after array<int>, state int", schema, tie_break, group_rows
    )


def _states(rules: Mapping[str | None, Rule], init: str) -> list[str]:
    seen = {init: None}
    for rule in rules.values():
        named = [rule] if isinstance(rule, str) else [s for pair in rule.items() for s in pair]
        seen.update(dict.fromkeys(named))
    if len(seen) > MAX_STATES:
        raise ValueError(f"{len(seen)} states; at most {MAX_STATES} can be folded")
    return list(seen)


def _tables(rules: Mapping[str | None, Rule], states: list[str]) -> np.ndarray:
    """Row 0 changes nothing; row i + 1 is the effect of the i-th symbol on each state."""
    at = {s: i for i, s in enumerate(states)}
    tables = np.tile(np.arange(len(states), dtype=np.int32), (len(rules) + 1, 1))
    for row, rule in zip(tables[1:], rules.values(), strict=True):
        if isinstance(rule, str):
            row[:] = at[rule]
        else:
            for before, after in rule.items():
                row[at[before]] = at[after]
    return tables


def _composed(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The effect of all rows in turn, neighbours composed pair by pair."""
    whole = tables[0]
    step = max(1, _SLICE_ROWS // tables.shape[1])
    for at in range(0, len(codes), step):
        effects = tables[codes[at : at + step]]
        while len(effects) > 1:
            if len(effects) % 2:
                effects = np.concatenate([effects, tables[:1]])
            effects = np.take_along_axis(effects[1::2], effects[0::2].astype(np.int64), axis=1)
        whole = effects[0][whole]
    return whole
