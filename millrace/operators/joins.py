"""Null-safe joins, the three-output join and the append of every source row."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.naming import all_equal, col, cols, require
from millrace.operators.positions import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    HOT_ROWS,
    fits_broadcast,
    heavy_keys,
    partitions_for,
    row_bytes,
)

HOWS = ("inner", "left", "right", "full", "left_anti")


class JoinOut(NamedTuple):
    joined: DataFrame
    left_only: DataFrame
    right_only: DataFrame


def join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    how: str = "inner",
    null_safe: bool = True,
    suffix: str = "_right",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Equi-join in which NULL keys match each other (``null_safe=False``: SQL ``=``).

    The result holds every left column, then the right columns without the keys;
    a right column whose name is taken gets ``suffix``.  Right and full joins show
    the right key under the left name where the left side is missing.

    Inner and anti joins leave a hot key to adaptive skew splitting.  An outer join
    cannot split its optional side, so when a key there exceeds ``hot_rows`` it is
    put together from the inner join and the unmatched rows, which can be split.
    """
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}, not {how!r}")
    pair = _Pair(left, right, left_keys, right_keys, null_safe, suffix)
    if how == "left_anti":
        return pair.left_only()
    optional = {"inner": [], "left": [pair.right_side], "right": [pair.left_side], "full": [pair.left_side, pair.right_side]}
    if how != "inner" and not any(_has_hot_key(side, hot_rows) for side in optional[how]):
        return pair.native(how)
    out = pair.native("inner")
    if how in ("left", "full"):
        out = out.unionByName(pair.left_only(), allowMissingColumns=True)
    if how in ("right", "full"):
        out = out.unionByName(pair.right_only_as_output(), allowMissingColumns=True)
    return out


def join_anchors(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    null_safe: bool = True,
    suffix: str = "_right",
) -> JoinOut:
    """Matched rows, left rows without a match, right rows without a match (lazy)."""
    pair = _Pair(left, right, left_keys, right_keys, null_safe, suffix)
    return JoinOut(pair.native("inner"), pair.left_only(), pair.right_only())


def append_fields(
    target: DataFrame, source: DataFrame, broadcast_rows: int = BROADCAST_ROWS, suffix: str = "_source"
) -> DataFrame:
    """Append the fields of every source row to every target row.

    The source is normally one row of scalars: these become constants, so that a
    filter on them reaches the scan.  Otherwise the source is measured; a small one
    is shipped to every task, and beyond that the rows meet through an equi-join on
    (source chunk, target slice), so that neither side is ever copied whole into one
    task.
    """
    source = renamed_apart(source, {c: f"{c}{suffix}" for c in source.columns if c in target.columns}, target.columns)
    if all(isinstance(f.dataType, _CONSTANT_TYPES) for f in source.schema.fields):
        head = source.limit(2).collect()
        if len(head) == 1:
            return target.withColumns(
                {f.name: F.lit(head[0][f.name]).cast(f.dataType) for f in source.schema.fields}
            )
    rows, size = source.agg(F.count(F.lit(1)), F.sum(row_bytes(source.columns))).first()
    if fits_broadcast(rows, size, broadcast_rows):
        return target.crossJoin(F.broadcast(source))
    chunks = max(partitions_for(rows, broadcast_rows), partitions_for(size, BROADCAST_BYTES))
    slices = max(1, target.sparkSession.sparkContext.defaultParallelism)
    spread = target.withColumns({"__slice": _bucket(target, slices), "__chunk": _each(chunks)})
    chunked = source.withColumns({"__source_chunk": _bucket(source, chunks), "__source_slice": _each(slices)})
    meet = (F.col("__slice") == F.col("__source_slice")) & (F.col("__chunk") == F.col("__source_chunk"))
    return spread.join(chunked, meet).select(*cols(target.columns), *cols(source.columns))


# Types whose values survive the way to the driver and back unchanged.
_CONSTANT_TYPES = (T.BooleanType, T.NumericType, T.StringType, T.DateType)


class _Pair:
    """The two sides with every name made unique, and the condition between them."""

    def __init__(self, left, right, left_keys, right_keys, null_safe, suffix):
        right_keys = list(left_keys if right_keys is None else right_keys)
        if not left_keys or len(left_keys) != len(right_keys):
            raise ValueError(f"need the same number of keys on both sides: {list(left_keys)} and {right_keys}")
        require(left, left_keys)
        require(right, right_keys)
        self.left, self.right, self.null_safe = left, right, null_safe
        self.left_keys, self.right_keys = list(left_keys), right_keys
        self.key_alias = {k: f"__right_key_{i}" for i, k in enumerate(right_keys)}
        values = [c for c in right.columns if c not in right_keys]
        self.value_alias = {c: f"{c}{suffix}" if c in left.columns else c for c in values}
        if len({*left.columns, *self.value_alias.values()}) < len(left.columns) + len(values):
            raise ValueError(f"suffix {suffix!r} does not make the right column names unique")
        self.renamed_right = right.select(
            *[col(k).alias(a) for k, a in self.key_alias.items()],
            *[col(c).alias(a) for c, a in self.value_alias.items()],
        )

    @property
    def left_side(self) -> tuple[DataFrame, list[str]]:
        return self.left, self.left_keys

    @property
    def right_side(self) -> tuple[DataFrame, list[str]]:
        return self.right, self.right_keys

    def condition(self) -> Column:
        pairs = zip(self.left_keys, self.right_keys, strict=True)
        return all_equal(((col(lk), F.col(self.key_alias[rk])) for lk, rk in pairs), self.null_safe)

    def native(self, how: str) -> DataFrame:
        joined = self.left.join(self.renamed_right, self.condition(), how)
        if how in ("right", "full"):
            shown = dict(zip(self.left_keys, self.right_keys, strict=True))
            keys = [
                F.coalesce(col(c), F.col(self.key_alias[shown[c]])).alias(c) if c in shown else col(c)
                for c in self.left.columns
            ]
            return joined.select(*keys, *cols(self.value_alias.values()))
        return joined.drop(*self.key_alias.values())

    def left_only(self) -> DataFrame:
        present = self.renamed_right.select(*self.key_alias.values()).distinct()
        return self.left.join(present, self.condition(), "left_anti")

    def right_only(self) -> DataFrame:
        alias = {k: f"__left_key_{i}" for i, k in enumerate(self.left_keys)}
        present = self.left.select(*[col(k).alias(a) for k, a in alias.items()]).distinct()
        pairs = zip(self.left_keys, self.right_keys, strict=True)
        same = all_equal(((F.col(alias[lk]), col(rk)) for lk, rk in pairs), self.null_safe)
        return self.right.join(present, same, "left_anti")

    def right_only_as_output(self) -> DataFrame:
        """Unmatched right rows under the output names; left columns are absent."""
        shown = dict(zip(self.right_keys, self.left_keys, strict=True))
        return self.right_only().select(
            *[col(k).alias(shown[k]) for k in self.right_keys],
            *[col(c).alias(a) for c, a in self.value_alias.items()],
        )


def _has_hot_key(side: tuple[DataFrame, list[str]], hot_rows: int | None) -> bool:
    if hot_rows is None:
        return False
    df, keys = side
    return not heavy_keys(df, keys, hot_rows).isEmpty()


def renamed_apart(df: DataFrame, names: dict[str, str], taken: Sequence[str]) -> DataFrame:
    clash = [n for n in names.values() if n in taken or n in df.columns]
    if clash:
        raise ValueError(f"column names already in use: {clash}")
    return df.withColumnsRenamed(names) if names else df


def _bucket(df: DataFrame, n: int) -> Column:
    """One of ``n`` buckets by the contents of the row, the same whenever it is computed."""
    return F.pmod(F.xxhash64(F.to_json(F.struct(*cols(df.columns)))), F.lit(n))


def _each(n: int) -> Column:
    return F.explode(F.expr(f"sequence(0L, {n - 1}L)"))


