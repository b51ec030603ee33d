"""Joins on inequalities: a value of the left side within bounds of the right side.

Both sides are cut at quantiles of the left values, more finely where bounds crowd.  A right row goes to every range that its bounds reach; where it
covers a range whole, it meets all left rows there without a comparison, and only at the two edges are bounds compared.
So the sides meet by an equi-join on the range, which Spark shuffles and, where a range is crowded, splits; and a right
row is copied only to ranges that give it output rows. Where further columns must be equal, only their frequent values
are cut, each into as many ranges as its own rows need.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.naming import all_equal, col, cols, require
from millrace.operators.joins import renamed_apart
from millrace.operators.positions import fits_broadcast, heavy_keys, row_bytes
from millrace.session import materialize

ROWS_PER_RANGE = 20_000
MAX_RANGES = 32**3
_FINE_RANGES = 4096
_FAN = 32
_LEFT, _RIGHT, _X, _WHOLE = "__range", "__right_range", "__x", "__whole"
_STRIDE, _RIGHT_STRIDE, _LEVEL, _RIGHT_LEVEL = "__stride", "__right_stride", "__level", "__right_level"
_MERGED = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def range_join(
    left: DataFrame,
    right: DataFrame,
    value: str,
    low: str | None = None,
    high: str | None = None,
    include_low: bool = True,
    include_high: bool = False,
    on: Sequence[str] = (),
    suffix: str = "_right",
    rows_per_range: int = ROWS_PER_RANGE,
    totals: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """All pairs with ``low <= value < high``; one bound may be left out, and either may be open or closed.

    ``value`` is a number, date or timestamp of ``left``; ``low`` and ``high`` are columns of ``right`` of the same
    kind.  NULL matches nothing; NaN is above all numbers, as in Spark.  Columns in ``on`` must also be equal.  Right
    columns whose names the left side has get ``suffix``.

    Pairs that are only counted need not be written out. ``totals`` names ``(function, left column)`` by output column;
    the functions are count (of pairs, whatever the column), sum, min and max. Instead of pairs come right rows with
    totals of some of their left rows, several of each right row: whoever groups them adds up counts and sums and takes
    the least and greatest of the others. A right row without pairs has none.
    """
    if totals is not None and any(f not in _MERGED for f, _ in totals.values()):
        raise ValueError(f"totals must be of {list(_MERGED)}")
    if low is None and high is None:
        raise ValueError("need a lower or an upper bound")
    require(left, [value, *on])
    require(right, [*(c for c in (low, high) if c), *on])
    names = {c: f"{c}{suffix}" for c in right.columns if c in left.columns}
    renamed = renamed_apart(right, names, left.columns)
    shown = [names.get(c, c) for c in right.columns if c not in on]
    x = _ordinal(left, value)
    lows = _ordinal(renamed, names.get(low, low)) if low else None
    highs = _ordinal(renamed, names.get(high, high)) if high else None
    placed, reach, cuts = left.where(x.isNotNull()), renamed, []
    bounded = [c.isNotNull() for c in (lows, highs) if c is not None]
    reach = reach.where(bounded[0] if len(bounded) == 1 else bounded[0] & bounded[1])
    if not on:
        placed, cuts = _crowded_cuts(placed, x, reach, lows, highs, rows_per_range)
    else:
        # The most frequent key sets the number of ranges; others take several of these as one, rare keys all of them.
        sizes = materialize(heavy_keys(placed, on, max(1, rows_per_range)))
        groups, most, size = sizes.agg(F.count(F.lit(1)), F.max("__size"), F.sum(row_bytes(on))).first()
        if groups:
            found = sizes.select(*[col(c).alias(f"__on_{i}") for i, c in enumerate(on)], "__size")
            found = F.broadcast(found) if fits_broadcast(groups, size) else found
            keys = [(c, f"__on_{i}") for i, c in enumerate(on)]
            crowded = placed.join(found, all_equal(((col(c), F.col(k)) for c, k in keys), null_safe=False), "left_semi")
            cuts = _cuts(crowded.select(x.alias(_X)), rows_per_range, most)
            stride = F.greatest(F.lit(1), F.floor(F.lit(len(cuts) + 1) * max(1, rows_per_range) / F.col("__size"))).cast("int")
            stride = F.coalesce(stride, F.lit(len(cuts) + 1)).alias(_STRIDE)
            same = [all_equal(((col(n.get(c, c)), F.col(k)) for c, k in keys), null_safe=False) for n in ({}, names)]
            placed = placed.join(found, same[0], "left").select(*cols(left.columns), stride)
            reach = reach.join(found, same[1], "left").select(*cols(renamed.columns), stride.alias(_RIGHT_STRIDE))
    steps = [F.col(c) if on and cuts else F.lit(1) for c in (_STRIDE, _RIGHT_STRIDE)]
    placed = placed.withColumn(_LEFT, F.floor(_place(x, cuts) / steps[0]).cast("int"))

    first = _place(lows, cuts) if low else F.lit(0)
    last = _place(highs, cuts) if high else F.lit(len(cuts))
    reach = reach.withColumns({n: F.floor(at / steps[1]).cast("int") for n, at in (("__first", first), ("__last", last))})
    reach = reach.where(F.col("__first") <= F.col("__last"))
    edges = [F.col(e) for e, bound in (("__first", low), ("__last", high)) if bound]

    # Null-safe, as Spark infers filters from plain equalities and would work out the range of one side on the other.
    meet = F.col(_LEFT).eqNullSafe(F.col(_RIGHT))
    if on:
        meet &= all_equal(((col(c), col(names[c])) for c in on), null_safe=False)
    inside = F.lit(True)
    if low:
        inside &= x >= lows if include_low else x > lows
    if high:
        inside &= x <= highs if include_high else x < highs
    if totals is None:
        whole = F.lit(True)
        if low:
            whole &= F.col(_RIGHT) > F.col("__first")
        if high:
            whole &= F.col(_RIGHT) < F.col("__last")
        reach = reach.withColumn(_RIGHT, F.explode(F.sequence("__first", "__last"))).withColumn(_WHOLE, whole)
        # Spark takes the copies for as few as the rows: they are never shipped to every task.
        found = placed.join(reach.drop("__first", "__last").hint("merge"), meet).where(F.col(_WHOLE) | inside)
        return found.select(*cols(left.columns), *cols(shown))

    own = [names.get(c, c) for c in right.columns]
    taken = [n for n in totals if n in own]
    if taken:
        raise ValueError(f"column names already in use: {taken}")
    alone = [(F.lit(1).cast("long") if f == "count" else col(c)).alias(n) for n, (f, c) in totals.items()]
    at_edges = reach.withColumn(_RIGHT, F.explode(F.array_distinct(F.array(*edges))))
    single = placed.join(at_edges.hint("merge"), meet).where(inside).select(*cols(own), *alone)
    # The ranges between the edges as few blocks of 1, 2, 4, ... ranges, each met by one row of totals.
    start = F.col("__first") + 1 if low else F.col("__first")
    end = F.col("__last") if high else F.col("__last") + 1
    levels = range(len(cuts).bit_length() + 1)
    merged = {n: _MERGED[f](col(n)).alias(n) for n, (f, _) in totals.items()}
    keys = [*on, _LEFT]
    ranges = placed.select(*cols(keys), *alone).groupBy(*cols(keys)).agg(*merged.values())
    tree = ranges.withColumn(_LEVEL, F.explode(F.array(*[F.lit(k) for k in levels])))
    tree = tree.withColumn(_LEFT, F.expr(f"shiftright({_LEFT}, {_LEVEL})")).groupBy(*cols([*keys, _LEVEL])).agg(*merged.values())
    pieces = []
    for k in levels:
        a, b = F.shiftright(start + ((1 << k) - 1), k), F.shiftright(end, k)
        pieces += [F.when((a < b) & (a % 2 == 1), _piece(k, a)), F.when((a < b) & (b % 2 == 1), _piece(k, b - 1))]
    blocks = reach.withColumn("__piece", F.explode(F.array_compact(F.array(*pieces))))
    blocks = blocks.withColumns({_RIGHT: F.col("__piece.at"), _RIGHT_LEVEL: F.col("__piece.level")})
    many = tree.join(blocks.hint("merge"), meet & F.col(_LEVEL).eqNullSafe(F.col(_RIGHT_LEVEL))).select(*cols(own), *cols(totals))
    return single.unionAll(many)


def _piece(level: int, at: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), at.cast("int").alias("at"))


def _ordinal(df: DataFrame, name: str) -> Column:
    """A number in the order of the column."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("long") * F.lit(86_400_000_000)
    if isinstance(kind, T.NumericType):
        return col(name)
    raise TypeError(f"{name} is no number, date or timestamp")


def _cuts(values: DataFrame, rows_per_range: int, rows: int | None = None) -> list:
    """Ascending distinct quantiles, at most ``MAX_RANGES``; NaN is no cut."""
    if rows is None:
        rows = values.select(F.count(_X)).first()[0]
    ranges = min(MAX_RANGES, max(2, rows // max(1, rows_per_range)))
    shares = _literal([k / ranges for k in range(1, ranges)], "double")
    found = values.select(F.percentile_approx(_X, shares, 10 * ranges)).first()[0] or []
    return sorted({c for c in found if c == c})


def _crowded_cuts(left, x, right, lows, highs, rows_per_range: int) -> tuple[DataFrame, list]:
    """The left rows that bounds can hold, and cuts after ``rows_per_range`` of them or as many bounds, whichever is first.

    Where bounds crowd, a range may hold as little as a hundredth of its rows: each bound is compared with all of them.
    """
    least = [F.min(lows)] if lows is not None else []
    most = [F.max(highs)] if highs is not None else []
    ends = list(right.agg(F.count(F.lit(1)), *least, *most).first())
    bounds, ends = ends[0], ends[1:]
    if not bounds:
        return left.where(F.lit(False)), []
    if least and ends[0] == ends[0]:  # above NaN lies nothing but NaN
        left = left.where(x >= F.lit(ends[0]))
    if most and ends[-1] == ends[-1]:
        left = left.where(x <= F.lit(ends[-1]))
    values = left.select(x.alias(_X))
    rows = values.count()
    if bounds <= rows_per_range:
        return left, _cuts(values, rows_per_range, rows)
    ranges = max(2, rows // max(1, rows_per_range))
    fine = max(1, rows // min(MAX_RANGES, max(ranges, _FINE_RANGES)), rows_per_range // 100)
    cuts = _cuts(values, fine, rows)
    edges = F.array(*[_place(b, cuts) for b in (lows, highs) if b is not None])
    counts = dict(right.select(F.explode(edges).alias("at")).groupBy("at").count().collect())
    kept, held, met = [], 0.0, 0
    for k, cut in enumerate(cuts):
        held, met = held + rows / (len(cuts) + 1), met + counts.get(k, 0)
        if held >= rows_per_range or met >= rows_per_range:
            kept.append(cut)
            held, met = 0.0, 0
    return left, kept


def _place(x: Column, cuts: list) -> Column:
    """How many cuts are at most ``x``, found in steps of ``_FAN`` branches."""
    if not cuts:
        return F.lit(0)
    step = 1
    while step * _FAN < len(cuts) + 1:
        step *= _FAN
    found = _count(x, _literal(cuts[step - 1 :: step]))
    while step > 1:
        step //= _FAN
        # An array of one number names the branch found so far, which would be worked out twice.
        found = F.transform(F.array(found), _deeper(x, _literal(cuts[step - 1 :: step])))[0]
    return found.cast("int")


def _deeper(x: Column, level: Column) -> Callable[[Column], Column]:
    # Cuts inside the branch: those after its first multiple, none of the next one.
    return lambda at: at * _FAN + _count(x, F.slice(level, at * _FAN + 1, F.lit(_FAN - 1)))


def _literal(values: list, kind: str | None = None) -> Column:
    """An array as one constant, however long: Spark folds the cast."""
    if kind is None:
        first = values[0] if values else 0
        kind = "double" if isinstance(first, float) else "bigint"
        if isinstance(first, Decimal):
            scale = max(-v.as_tuple().exponent for v in values)
            kind = f"decimal({max(scale, *(len(v.as_tuple().digits) + v.as_tuple().exponent + scale for v in values), 1)},{max(0, scale)})"
    if not values:
        return F.expr(f"cast(array() as array<{kind}>)")
    text = ",".join(format(v, "f") if isinstance(v, Decimal) else repr(v) for v in values)
    return F.expr(f"cast(split('{text}', ',') as array<{kind}>)")


def _count(x: Column, cuts: Column) -> Column:
    return F.aggregate(cuts, F.lit(0), lambda n, c: n + (c <= x).cast("int"))
