"""Checks that two tables hold the same rows, profiles, layer checks and test data."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.naming import col, cols, require
from millrace.operators.positions import fits_broadcast
from millrace.session import local_table, materialize

# Tolerances of aggregate comparison (fixed values).
RELATIVE_TOLERANCE = 1e-9
ABSOLUTE_TOLERANCE = 1e-12

SAMPLE_ROWS = 20

_KEY_FUNCS = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


class RowParity(NamedTuple):
    """``summary``: one row; ``extra`` / ``missing``: differing rows with their surplus count."""

    summary: DataFrame
    extra: DataFrame
    missing: DataFrame
    compared: list[str]


def compare_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: both row counts and whether they agree."""
    return _both(source, target, []).agg(
        F.count_if("__source").alias("source_count"), F.count_if(~F.col("__source")).alias("target_count")
    ).withColumn("matches", F.col("source_count") == F.col("target_count"))


def column_checksum(name: str) -> Column:
    """Order-independent checksum of a column, NULLs included, salted with its name.

    The sum of all 64-bit hashes as a whole number: three parts of each are summed as
    longs, which holds for 4 * 10^12 rows even where all have the same value.
    """
    zero = F.lit(0).cast(_WIDE)
    sums = [F.sum(p).cast(_WIDE) * F.lit(1 << shift).cast("decimal(17,0)") for p, shift in _hash_parts(name)]
    return F.coalesce((sums[0].cast(_WIDE) + sums[1].cast(_WIDE) + sums[2].cast(_WIDE)).cast(_WIDE), zero)


_WIDE = "decimal(38,0)"
_PART_BITS = 21


def _hash_parts(name: str) -> list[tuple[Column, int]]:
    """The hash of a value in three numbers, with the bits each stands above."""
    value = F.xxhash64(F.lit(name), col(name).isNull(), col(name))
    low = (1 << _PART_BITS) - 1
    return [
        (F.shiftright(value, 2 * _PART_BITS), 2 * _PART_BITS),
        (F.shiftright(value, _PART_BITS).bitwiseAND(F.lit(low)), _PART_BITS),
        (value.bitwiseAND(F.lit(low)), 0),
    ]


def column_checksums(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, one checksum per column, in a single pass."""
    names = list(df.columns if columns is None else columns)
    require(df, names)
    return df.agg(*[column_checksum(n).alias(n) for n in names])


def compare_checksums(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: both checksums and whether they agree, from one pass over each side."""
    rows = column_checksums(source, columns).select(F.lit(True).alias("__source"), *cols(columns)).unionAll(
        column_checksums(target, columns).select(F.lit(False).alias("__source"), *cols(columns))
    )
    long = rows.unpivot("__source", cols(columns), "column", "checksum")
    return (
        long.groupBy("column")
        .agg(
            F.max(F.when(F.col("__source"), F.col("checksum"))).alias("source_checksum"),
            F.max(F.when(~F.col("__source"), F.col("checksum"))).alias("target_checksum"),
        )
        .withColumn("matches", F.col("source_checksum") == F.col("target_checksum"))
    )


def compare_key_aggregates(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], func: str = "sum"
) -> DataFrame:
    """Per key and column whose aggregates differ: both values.

    ``count`` counts rows, NULL or not; the others skip NULLs.  Sums may differ by
    rounding within the tolerances.  A key only one side has is always reported.
    Both sides are summed in one aggregation, so they meet without a join.
    """
    if func not in _KEY_FUNCS:
        raise ValueError(f"unknown aggregate {func!r}; have {sorted(_KEY_FUNCS)}")
    for side in (source, target):
        require(side, [*keys, *columns])
    names = [*keys, *columns]
    rows = _both(source, target, names)
    is_source = F.col("__source")
    merged = rows.groupBy(*cols(keys)).agg(
        F.count_if(is_source).alias("__in_source"),
        F.count_if(~is_source).alias("__in_target"),
        *[_key_value(func, c, is_source).alias(f"__source_{i}") for i, c in enumerate(columns)],
        *[_key_value(func, c, ~is_source).alias(f"__target_{i}") for i, c in enumerate(columns)],
    )
    one_sided = (F.col("__in_source") == 0) | (F.col("__in_target") == 0)
    differing = [
        F.when(
            one_sided | ~_close(F.col(f"__source_{i}"), F.col(f"__target_{i}")),
            F.struct(
                F.lit(c).alias("column"),
                F.lit(func).alias("func"),
                F.col(f"__source_{i}").alias("source_value"),
                F.col(f"__target_{i}").alias("target_value"),
            ),
        )
        for i, c in enumerate(columns)
    ]
    found = merged.select(*cols(keys), F.explode(F.array_compact(F.array(*differing))).alias("__found"))
    return found.select(*cols(keys), "__found.*")


def _key_value(func: str, column: str, side: Column) -> Column:
    """The aggregate of one side; NULL, like a group that is not there, when it has no rows."""
    if func == "count":
        return F.nullif(F.count_if(side), F.lit(0).cast("long")).cast("double")
    return _KEY_FUNCS[func](F.when(side, col(column))).cast("double")


def _balanced(prefix: str) -> Column:
    """Whether all three parts add up to nothing; sums beyond a long do not."""
    sums = [F.col(f"{prefix}{k * _PART_BITS}") for k in range(3)]
    none = [F.coalesce(F.try_sum(x), F.count(x)) == 0 for x in sums]
    return none[0] & none[1] & none[2]


def parity_report(
    source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str], func: str = "sum"
) -> DataFrame:
    """One row per check with its outcome, and a last one, ``all``, for the whole gate.

    Each side is read once: row counts and checksums are the sums of what each key
    contributes, and a key's aggregates differ or not.
    """
    if func not in _KEY_FUNCS:
        raise ValueError(f"unknown aggregate {func!r}; have {sorted(_KEY_FUNCS)}")
    names = list(dict.fromkeys([*keys, *values]))
    for side in (source, target):
        require(side, names)
    is_source = F.col("__source")
    by_key = _both(source, target, names).groupBy(*cols(keys)).agg(
        F.count_if(is_source).alias("__in_source"),
        F.count_if(~is_source).alias("__in_target"),
        *[
            F.sum(F.when(is_source, part).otherwise(-part)).alias(f"__balance_{i}_{shift}")
            for i, c in enumerate(names)
            for part, shift in _hash_parts(c)
        ],
        *[_key_value(func, c, is_source).alias(f"__source_{i}") for i, c in enumerate(values)],
        *[_key_value(func, c, ~is_source).alias(f"__target_{i}") for i, c in enumerate(values)],
    )
    one_sided = (F.col("__in_source") == 0) | (F.col("__in_target") == 0)
    zero = F.lit(0).cast("long")
    outcomes = by_key.agg(
        (F.coalesce(F.sum("__in_source"), zero) == F.coalesce(F.sum("__in_target"), zero)).alias("rows"),
        *[_balanced(f"__balance_{i}_").alias(f"sum_{i}") for i in range(len(names))],
        *[
            (F.count_if(one_sided | ~_close(F.col(f"__source_{i}"), F.col(f"__target_{i}"))) == 0).alias(f"key_{i}")
            for i in range(len(values))
        ],
    )
    checks = [("row_count", "*", F.col("rows"))]
    checks += [("checksum", c, F.col(f"sum_{i}")) for i, c in enumerate(names)]
    checks += [("key_aggregate", c, F.col(f"key_{i}")) for i, c in enumerate(values)]
    every = checks[0][2]
    for _, _, passed in checks[1:]:
        every &= passed
    checks.append(("all", "*", every))
    listed = [F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), p.alias("passed")) for k, c, p in checks]
    return outcomes.select(F.explode(F.array(*listed)).alias("__check")).select("__check.*")


def row_parity(migrated: DataFrame, expected: DataFrame, ignore: Sequence[str] = ()) -> RowParity:
    """Compare the shared columns as text, row by row, as multisets.

    One shuffle counts every distinct row on both sides; copies of a row are
    counted, never written out.
    """
    compared = _shared_columns(migrated, expected, ignore)
    text = [col(c).cast("string").alias(c) for c in compared]
    sides = migrated.select(*text, F.lit(1).alias("__n")).unionAll(expected.select(*text, F.lit(-1).alias("__n")))
    balance = sides.groupBy(*cols(compared)).agg(
        F.sum("__n").alias("__surplus"), F.count_if(F.col("__n") > 0).alias("__migrated"),
        F.count_if(F.col("__n") < 0).alias("__expected"),
    )
    none = F.lit(0).cast("long")
    summary = balance.agg(
        F.coalesce(F.sum("__migrated"), none).alias("migrated_count"),
        F.coalesce(F.sum("__expected"), none).alias("expected_count"),
        F.coalesce(F.sum(F.greatest("__surplus", none)), none).alias("extra_rows"),
        F.coalesce(F.sum(F.greatest(-F.col("__surplus"), none)), none).alias("missing_rows"),
    ).withColumn("passed", (F.col("extra_rows") == 0) & (F.col("missing_rows") == 0))
    extra = balance.where(F.col("__surplus") > 0).select(*cols(compared), F.col("__surplus").alias("copies"))
    missing = balance.where(F.col("__surplus") < 0).select(*cols(compared), (-F.col("__surplus")).alias("copies"))
    return RowParity(summary, extra, missing, compared)


class Pruned(NamedTuple):
    """The rows of both sides that a checksum tree could not settle, and the counts of all rows."""

    migrated: DataFrame
    expected: DataFrame
    migrated_count: int
    expected_count: int
    differing: int


TREE_BITS = 12
TREE_LEVELS = 2
_PLACE, _BUCKET = "__place", "__bucket"


def rows_to_compare(
    migrated: DataFrame,
    expected: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] | None = None,
    bits: int = TREE_BITS,
    levels: int = TREE_LEVELS,
) -> Pruned:
    """Leave out the rows of all hash buckets whose checksums agree.

    Rows fall into ``2 ** bits`` buckets by a hash of ``keys`` (all ``columns`` if None), and of
    each bucket both sides add up rows and two 64-bit hashes of whole rows. Only buckets that
    differ are read again and divided, ``bits`` further bits a level. What moves between tasks
    is one row per bucket and task; rows stay where they are. Two buckets that differ are taken
    for equal with a chance of 2 ** -128.

    Dividing stops early where most buckets differ, for then little can be saved, and where
    their list would be too long to ship. Both sides are read once if nothing differs.
    """
    if not 1 <= bits <= 16 or levels < 1 or bits * levels > 48:
        raise ValueError("bits must be 1 to 16, levels at least 1, and both at most 48 bits together")
    for side in (migrated, expected):
        require(side, [*columns, *(keys or [])])
    place = _text_hash(keys if keys is not None else columns, "place")

    def contents(df: DataFrame, sign: int) -> DataFrame:
        row = [_text_hash(columns, salt) for salt in ("first", "second")]
        return df.select(place.alias(_PLACE), F.lit(sign).alias("__n"), *[h.alias(f"__h{i}") for i, h in enumerate(row)])

    both = contents(migrated, 1).unionAll(contents(expected, -1))
    low = (1 << _PART_BITS) - 1
    pieces = [
        F.shiftrightunsigned(f"__h{i}", shift).bitwiseAND(F.lit(low)) for i in range(2) for shift in (0, _PART_BITS, 2 * _PART_BITS)
    ] + [F.shiftrightunsigned(f"__h{i}", 3 * _PART_BITS) for i in range(2)]
    balances = [F.sum(F.col("__n") * p).alias(f"__b{i}") for i, p in enumerate(pieces)]

    def level_of(rows: DataFrame, level: int) -> DataFrame:
        return rows.groupBy(_bucket_at(level, bits).alias(_BUCKET)).agg(
            F.count_if(F.col("__n") > 0).alias("__migrated"), F.count_if(F.col("__n") < 0).alias("__expected"),
            F.sum("__n").alias("__surplus"), *balances,
        )

    differs = F.col("__surplus") != 0
    for i in range(len(pieces)):
        differs |= F.col(f"__b{i}") != 0
    zero = F.lit(0).cast("long")
    top = level_of(both, 1).agg(
        F.coalesce(F.sum("__migrated"), zero), F.coalesce(F.sum("__expected"), zero),
        F.collect_list(F.when(differs, F.col(_BUCKET))),  # at most 2 ** bits numbers
    ).first()
    spark = migrated.sparkSession
    found, level, count = local_table(spark, [(b,) for b in top[2]], f"{_BUCKET} long"), 1, len(top[2])
    while count and level < levels and count <= (1 << bits) // 4:
        deeper = materialize(level_of(_in_buckets(both, found, F.col(_PLACE), level, bits), level + 1).where(differs).select(_BUCKET))
        size = deeper.count()
        if not fits_broadcast(size, 8 * size):
            break
        found, level, count = deeper, level + 1, size

    def left(df: DataFrame) -> DataFrame:
        kept = df.select(*cols(dict.fromkeys([*columns, *(keys or [])])))
        return _in_buckets(kept, found, place, level, bits) if count else kept.where(F.lit(False))

    return Pruned(left(migrated), left(expected), top[0], top[1], count)


def _text_hash(columns: Sequence[str], salt: str) -> Column:
    """A hash of the columns as text; NULL and its place count."""
    return F.xxhash64(F.lit(salt), *[x for c in columns for x in (col(c).isNull(), col(c).cast("string"))])


def _bucket_at(level: int, bits: int) -> Column:
    return F.shiftrightunsigned(_PLACE, 64 - level * bits)


def _in_buckets(rows: DataFrame, found: DataFrame, place: Column, level: int, bits: int) -> DataFrame:
    """Rows whose bucket is in ``found``, which has been counted and is small."""
    wanted = found.withColumnRenamed(_BUCKET, "__wanted")
    at = F.shiftrightunsigned(place, 64 - level * bits)
    return rows.join(F.broadcast(wanted), at == F.col("__wanted"), "left_semi")


def row_parity_tree(
    migrated: DataFrame,
    expected: DataFrame,
    keys: Sequence[str] | None = None,
    ignore: Sequence[str] = (),
    bits: int = TREE_BITS,
    levels: int = TREE_LEVELS,
) -> RowParity:
    """``row_parity`` for tables that mostly agree: only rows of differing buckets are shuffled.

    With ``keys``, both versions of a changed row lie in one bucket, so fewer buckets differ.
    The checksums are worked out by this call, so the inputs must be deterministic.
    """
    compared = _shared_columns(migrated, expected, ignore)
    pruned = rows_to_compare(migrated, expected, compared, keys, bits, levels)
    found = row_parity(pruned.migrated.select(*cols(compared)), pruned.expected.select(*cols(compared)))
    counts = {
        "migrated_count": F.lit(pruned.migrated_count).cast("long"),
        "expected_count": F.lit(pruned.expected_count).cast("long"),
    }
    return found._replace(summary=found.summary.withColumns(counts))


def _shared_columns(migrated: DataFrame, expected: DataFrame, ignore: Sequence[str]) -> list[str]:
    ignored = {c.strip().lower() for c in ignore}
    compared = [c for c in migrated.columns if c in expected.columns and c.lower() not in ignored]
    if not compared:
        raise ValueError(f"no column to compare: {migrated.columns} and {expected.columns}")
    return compared


def difference_sample(differing: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """A few differing rows to look at, always the same ones."""
    return differing.orderBy(*cols(differing.columns)).limit(n)


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, NULLs and their share; one pass over all columns."""
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(col(c).isNull()).alias(c) for c in df.columns]
    )
    long = counted.unpivot(["__rows"], cols(df.columns), "column", "null_count")
    return long.select(
        "column",
        F.col("__rows").alias("row_count"),
        "null_count",
        F.when(F.col("__rows") > 0, F.col("null_count") / F.col("__rows")).alias("null_share"),
    )


def validate(df: DataFrame) -> DataFrame:
    """One row: rows, columns, NULL counts per column, surplus copies of whole rows, passed.

    Each distinct row is counted once with its copies, so rows, duplicates and NULLs
    all come out of one aggregation.
    """
    distinct = df.groupBy(*cols(df.columns)).agg(F.count(F.lit(1)).alias("__copies"))
    none = F.lit(0).cast("long")
    nulls = [
        F.coalesce(F.sum(F.when(col(c).isNull(), F.col("__copies"))), none).alias(c) for c in df.columns
    ]
    return distinct.agg(
        F.coalesce(F.sum("__copies"), none).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.struct(*nulls).alias("null_counts"),
        (F.coalesce(F.sum("__copies"), none) - F.count(F.lit(1))).alias("duplicate_rows"),
    ).withColumn("passed", F.col("row_count") > 0)


# First day and days of generated dates (fixed values).
_EPOCH = "2020-01-01"
_DAYS = 3650


def synthetic(spark: SparkSession, schema: T.StructType, n: int, seed: int = 42) -> DataFrame:
    """``n`` reproducible rows for a schema, the same under any partitioning.

    Nullable fields are NULL in about one row of ten.  A field with metadata
    ``{"key": True}`` repeats: integers every three rows, strings over seven values.
    Other values: integers within +-1000, floats likewise with two decimals, dates
    and times in the ten years from 2020, strings ``val_0 .. val_9999``.
    """
    out = [_synthetic_value(f, seed).alias(f.name) for f in schema.fields]
    return spark.range(n).select(*out)


def _synthetic_value(field: T.StructField, seed: int) -> Column:
    def draw(purpose: str, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(field.name), F.lit(purpose), F.col("id")), F.lit(below))

    kind = field.dataType
    whole = isinstance(kind, T.IntegralType)
    if (field.metadata or {}).get("key"):
        value = F.expr("id div 3") if whole else F.concat(F.lit("K"), (F.col("id") % 7).cast("string"))
    elif whole:
        value = draw("value", 2001) - 1000
    elif isinstance(kind, T.FractionalType):
        value = (draw("value", 200_001) - 100_000) / 100
    elif isinstance(kind, T.BooleanType):
        value = draw("value", 2) == 0
    elif isinstance(kind, T.DateType):
        value = F.date_add(F.lit(_EPOCH).cast("date"), draw("value", _DAYS + 1).cast("int"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.timestamp_add("SECOND", draw("value", _DAYS * 86_400 + 1), F.lit(_EPOCH).cast(kind))
    elif isinstance(kind, T.StringType):
        value = F.concat(F.lit("val_"), draw("value", 10_000).cast("string"))
    else:
        raise ValueError(f"no synthetic values for type {kind.simpleString()}")
    value = value.cast(kind)
    return F.when(draw("null", 10) != 0, value) if field.nullable else value


def check_layers(bronze: DataFrame, silver: DataFrame, gold: DataFrame, keys: Sequence[str], gold_keys: Sequence[str]) -> DataFrame:
    """One row per layer rule: layer, rule, offending rows, passed.

    Bronze carries the audit columns of a single source and keeps every row; silver has audit columns
    and one row per key; gold has one row per grouping key and no more rows than silver.
    """
    sources = (
        bronze.agg(F.count_distinct("_source_system").alias("n"))
        if "_source_system" in bronze.columns
        else bronze.agg(F.lit(0).cast("long").alias("n"))
    )
    has_audit = {"_ingested_at", "_source_system"} <= set(silver.columns)
    audit = silver.agg(
        F.count_if(F.col("_ingested_at").isNull() | F.col("_source_system").isNull()).alias("bad")
        if has_audit
        else F.count(F.lit(1)).alias("bad")
    )
    rules = [
        sources.select(F.lit("bronze").alias("layer"), F.lit("single_source").alias("rule"), F.abs(F.col("n") - 1).alias("offending")),
        audit.select(F.lit("silver").alias("layer"), F.lit("audit_columns").alias("rule"), F.col("bad").alias("offending")),
        _surplus(silver, keys).select(F.lit("silver").alias("layer"), F.lit("unique_keys").alias("rule"), "offending"),
        _surplus(gold, gold_keys).select(F.lit("gold").alias("layer"), F.lit("one_row_per_group").alias("rule"), "offending"),
        compare_counts(gold, silver).select(
            F.lit("gold").alias("layer"),
            F.lit("not_larger_than_silver").alias("rule"),
            F.greatest(F.col("source_count") - F.col("target_count"), F.lit(0).cast("long")).alias("offending"),
        ),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out.withColumn("passed", F.col("offending") == 0)


def _surplus(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    sizes = df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("offending"))


def _both(source: DataFrame, target: DataFrame, names: Sequence[str]) -> DataFrame:
    return source.select(F.lit(True).alias("__source"), *cols(names)).unionAll(
        target.select(F.lit(False).alias("__source"), *cols(names))
    )


def _close(a: Column, b: Column) -> Column:
    allowed = F.greatest(F.lit(RELATIVE_TOLERANCE) * F.greatest(F.abs(a), F.abs(b)), F.lit(ABSOLUTE_TOLERANCE))
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= allowed, F.lit(False))


