"""Parity, profile and layer-check queries."""

from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators.columns import add_audit_columns, select_columns
from millrace.operators.lookalike import likeness, profile, rows_like
from millrace.operators.quality import (
    check_layers,
    compare_checksums,
    compare_counts,
    compare_key_aggregates,
    difference_sample,
    null_profile,
    parity_report,
    row_parity,
    row_parity_tree,
    validate,
)
from millrace.operators.sets import union_all
from millrace.operators.summarize import Agg, summarize
from millrace.plans.registry import ORACLES, query

_COLUMNS = ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]


def _copies(t):
    """Lines, and a copy in which some are lost and some changed."""
    lines = select_columns(t.lineitem, _COLUMNS)
    changed = F.when(F.col("l_orderkey") % 97 == 5, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    copy = lines.where("not (l_suppkey % 10 = 3 and l_linenumber = 7)").withColumn("l_quantity", changed)
    return lines, copy


_COPIES = """
WITH a AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem),
     b AS (SELECT l_suppkey, l_orderkey, l_linenumber,
                  CASE WHEN l_orderkey % 97 = 5 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag
           FROM lineitem WHERE NOT (l_suppkey % 10 = 3 AND l_linenumber = 7))
"""


@query(f"""{_COPIES}
SELECT (SELECT count(*) FROM a) AS source_count, (SELECT count(*) FROM b) AS target_count,
       (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS matches
""")
def parity_counts(t):
    return compare_counts(*_copies(t))


def _same_values(column, b="b"):
    """SQL: whether a column holds the same multiset of values in both tables."""
    return (
        f"NOT EXISTS (SELECT {column} FROM a EXCEPT ALL SELECT {column} FROM {b})"
        f" AND NOT EXISTS (SELECT {column} FROM {b} EXCEPT ALL SELECT {column} FROM a)"
    )


def _same_sums(column, func="sum"):
    """SQL: whether a column has the same aggregate for every supplier."""
    per_key = f"SELECT l_suppkey, {func}({column}) FROM"
    return (
        f"NOT EXISTS ({per_key} a GROUP BY 1 EXCEPT {per_key} b GROUP BY 1)"
        f" AND NOT EXISTS ({per_key} b GROUP BY 1 EXCEPT {per_key} a GROUP BY 1)"
    )


@query(
    """
WITH a AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem),
     b AS (SELECT l_suppkey, l_orderkey, l_linenumber,
                  CASE WHEN l_orderkey % 97 = 5 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem)
"""
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {_same_values(c)} AS matches""" for c in _COLUMNS)
)
def checksums(t):
    """Only the changed column differs; the copy is also shuffled."""
    lines = select_columns(t.lineitem, _COLUMNS)
    changed = F.when(F.col("l_orderkey") % 97 == 5, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    copy = lines.withColumn("l_quantity", changed).repartition(7)
    return compare_checksums(lines, copy, _COLUMNS).select("column", "matches")


@query(f"""{_COPIES},
x AS (SELECT l_suppkey, sum(l_quantity) AS v FROM a GROUP BY 1), y AS (SELECT l_suppkey, sum(l_quantity) AS v FROM b GROUP BY 1)
SELECT coalesce(x.l_suppkey, y.l_suppkey) AS l_suppkey, 'l_quantity' AS "column", 'sum' AS func,
       x.v AS source_value, y.v AS target_value
FROM x FULL JOIN y ON x.l_suppkey = y.l_suppkey WHERE x.v IS DISTINCT FROM y.v
""")
def key_aggregates(t):
    return compare_key_aggregates(*_copies(t), ["l_suppkey"], ["l_quantity"], "sum")


def _gate(columns, values, func):
    checks = [("row_count", "*", "(SELECT count(*) FROM a) = (SELECT count(*) FROM b)")]
    checks += [("checksum", c, _same_values(c)) for c in columns]
    checks += [("key_aggregate", c, _same_sums(c, func)) for c in values]
    rows = " UNION ALL ".join(
        f"""SELECT '{check}' AS "check", '{c}' AS "column", {passed} AS passed""" for check, c, passed in checks
    )
    return f"""checks AS ({rows})
SELECT * FROM checks UNION ALL SELECT 'all', '*', bool_and(passed) FROM checks"""


@query(f"{_COPIES}, " + _gate(["l_suppkey", "l_quantity", "l_linenumber"], ["l_quantity", "l_linenumber"], "sum"))
def parity_gate(t):
    return parity_report(*_copies(t), ["l_suppkey"], ["l_quantity", "l_linenumber"])


@query(
    "WITH a AS (SELECT * FROM lineitem), b AS (SELECT * FROM lineitem ORDER BY l_quantity), "
    + _gate(["l_suppkey", "l_quantity"], ["l_quantity"], "max")
)
def parity_gate_passes(t):
    """A table against itself in another order."""
    lines = select_columns(t.lineitem, _COLUMNS)
    return parity_report(lines, lines.repartition(5, "l_orderkey"), ["l_suppkey"], ["l_quantity"], "max")


@query(f"""{_COPIES}
SELECT (SELECT count(*) FROM b) AS migrated_count, (SELECT count(*) FROM a) AS expected_count,
       (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS extra_rows,
       (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS missing_rows, false AS passed
""")
def row_parity_summary(t):
    lines, copy = _copies(t)
    return row_parity(copy, lines).summary


@query(f"""{_COPIES}
SELECT cast(l_suppkey AS varchar) AS l_suppkey, cast(l_orderkey AS varchar) AS l_orderkey,
       cast(l_linenumber AS varchar) AS l_linenumber, cast(l_quantity AS varchar) AS l_quantity, count(*) AS copies
FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM a
      EXCEPT ALL SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM b)
GROUP BY ALL
""")
def row_parity_missing(t):
    lines, copy = _copies(t)
    return row_parity(copy, lines, ignore=["L_RETURNFLAG"]).missing


@query("""
SELECT cast(l_suppkey AS varchar) AS l_suppkey, cast(l_orderkey AS varchar) AS l_orderkey,
       cast(l_linenumber AS varchar) AS l_linenumber, count(*) AS copies
FROM lineitem WHERE l_suppkey % 10 = 3 AND l_linenumber = 7
GROUP BY ALL ORDER BY l_suppkey, l_orderkey, l_linenumber LIMIT 20
""")
def row_parity_sample(t):
    lines, copy = _copies(t)
    return difference_sample(row_parity(copy, lines, ignore=["l_quantity", "l_returnflag"]).missing)


@query(ORACLES["row_parity_summary"])
def parity_tree_summary(t):
    """Buckets by key; few of their checksums differ in the finer level."""
    lines, copy = _copies(t)
    return row_parity_tree(copy, lines, ["l_orderkey", "l_linenumber"]).summary


@query(ORACLES["row_parity_missing"])
def parity_tree_missing(t):
    """Few buckets of few rows, which are divided down three levels."""
    lines, copy = _copies(t)
    return row_parity_tree(copy, lines, ["l_orderkey", "l_linenumber"], ["L_RETURNFLAG"], bits=15, levels=3).missing


@query("""
SELECT count(*) AS migrated_count, count(*) AS expected_count, 0::bigint AS extra_rows, 0::bigint AS missing_rows, true AS passed
FROM lineitem
""")
def parity_tree_equal(t):
    """A table against itself in another order: nothing is compared row by row."""
    return row_parity_tree(t.lineitem.hint("rebalance", F.col("l_suppkey")), t.lineitem).summary


_HOLES = "SELECT event_id, nullif(event_type, 'view') AS event_type, nullif(user_id, 8) AS user_id FROM events"


def _with_holes(t):
    return t.events.select(
        "event_id",
        F.nullif("event_type", F.lit("view")).alias("event_type"),
        F.nullif("user_id", F.lit(8).cast("long")).alias("user_id"),
    )


@query(f"""
WITH h AS ({_HOLES}), n AS (SELECT count(*) AS row_count FROM h)
SELECT 'event_id' AS "column", row_count, 0 AS null_count, 0.0::double AS null_share FROM n
UNION ALL SELECT 'event_type', row_count, c, c::double / row_count FROM n, (SELECT count(*) AS c FROM h WHERE event_type IS NULL)
UNION ALL SELECT 'user_id', row_count, c, c::double / row_count FROM n, (SELECT count(*) AS c FROM h WHERE user_id IS NULL)
""")
def null_counts(t):
    return null_profile(_with_holes(t))


@query("""
WITH h AS (SELECT nullif(event_type, 'view') AS event_type, nullif(user_id, 8) AS user_id FROM events)
SELECT count(*) AS row_count, 2::bigint AS column_count, count(*) - count(event_type) AS event_type_nulls,
       count(*) - count(user_id) AS user_id_nulls, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM h)) AS duplicate_rows,
       count(*) > 0 AS passed
FROM h
""")
def validation(t):
    report = validate(_with_holes(t).select("event_type", "user_id"))
    return report.select(
        "row_count",
        "column_count",
        F.col("null_counts.event_type").alias("event_type_nulls"),
        F.col("null_counts.user_id").alias("user_id_nulls"),
        "duplicate_rows",
        "passed",
    )


@query("""
WITH d AS (SELECT count(*) FILTER (o_orderkey % 50 = 0) AS again FROM orders)
SELECT 'bronze' AS layer, 'single_source' AS rule, 0::bigint AS offending, true AS passed
UNION ALL SELECT 'silver', 'audit_columns', 0, true
UNION ALL SELECT 'silver', 'unique_keys', again, again = 0 FROM d
UNION ALL SELECT 'gold', 'one_row_per_group', 0, true
UNION ALL SELECT 'gold', 'not_larger_than_silver', 0, true
""")
def layer_checks(t):
    """A silver table into which some orders were loaded twice."""
    bronze = add_audit_columns(t.orders, "order_desk", datetime(2024, 5, 1))
    silver = union_all(bronze, bronze.where("o_orderkey % 50 = 0"))
    gold = summarize(silver, ["o_custkey"], [Agg("o_totalprice", "max", "largest")])
    return check_layers(bronze, silver, gold, ["o_orderkey"], ["o_custkey"])


_LIKE = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


@query(f"""
SELECT name AS "column", count(*) AS n, CASE name WHEN 'l_orderkey' THEN true END AS keys_alike, true AS nulls_alike, true AS values_alike
FROM lineitem, (SELECT unnest({_LIKE!r}) AS name) GROUP BY name
""")
def rows_like_lines(t):
    """Made lines, as many as there are: orders and shares of values within 1.5 % and what chance adds."""
    lines = t.lineitem.select(*_LIKE)
    seen = profile(lines)
    made = rows_like(t.spark, seen, keys=["l_orderkey"])
    chance = 2 / F.sqrt(F.col("other_rows"))
    both = lines.agg(F.count_distinct("l_orderkey").alias("found")), made.agg(F.count_distinct("l_orderkey").alias("made"))
    orders = union_all(*both).agg(F.max("found").alias("found"), F.max("made").alias("made")).select(
        F.lit("l_orderkey").alias("column"), (F.abs(F.col("made") - F.col("found")) <= 0.015 * F.col("found")).alias("keys_alike")
    )
    return likeness(lines, made, seen).join(orders, "column", "left").select(
        "column", F.col("other_rows").alias("n"), "keys_alike",
        (F.col("null_gap") <= 0.001 + chance).alias("nulls_alike"),
        (F.col("rank_gap") <= 0.015 + chance).alias("values_alike"),
    )


@query("""
SELECT event_type, (SELECT count(DISTINCT event_type) FROM events) AS kinds, true AS share_alike FROM events GROUP BY event_type
""")
def rows_like_events(t):
    """Frequent texts keep their shares in made rows; no other text of the column occurs."""
    events = t.events.select("event_type")
    made = rows_like(t.spark, profile(events), n=50_000)

    def shares(df, label):
        counted = df.groupBy("event_type").agg(F.count(F.lit(1)).alias(label))
        total = df.agg(F.count(F.lit(1)).alias("n")).first().n
        return counted.withColumn(label, F.col(label) / total)

    both = shares(events, "found").join(shares(made, "made"), "event_type", "full")
    gap = F.abs(F.coalesce("found", F.lit(0.0)) - F.coalesce("made", F.lit(0.0)))
    return both.select("event_type", F.lit(made.agg(F.count_distinct("event_type")).first()[0]).cast("long").alias("kinds"), (gap <= 0.02).alias("share_alike"))
