"""Order-dependent, sorting and sampling queries."""

from pyspark.sql import functions as F

from millrace.operators.columns import select_columns
from millrace.operators.ordered import (
    dedupe_by_key,
    fill_down,
    multi_row,
    record_id,
    row_delta,
    row_tag,
    running_total,
)
from millrace.operators.sampling import sample, sample_exact, sample_fraction, sort
from millrace.operators.scripts import multi_row_fold
from millrace.plans.registry import ORACLES, query

_ORDER = ["ts", "event_id"]


def _events(t):
    return select_columns(t.events, ["event_id", "ts", "user_id", "event_type", "value"])


@query("""
SELECT event_id, ts, user_id, event_type, value,
       value - lag(value, 1) OVER w + coalesce(lead(value, 2) OVER w, 0) AS mixed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def lag_lead(t, **limits):
    return multi_row(
        _events(t),
        "mixed",
        lambda row: F.col("value") - row(-1, "value") + F.coalesce(row(2, "value"), F.lit(0.0)),
        ["user_id"],
        _ORDER,
        tie_break=False,
        **limits,
    )


@query("""
SELECT event_id, ts, user_id, event_type, value,
       cast(sum(cast(value AS decimal(18, 2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS double)
       AS so_far
FROM events
""")
def running_total_per_user(t, **limits):
    events = _events(t).withColumn("amount", F.col("value").cast("decimal(18,2)"))
    out = running_total(events, "amount", ["user_id"], _ORDER, alias="so_far", tie_break=False, **limits)
    return out.withColumn("so_far", F.col("so_far").cast("double")).drop("amount")


@query("""
SELECT event_id, ts, user_id, value,
       last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
       AS event_type
FROM events
""")
def fill_down_types(t, **limits):
    holes = _events(t).withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return fill_down(holes, "event_type", ["user_id"], _ORDER, tie_break=False, **limits)


@query("""
SELECT event_id, ts, user_id, event_type, value,
       value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS value_delta
FROM events
""")
def row_delta_per_type(t):
    return row_delta(_events(t), "value", ["event_type"], _ORDER, tie_break=False)


@query("""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, value - 40 AS change, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
), f AS (
  SELECT event_id, user_id, rn, least(100.0, greatest(0.0, 50.0 + change)) AS balance FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.rn, least(100.0, greatest(0.0, f.balance + e.change))
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1
)
SELECT event_id, user_id, cast(balance AS double) AS balance FROM f
""")
def fold_balance(t, **limits):
    """A balance that starts at 50, takes each change and never leaves 0 to 100."""
    events = select_columns(t.events, ["event_id", "ts", "user_id", "value"])
    out = multi_row_fold(
        events,
        "balance",
        50.0,
        "value - 40",
        ["user_id"],
        _ORDER,
        low=F.lit(0.0),
        high=F.lit(100.0),
        tie_break=False,
        **limits,
    )
    return out.select("event_id", "user_id", "balance")


@query("""
SELECT event_id, ts, user_id, event_type, value, row_number() OVER (ORDER BY value DESC, event_id) AS "RecordID" FROM events
""")
def record_ids(t):
    return record_id(_events(t), order_by=[("value", True), "event_id"], tie_break=False)


@query("SELECT count(*) AS n, count(*) AS tags FROM events")
def row_tags(t):
    return row_tag(t.events).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("RowTag").alias("tags"))


@query("""
SELECT event_id, ts, user_id, event_type, value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1
""")
def dedupe_latest(t):
    return dedupe_by_key(_events(t), ["user_id"], "ts")


@query("SELECT * FROM orders")
def sort_rows(t):
    """The rows that tie are ordered by their other columns."""
    return sort(t.orders, [("o_orderpriority", True), "o_orderdate"])


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sort_topk(t):
    return sample(t.orders, 50, "first", [("o_totalprice", True), "o_orderkey"])


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def sample_last(t):
    return sample(t.orders, 25, "last", ["o_totalprice", "o_orderkey"])


@query("""
SELECT * EXCLUDE (rn) FROM
 (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn <= 3
""")
def sample_group(t):
    return sample(t.orders, 3, "first", ["o_totalprice", "o_orderkey"], ["o_orderpriority"])


@query("SELECT true AS near_a_tenth, true AS same_when_repartitioned")
def sample_hash_check(t):
    """The share taken, and that another partitioning takes the same rows."""
    orders = t.orders
    taken = sample_fraction(orders, 0.1, ["o_orderkey"], seed=7).select(F.lit(1).alias("way"), "o_orderkey")
    again = sample_fraction(orders.repartition(7, "o_custkey"), 0.1, ["o_orderkey"], seed=7)
    every = orders.select(F.lit(0).alias("way"), "o_orderkey")
    rows = taken.unionAll(again.select(F.lit(2).alias("way"), "o_orderkey")).unionAll(every)
    key = F.xxhash64("o_orderkey").cast("decimal(38,0)")
    sums = rows.agg(
        F.count_if(F.col("way") == 0).alias("n"),
        F.count_if(F.col("way") == 1).alias("taken"),
        F.sum(F.when(F.col("way") == 1, key)).alias("first"),
        F.sum(F.when(F.col("way") == 2, key)).alias("second"),
    )
    return sums.select(
        (F.col("taken") / F.col("n")).between(0.07, 0.13).alias("near_a_tenth"),
        (F.col("first") == F.col("second")).alias("same_when_repartitioned"),
    )


_DRAWN_SQL = """
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('3|' || o_orderkey)) AS r
  FROM orders) WHERE r <= 400
"""


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('3|' || o_orderkey) LIMIT 700")
def sample_exact_rows(t):
    """Exactly 700 random orders."""
    return sample_exact(t.orders, 700, ["o_orderkey"], seed=3).select("o_orderkey", "o_totalprice")


@query(_DRAWN_SQL)
def sample_exact_group(t):
    """Exactly 400 random orders of every status, or all of them."""
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return sample_exact(orders, 400, ["o_orderkey"], seed=3, group_by=["o_orderstatus"])


# The ways for large groups, forced on the largest ones by small limits: they must give the same rows.


@query(ORACLES["lag_lead"])
def lag_lead_hot(t):
    return lag_lead(t, hot_rows=10)


@query(ORACLES["running_total_per_user"])
def running_total_hot(t):
    return running_total_per_user(t, hot_rows=10)


@query(ORACLES["fill_down_types"])
def fill_down_hot(t):
    return fill_down_types(t, hot_rows=10)


@query(ORACLES["fold_balance"].replace("cast(balance AS double)", "round(balance::double, 6)"))
def fold_balance_hot(t):
    """Composed steps add up in another order: the last bits of doubles may differ."""
    out = fold_balance(t, group_rows=10)
    return out.withColumn("balance", F.round("balance", 6))


_FOLD_TOTAL = """
SELECT event_id, user_id, cast(1000 + sum(cast(value AS decimal(18, 2))) OVER w AS double) AS total,
       (7 + sum(event_id) OVER w)::bigint AS ids
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
"""


@query(_FOLD_TOTAL)
def fold_total(t, **limits):
    """Fields that add to their own previous value: exact, in their own types."""
    events = select_columns(t.events, ["event_id", "ts", "user_id", "value"])
    amount = F.col("value").cast("decimal(18,2)")
    out = multi_row_fold(events, "total", 1000, amount, ["user_id"], _ORDER, tie_break=False, **limits)
    out = multi_row_fold(out, "ids", 7, "event_id", ["user_id"], _ORDER, tie_break=False, **limits)
    return out.select("event_id", "user_id", F.col("total").cast("double").alias("total"), "ids")


@query(_FOLD_TOTAL)
def fold_total_hot(t):
    return fold_total(t, group_rows=10)


@query(ORACLES["record_ids"])
def record_ids_parts(t):
    """Some thousand rows per partition: ids must run on between partitions."""
    return record_id(_events(t), order_by=[("value", True), "event_id"], tie_break=False, rows_per_partition=1000)


@query("""
SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS least, max(id) AS greatest, true AS in_order
FROM (SELECT row_number() OVER () AS id FROM events)
""")
def record_ids_of_ties(t):
    """Ids by a column of few values; rows that tie come by their other columns."""
    rows = record_id(t.events, "id", order_by=["event_type"], rows_per_partition=1000)
    by_type = rows.groupBy("event_type").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")
    )
    return by_type.agg(
        F.sum("n").alias("n"),
        F.sum("ids").alias("ids"),
        F.min("lo").alias("least"),
        F.max("hi").alias("greatest"),
        F.bool_and(F.col("hi") - F.col("lo") + 1 == F.col("n")).alias("in_order"),
    )


@query("""
SELECT * EXCLUDE (rn) FROM
 (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn <= 1500
""")
def sample_group_hot(t):
    """More rows per group than Spark trims before the shuffle."""
    return sample(t.orders, 1500, "first", ["o_totalprice", "o_orderkey"], ["o_orderstatus"], hot_rows=400)


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12000")
def sample_many(t):
    """More rows than one task takes."""
    return sample(t.orders, 12_000, "first", [("o_totalprice", True), "o_orderkey"])
