"""Aggregation, set and reshape queries."""

from pyspark.sql import functions as F

from millrace.operators.columns import select_columns
from millrace.operators.reshape import cross_tab, transpose
from millrace.operators.sets import except_all, union_all, unique
from millrace.operators.sketches import compare_sketches, distinct_sketches, merge_sketches, sketched_count
from millrace.operators.summarize import Agg, category_counts, count_records, latest_by, summarize
from millrace.plans.registry import ORACLES, query
from millrace.session import materialize


def _rounded(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("""
SELECT l_returnflag AS flag, l_linestatus, cast(sum(cast(l_extendedprice AS decimal(18, 2))) AS double) AS total,
       round(avg(l_quantity), 6) AS mean_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
       count(l_partkey) AS n, round(stddev_samp(l_quantity), 6) AS sd_qty, round(var_samp(l_quantity), 6) AS var_qty,
       count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def summarize_all(t):
    lines = t.lineitem.withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))
    out = summarize(
        lines,
        [("l_returnflag", "flag"), "l_linestatus"],
        [
            Agg("price", "sum", "total"),
            Agg("l_quantity", "avg", "mean_qty"),
            Agg("l_shipdate", "min", "first_ship"),
            Agg("l_shipdate", "max", "last_ship"),
            Agg("l_partkey", "count", "n"),
            Agg("l_quantity", "stddev", "sd_qty"),
            Agg("l_quantity", "variance", "var_qty"),
            Agg("l_suppkey", "countDistinct", "suppliers"),
        ],
    )
    return _rounded(out.withColumn("total", F.col("total").cast("double")), 6, "mean_qty", "sd_qty", "var_qty")


@query("""
SELECT cast(sum(cast(o_totalprice AS decimal(18, 2))) AS double) AS total, count(nullif(o_orderstatus, 'P')) AS settled,
       count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS latest
FROM orders
""")
def summarize_global(t):
    orders = t.orders.withColumns(
        {"price": F.col("o_totalprice").cast("decimal(18,2)"), "done": F.nullif("o_orderstatus", F.lit("P"))}
    )
    return summarize(
        orders,
        [],
        [
            Agg("price", "sum", "total"),
            Agg("done", "count", "settled"),
            Agg("o_custkey", "countDistinct", "customers"),
            Agg("o_orderdate", "max", "latest"),
        ],
    ).withColumn("total", F.col("total").cast("double"))


@query("""
SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price,
       arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price
FROM orders GROUP BY o_custkey
""")
def first_last(t):
    order = ("o_orderdate", "o_orderkey")
    return summarize(
        t.orders,
        ["o_custkey"],
        [
            Agg("o_totalprice", "first", "first_price", order),
            Agg("o_totalprice", "last", "last_price", order),
        ],
    )


@query("""
SELECT o_custkey, string_agg(nullif(o_orderpriority, '5-LOW'), '|' ORDER BY o_orderdate, o_orderkey) AS priorities,
       count(o_orderkey) AS n
FROM orders GROUP BY o_custkey
""")
def concat_group(t):
    orders = t.orders.withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return summarize(
        orders,
        ["o_custkey"],
        [
            Agg("priority", "concat", "priorities", ("o_orderdate", "o_orderkey"), sep="|"),
            Agg("o_orderkey", "count", "n"),
        ],
    )


@query("""
SELECT o_custkey, string_agg(nullif(o_orderpriority, '5-LOW'), '|' ORDER BY o_orderdate, o_orderkey) AS priorities
FROM orders GROUP BY o_custkey
""")
def concat_alone(t):
    """Nothing but concatenation, block by block."""
    orders = t.orders.withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    joined = Agg("priority", "concat", "priorities", ("o_orderdate", "o_orderkey"), sep="|")
    return summarize(orders, ["o_custkey"], [joined], concat_rows=6)


@query('SELECT count(*) AS "Count" FROM lineitem')
def count_rows(t):
    return count_records(t.lineitem)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counts_by_category(t):
    return category_counts(t.events, "event_type", "n")


@query("""
SELECT event_id, ts, user_id, event_type, value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_per_key(t):
    events = select_columns(t.events, ["event_id", "ts", "user_id", "event_type", "value"])
    return latest_by(events, ["user_id", "event_type"], ["ts", "event_id"])


@query("""
SELECT c_custkey AS id, c_name AS name, c_acctbal, c_mktsegment, NULL::INTEGER AS s_nationkey FROM customer
UNION ALL
SELECT s_suppkey, s_name, NULL, NULL, s_nationkey FROM supplier
""")
def union_missing(t):
    customers = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal", "c_mktsegment"
    )
    suppliers = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), "s_nationkey")
    return union_all(customers, suppliers)


_LINE_ORDER = """l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
 l_returnflag, l_linestatus"""
_RANKED_LINES = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS rn FROM lineitem)"


@query(f"SELECT * EXCLUDE (rn) FROM {_RANKED_LINES} WHERE rn = 1")
def unique_first(t):
    return unique(t.lineitem, ["l_orderkey"], ["l_shipdate"]).unique


@query(f"SELECT * EXCLUDE (rn) FROM {_RANKED_LINES} WHERE rn > 1")
def duplicates(t):
    return unique(t.lineitem, ["l_orderkey"], ["l_shipdate"]).duplicates


@query(ORACLES["duplicates"])
def duplicates_hot(t):
    return unique(t.lineitem, ["l_orderkey"], ["l_shipdate"], hot_rows=7).duplicates


@query("SELECT l_returnflag, approx AS near FROM (SELECT l_returnflag, true AS approx FROM lineitem GROUP BY l_returnflag)")
def approximate_distinct(t):
    """The approximate count lies within a tenth of the exact one."""
    aggs = [Agg("l_orderkey", "countDistinct", "about", approx=True), Agg("l_orderkey", "countDistinct", "exact")]
    out = summarize(t.lineitem, ["l_returnflag"], aggs)
    return out.select("l_returnflag", (F.col("about") / F.col("exact")).between(0.9, 1.1).alias("near"))


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linenumber FROM lineitem")
def unique_rows(t):
    return unique(select_columns(t.lineitem, ["l_suppkey", "l_returnflag", "l_linenumber"])).unique


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag
FROM (SELECT l_orderkey, l_linenumber, l_returnflag,
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag) AS rn FROM lineitem) WHERE rn > 1
""")
def duplicate_rows(t):
    return unique(select_columns(t.lineitem, ["l_orderkey", "l_linenumber", "l_returnflag"])).duplicates


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem
EXCEPT ALL
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 30
""")
def except_rows(t):
    pairs = ["l_orderkey", "l_linenumber"]
    return except_all(
        select_columns(t.lineitem, pairs), select_columns(t.lineitem.where("l_quantity < 30"), pairs)
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS "Name",
       unnest([l_quantity, l_extendedprice, l_tax]) AS "Value"
FROM lineitem
""")
def wide_to_long(t):
    return transpose(
        t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice", "l_tax"]
    )


@query("""
SELECT o_custkey, count(o_orderkey) FILTER (o_orderstatus = 'F') AS "F", count(o_orderkey) FILTER (o_orderstatus = 'O') AS "O",
       count(o_orderkey) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY o_custkey
""")
def cross_tab_counts(t):
    out = cross_tab(t.orders, ["o_custkey"], "o_orderstatus", "o_orderkey", "count", headers=["F", "O", "P"])
    return out.fillna(0, ["F", "O", "P"])


@query("""
SELECT o_orderstatus, sum(o_totalprice::decimal(18, 2)) FILTER (o_orderpriority = '1-URGENT')::double AS "1-URGENT",
       sum(o_totalprice::decimal(18, 2)) FILTER (o_orderpriority = '2-HIGH')::double AS "2-HIGH",
       sum(o_totalprice::decimal(18, 2)) FILTER (o_orderpriority = '3-MEDIUM')::double AS "3-MEDIUM",
       sum(o_totalprice::decimal(18, 2)) FILTER (o_orderpriority = '4-NOT SPECIFIED')::double AS "4-NOT SPECIFIED",
       sum(o_totalprice::decimal(18, 2)) FILTER (o_orderpriority = '5-LOW')::double AS "5-LOW"
FROM orders GROUP BY o_orderstatus
""")
def cross_tab_listed(t):
    """The header values come from the data."""
    orders = t.orders.withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    out = cross_tab(orders, ["o_orderstatus"], "o_orderpriority", "price")
    return out.select("o_orderstatus", *[F.col(f"`{c}`").cast("double").alias(c) for c in out.columns[1:]])


@query("""
SELECT o_custkey, string_agg(o_orderkey::varchar, '+' ORDER BY o_orderdate, o_orderkey) FILTER (o_orderstatus = 'F') AS "F",
       string_agg(o_orderkey::varchar, '+' ORDER BY o_orderdate, o_orderkey) FILTER (o_orderstatus = 'O') AS "O",
       string_agg(o_orderkey::varchar, '+' ORDER BY o_orderdate, o_orderkey) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY o_custkey
""")
def cross_tab_concat(t):
    order = ["o_orderdate", "o_orderkey"]
    return cross_tab(t.orders, ["o_custkey"], "o_orderstatus", "o_orderkey", "concat", ["F", "O", "P"], order, sep="+")


@query("""
SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS "F",
       arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'O') AS "O"
FROM orders GROUP BY o_custkey
""")
def cross_tab_first(t):
    order = ["o_orderdate", "o_orderkey"]
    return cross_tab(t.orders, ["o_custkey"], "o_orderstatus", "o_totalprice", "first", ["F", "O"], order)


def _daily_users(t):
    """A stored sketch of the users of each kind of event on each day."""
    events = t.events.select("event_type", F.date_trunc("day", "ts").alias("day"), "user_id")
    return materialize(distinct_sketches(events, ["event_type", "day"], "user_id"))


@query("""
SELECT event_type, date_trunc('month', ts) AS month, count(DISTINCT user_id) AS users FROM events GROUP BY ALL
UNION ALL SELECT 'any', date_trunc('month', ts) AS month, count(DISTINCT user_id) FROM events GROUP BY ALL
""")
def sketch_months(t):
    """Days rolled up to months, per kind of event and over all, from the stored sketches alone."""
    months = _daily_users(t).withColumn("month", F.date_trunc("month", "day"))
    per_type = merge_sketches(months, ["event_type", "month"])
    over_all = merge_sketches(per_type, ["month"]).select(F.lit("any").alias("event_type"), "month", "sketch")
    return per_type.unionByName(over_all).select("event_type", "month", sketched_count(F.col("sketch")).alias("users"))


@query("""
WITH d AS (SELECT DISTINCT event_type, cast(date_trunc('day', ts) AS timestamp) AS day, user_id FROM events),
m AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.day, b.day + INTERVAL 1 DAY) AS day,
             a.user_id AS now, b.user_id AS was
      FROM d a FULL JOIN d b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.day = b.day + INTERVAL 1 DAY)
SELECT event_type, day, count(*) FILTER (now IS NOT NULL AND was IS NOT NULL) AS both,
       count(*) FILTER (was IS NULL) AS joined, count(*) FILTER (now IS NULL) AS left
FROM m GROUP BY event_type, day
""".replace(" AS left", ' AS "left"'))
def sketch_returning(t):
    """Users of a day who also came the day before, who are new, and who stayed away."""
    days = _daily_users(t)
    before = days.withColumn("day", F.expr("day + INTERVAL 1 DAY"))
    return compare_sketches(before, days, ["event_type", "day"])
