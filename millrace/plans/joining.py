"""Join, append and find-replace queries."""

from pyspark.sql import functions as F

from millrace.operators.columns import select_columns
from millrace.operators.filters import filter_true
from millrace.operators.formulas import with_formulas
from millrace.operators.joins import append_fields, join, join_anchors
from millrace.operators.range_join import range_join
from millrace.operators.lookup import find_replace
from millrace.operators.sets import union_all
from millrace.operators.summarize import Agg, summarize
from millrace.plans.registry import ORACLES, query
from millrace.sources.readers import inline_table


@query("""
SELECT c.c_custkey, c.c_mktsegment,
       cast(sum(cast(l.l_quantity * l.l_extendedprice AS decimal(18, 2))) AS double) AS "TotalSales",
       count(l.l_extendedprice) AS "TransactionCount"
FROM lineitem l JOIN orders o ON l.l_orderkey IS NOT DISTINCT FROM o.o_orderkey
     JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey
WHERE l.l_extendedprice > 1000
GROUP BY c.c_custkey, c.c_mktsegment
""")
def sales_summary(t):
    """The flagship: line totals above a price, per customer and segment.

    Lines are summed per customer before the segment is joined: the join with orders
    may split a hot key, the sums shrink on the map side, and only one row per
    customer moves on.
    """
    lines = select_columns(t.lineitem, ["l_orderkey", "l_quantity", "l_extendedprice"])
    priced = with_formulas(
        filter_true(lines, "l_extendedprice > 1000"),
        [("line_total", "l_quantity * l_extendedprice", "decimal(18,2)")],
    )
    orders = select_columns(t.orders, ["o_orderkey", "o_custkey"])
    per_customer = summarize(
        join(select_columns(priced, ["l_orderkey", "line_total"]), orders, ["l_orderkey"], ["o_orderkey"]),
        ["o_custkey"],
        [Agg("line_total", "sum", "total"), Agg("line_total", "count", "lines")],
    )
    customers = select_columns(t.customer, ["c_custkey", "c_mktsegment"])
    return join(customers, per_customer, ["c_custkey"], ["o_custkey"]).select(
        "c_custkey",
        "c_mktsegment",
        F.col("total").cast("double").alias("TotalSales"),
        F.col("lines").alias("TransactionCount"),
    )


def _sides(t):
    """All orders and the solvent customers; some keys are missing, and on either side some have no match."""
    orders = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 10 != 3, F.when(F.col("o_custkey") % 7 == 2, -F.col("o_custkey")).otherwise(F.col("o_custkey"))).alias("cust"),
        "o_totalprice",
        F.col("o_orderstatus").alias("status"),
    )
    customers = t.customer.where("c_acctbal > 0").select(
        F.nullif("c_custkey", F.lit(5).cast("long")).alias("key"), "c_name", F.col("c_mktsegment").alias("status")
    )
    return orders, customers


_SIDES = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 3 THEN CASE WHEN o_custkey % 7 = 2 THEN -o_custkey ELSE o_custkey END END AS cust, o_totalprice, o_orderstatus AS status
           FROM orders),
     c AS (SELECT nullif(c_custkey, 5) AS key, c_name, c_mktsegment AS status FROM customer WHERE c_acctbal > 0)
"""
_BOTH = "o_orderkey, cust, o_totalprice, o.status AS status, c_name, c.status AS status_right"


@query(f"{_SIDES} SELECT {_BOTH} FROM o JOIN c ON cust IS NOT DISTINCT FROM key")
def join_null_safe(t):
    orders, customers = _sides(t)
    return join(orders, customers, ["cust"], ["key"])


@query(f"{_SIDES} SELECT {_BOTH} FROM o JOIN c ON cust = key")
def join_plain(t):
    orders, customers = _sides(t)
    return join(orders, customers, ["cust"], ["key"], null_safe=False)


@query(f"{_SIDES} SELECT {_BOTH} FROM o LEFT JOIN c ON cust IS NOT DISTINCT FROM key")
def join_left(t):
    orders, customers = _sides(t)
    return join(orders, customers, ["cust"], ["key"], how="left")


_SHOWN = _BOTH.replace("cust,", "coalesce(cust, key) AS cust,")


@query(f"{_SIDES} SELECT {_SHOWN} FROM o RIGHT JOIN c ON cust IS NOT DISTINCT FROM key")
def join_right(t):
    orders, customers = _sides(t)
    return join(orders, customers, ["cust"], ["key"], how="right")


@query(f"""{_SIDES} SELECT {_SHOWN} FROM o FULL JOIN c ON cust IS NOT DISTINCT FROM key""")
def join_full(t):
    orders, customers = _sides(t)
    return join(orders, customers, ["cust"], ["key"], how="full")


@query(ORACLES["join_left"])
def join_left_split(t):
    """Put together from an inner and an anti join, as for hot keys."""
    orders, customers = _sides(t)
    return join(orders, customers, ["cust"], ["key"], how="left", hot_rows=0)


@query(ORACLES["join_full"])
def join_full_split(t):
    orders, customers = _sides(t)
    return join(orders, customers, ["cust"], ["key"], how="full", hot_rows=0)


@query(f"{_SIDES} SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE cust IS NOT DISTINCT FROM key)")
def join_left_only(t):
    orders, customers = _sides(t)
    return join(orders, customers, ["cust"], ["key"], how="left_anti")


@query(f"""{_SIDES} SELECT * FROM c
WHERE NOT EXISTS (SELECT 1 FROM o WHERE cust IS NOT DISTINCT FROM key)""")
def join_right_only(t):
    orders, customers = _sides(t)
    return join_anchors(orders, customers, ["cust"], ["key"]).right_only


@query(f"""{_SIDES}
SELECT 'joined' AS anchor, count(*) AS rows FROM o JOIN c ON cust IS NOT DISTINCT FROM key
UNION ALL
SELECT 'left_only', count(*) FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE cust IS NOT DISTINCT FROM key)
UNION ALL
SELECT 'right_only', count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE cust IS NOT DISTINCT FROM key)
""")
def join_three_ways(t):
    orders, customers = _sides(t)
    out = join_anchors(orders, customers, ["cust"], ["key"])
    return union_all(
        *[df.agg(F.lit(name).alias("anchor"), F.count(F.lit(1)).alias("rows")) for name, df in out._asdict().items()]
    )


_MEAN_SQL = "round(cast(sum(cast(l_extendedprice AS decimal(18, 2))) AS double) / count(*), 2)"


def _mean_price(t):
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return t.lineitem.agg(F.round(total / F.count(F.lit(1)), 2).alias("mean_price"))


@query(f"""
SELECT l_orderkey, l_linenumber, l_extendedprice, (SELECT {_MEAN_SQL} FROM lineitem) AS mean_price FROM lineitem
""")
def append_scalar(t):
    lines = select_columns(t.lineitem, ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return append_fields(lines, _mean_price(t))


@query(f"""
SELECT l_orderkey, l_linenumber, l_extendedprice, m.mean_price
FROM lineitem, (SELECT {_MEAN_SQL} AS mean_price FROM lineitem) m WHERE l_extendedprice >= m.mean_price
""")
def theta_append(t):
    lines = select_columns(t.lineitem, ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return filter_true(append_fields(lines, _mean_price(t)), "l_extendedprice >= mean_price")


@query("""
SELECT s_suppkey, count(*) AS customers, min(c_acctbal) AS least, max(c_custkey) AS last
FROM supplier JOIN customer ON c_acctbal >= s_acctbal GROUP BY s_suppkey
""")
def theta_join_richer(t):
    """An inequality between two tables, counted per row of one."""
    totals = {"customers": ("count", "c_custkey"), "least": ("min", "c_acctbal"), "last": ("max", "c_custkey")}
    pairs = range_join(t.customer, t.supplier, "c_acctbal", low="s_acctbal", rows_per_range=200, totals=totals)
    return pairs.groupBy("s_suppkey").agg(
        F.sum("customers").alias("customers"), F.min("least").alias("least"), F.max("last").alias("last")
    )


@query("""
SELECT e.event_id, p.event_id AS opened FROM events e JOIN events p
  ON p.user_id = e.user_id AND p.event_id % 5 = 0 AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 1 DAY
""")
def band_join_periods(t):
    """Events in the day after certain events of the same user."""
    periods = t.events.where("event_id % 5 = 0").select(
        F.col("event_id").alias("opened"), "user_id", F.col("ts").alias("since"), F.expr("ts + INTERVAL 1 DAY").alias("until")
    )
    found = range_join(
        t.events, periods, "ts", "since", "until", include_low=False, include_high=True, on=["user_id"], rows_per_range=500
    )
    return found.select("event_id", "opened")


@query("""
SELECT p_brand, count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part
  ON l_extendedprice > p_retailprice AND l_extendedprice <= p_retailprice + 10 GROUP BY p_brand
""")
def band_join_prices(t):
    """Lines whose price lies at most 10 above a part's, whatever the part."""
    parts = t.part.select("p_brand", "p_retailprice", (F.col("p_retailprice") + 10).alias("most"))
    lines = t.lineitem.select("l_orderkey", "l_extendedprice")
    found = range_join(lines, parts, "l_extendedprice", "p_retailprice", "most", include_low=False, include_high=True)
    return found.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("l_orderkey").alias("orders")
    )


@query("SELECT * FROM customer, region")
def append_rows(t):
    return append_fields(t.customer, t.region)


@query(ORACLES["append_rows"])
def append_rows_chunked(t):
    """A source too large to ship: it meets the target by chunk and slice."""
    return append_fields(t.customer, t.region, broadcast_rows=2)


_SEGMENTS = [("BUILDING", "construction", 2), ("BUILDING", "building trade", 1), ("MACHINERY", "machines", 1),
             ("HOUSEHOLD", None, 1), (None, "nothing", 1), ("TOYS", "toys", 1)]
_SEGMENTS_SQL = """(VALUES ('BUILDING', 'construction', 2), ('BUILDING', 'building trade', 1), ('MACHINERY', 'machines', 1),
  ('HOUSEHOLD', NULL, 1), (NULL, 'nothing', 1), ('TOYS', 'toys', 1)) AS v(code, label, rank)"""
_FIRST_SEGMENT = f"""(SELECT code, arg_min(label, rank) AS label, min(rank) AS rank
  FROM {_SEGMENTS_SQL} WHERE code IS NOT NULL GROUP BY code)"""


def _segments(t):
    return inline_table(t.spark, _SEGMENTS, "code string, label string, rank int")


@query(f"""
SELECT c_custkey, c_name, coalesce(label, c_mktsegment) AS c_mktsegment
FROM customer LEFT JOIN {_FIRST_SEGMENT} s ON c_mktsegment = code
""")
def find_replace_exact(t):
    customers = select_columns(t.customer, ["c_custkey", "c_name", "c_mktsegment"])
    return find_replace(customers, _segments(t), "c_mktsegment", "code", "label", order_by=["rank"])


@query(f"""
SELECT c_custkey, c_mktsegment, label, rank FROM customer
LEFT JOIN {_FIRST_SEGMENT} s ON c_mktsegment = code
""")
def find_append(t):
    customers = select_columns(t.customer, ["c_custkey", "c_mktsegment"])
    return find_replace(
        customers, _segments(t), "c_mktsegment", "code", mode="append", fields=["label", "rank"], order_by=["rank"]
    )


@query("""
SELECT doc_id, replace(replace(replace(text, 'ation', '<ATION>'), 'then', '[THEN]'), 'the', 'THE') AS text FROM documents
""")
def find_replace_any(t):
    phrases = inline_table(
        t.spark, [("the", "THE"), ("ation", "<ATION>"), ("then", "[THEN]"), ("", "never")], "phrase string, by string"
    )
    return find_replace(select_columns(t.documents, ["doc_id", "text"]), phrases, "text", "phrase", "by", mode="any")


@query("""
WITH items AS (SELECT list(text ORDER BY length(text) DESC, text) AS texts FROM benchmark)
SELECT doc_id, list_reduce(texts, lambda done, item: replace(done, item, '<' || left(md5(item), 8) || '>'), text) AS text
FROM documents, items
""")
def find_replace_many(t):
    """Every benchmark passage inside a document becomes a short mark: the way for large lookups."""
    marks = t.benchmark.select("text", F.concat(F.lit("<"), F.left(F.md5("text"), F.lit(8)), F.lit(">")).alias("mark"))
    documents = select_columns(t.documents, ["doc_id", "text"])
    return find_replace(documents, marks, "text", "text", "mark", mode="any", phrases_in_pattern=0)
