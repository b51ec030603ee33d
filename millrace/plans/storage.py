"""Source, sink, layer and stream queries; they write only to the scratch area."""

from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators.columns import add_audit_columns, select_columns
from millrace.operators.formulas import with_formulas
from millrace.operators.joins import join
from millrace.operators.sets import union_all
from millrace.operators.summarize import Agg, summarize
from millrace.plans.registry import ORACLES, query
from millrace.session import scratch_path
from millrace.sources.incremental import read_gold, refresh_gold
from millrace.sources.layers import medallion
from millrace.sources.mixed_json import read_json_typed
from millrace.sources.readers import (
    inline_table,
    list_files,
    read_csv_strings,
    read_files,
    read_many,
    read_query,
    read_table,
)
from millrace.sources.records import read_csv_records
from millrace.sources.writers import read_latest, upsert, write_path, write_table
from millrace.streaming.changes import append_stream, apply_changes, read_stream


def _texts(orders):
    return orders.select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.col("o_orderstatus").alias("status"),
        F.concat("o_orderpriority", F.lit(', "quoted"')).alias("note"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
    )


@query("""
SELECT cast(o_orderkey AS varchar) AS key, o_orderstatus AS status, o_orderpriority || ', "quoted"' AS note,
       cast(cast(o_totalprice AS decimal(18, 2)) AS varchar) AS price
FROM orders
""")
def read_csv(t):
    path = scratch_path(t.spark, "csv")
    _texts(t.orders).write.options(header=True, escape='"').csv(path)
    return read_csv_strings(t.spark, path)


@query("""
SELECT cast(o_orderkey AS varchar) AS "key", 'to ' || o_custkey || chr(10) || '"' || o_orderpriority || '",' || chr(10) || 'end' AS note,
       o_orderstatus AS status
FROM orders
""")
def read_csv_with_breaks(t, **limits):
    """Cells that hold line breaks, quotes and commas."""
    path = scratch_path(t.spark, "records")
    note = F.format_string('to %s\n"%s",\nend', F.col("o_custkey").cast("string"), "o_orderpriority")
    orders = t.orders.select(F.col("o_orderkey").alias("key"), note.alias("note"), F.col("o_orderstatus").alias("status"))
    orders.write.options(header=True, escape='"').csv(path)
    return read_csv_records(t.spark, path, **limits)


@query(ORACLES["read_csv_with_breaks"])
def read_csv_with_breaks_cut(t):
    """Blocks of 60 kB, so that records cross the ends of many."""
    return read_csv_with_breaks(t, block_bytes=60_000)


def _mixed_events(t):
    """JSON files in which user_id is a number, a text, or missing."""
    path = scratch_path(t.spark, "json")
    third = F.col("event_id") % 3
    event = t.events.select("event_id", "event_type", "user_id")
    event.where(third == 0).write.json(f"{path}/numbers")
    event.where(third == 1).withColumn("user_id", F.concat(F.lit("u"), "user_id")).write.json(f"{path}/texts")
    event.where(third == 2).drop("user_id").write.json(f"{path}/none")
    return [f"{path}/{part}" for part in ("numbers", "texts", "none")]


@query("""
SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN cast(user_id AS varchar) WHEN 1 THEN 'u' || user_id END AS user_id,
       cast(NULL AS varchar) AS _unfit
FROM events
""")
def read_json_of_all_types(t):
    """A field that is a number in one file and a text in another becomes a text."""
    return read_json_typed(t.spark, _mixed_events(t))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id END AS user_id,
       CASE event_id % 3 WHEN 1 THEN '{"event_type":"' || event_type || '","user_id":"u' || user_id || '"}'
                         ELSE '{"event_type":"' || event_type || '"}' END AS _unfit
FROM events
""")
def read_json_as_declared(t):
    """What does not fit the declared columns stands beside them."""
    return read_json_typed(t.spark, _mixed_events(t), "event_id long, user_id long")


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders")
def read_formats(t):
    """One table through ORC, read with a column list known beforehand."""
    path = f"{scratch_path(t.spark, 'files')}.orc"
    orders = select_columns(t.orders, ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    write_path(orders, path, fmt="orc")
    return read_files(t.spark, path, schema=orders.schema)


@query("SELECT DISTINCT event_type, true AS has_files FROM events")
def listed_files(t):
    path = scratch_path(t.spark, "listed")
    write_path(t.events, path, partition_by=["event_type"])
    files = list_files(t.spark, path, glob="*.parquet")
    kind = F.regexp_extract("path", "event_type=([^/]+)/", 1)
    return files.groupBy(kind.alias("event_type")).agg((F.sum("length") > 0).alias("has_files"))


@query("""
SELECT event_id, user_id, value, event_type = 'click' AS clicked FROM events WHERE event_type IN ('click', 'view')
""")
def read_many_files(t, **limits):
    """Files named by a list of paths; the path tells what they hold."""
    path = scratch_path(t.spark, "many")
    write_path(select_columns(t.events, ["event_id", "user_id", "value", "event_type"]), path, partition_by=["event_type"])
    listed = list_files(t.spark, path, glob="*.parquet").where("path like '%=click/%' or path like '%=view/%'")
    rows = read_many(t.spark, listed.select("path"), fmt="parquet", path_column="file", **limits)
    return rows.select("event_id", "user_id", "value", F.col("file").contains("=click/").alias("clicked"))


@query(ORACLES["read_many_files"])
def read_many_scans(t):
    """One listed path per scan."""
    return read_many_files(t, max_paths=1)


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'F'")
def query_source(t):
    return read_query(
        t.spark, "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM {o} WHERE o_orderstatus = 'F'", {"o": t.orders}
    )


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def table_source(t):
    select_columns(t.lineitem, ["l_orderkey", "l_linenumber", "l_shipdate"]).createOrReplaceTempView("millrace_lines")
    return read_table(t.spark, "millrace_lines")


@query("""
SELECT o_orderstatus, name, count(*) AS n FROM orders
JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending')) AS v(code, name) ON code = o_orderstatus GROUP BY ALL
""")
def inline_source(t):
    codes = inline_table(t.spark, [("F", "finished"), ("O", "open"), ("P", "pending")], "code string, name string")
    counts = summarize(t.orders, ["o_orderstatus"], [Agg("o_orderkey", "count", "n")])
    return join(counts, codes, ["o_orderstatus"], ["code"])


@query("SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'")
def write_modes(t):
    """Overwritten twice, then appended to."""
    path = scratch_path(t.spark, "modes")
    write_path(t.orders.where("o_orderstatus = 'P'"), path)
    write_path(t.orders, path)
    write_path(t.orders.where("o_orderstatus = 'F'"), path, mode="append")
    return read_files(t.spark, path, fmt="parquet")


@query("""
SELECT o_orderkey AS "Order ID", o_totalprice AS "Cube[Total Price]", o_orderstatus AS "Status; now" FROM orders
""")
def write_odd_names(t):
    path = scratch_path(t.spark, "names")
    odd = t.orders.select(
        F.col("o_orderkey").alias("Order ID"),
        F.col("o_totalprice").alias("Cube[Total Price]"),
        F.col("o_orderstatus").alias("Status; now"),
    )
    write_path(odd, path)
    return read_files(t.spark, path, fmt="parquet")


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate
FROM orders WHERE NOT (o_orderkey % 4 = 2)
UNION ALL
SELECT -o_orderkey - 1, o_custkey, 'N', o_orderdate FROM orders WHERE o_orderkey % 4 = 3
""")
def upsert_rows(t):
    """Updates, deletions, insertions and outdated changes, the last batch sent twice."""
    path = scratch_path(t.spark, "upsert")
    orders = select_columns(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    later, earlier = F.expr("o_orderdate + INTERVAL 1 DAY"), F.expr("o_orderdate - INTERVAL 1 DAY")
    part = F.col("o_orderkey") % 4
    changes = (
        orders.where(part == 1).withColumns({"o_orderstatus": F.lit("X"), "o_orderdate": later})
        .unionAll(orders.where(part == 2).withColumns({"o_orderstatus": F.lit("gone"), "o_orderdate": later}))
        .unionAll(orders.where(part == 3).withColumns({"o_orderkey": -F.col("o_orderkey") - 1, "o_orderstatus": F.lit("N")}))
        .unionAll(orders.where(part == 0).withColumns({"o_orderstatus": F.lit("old"), "o_orderdate": earlier}))
    )
    for batch in (orders, changes, changes):
        upsert(t.spark, batch, path, ["o_orderkey"], "o_orderdate", delete_when="o_orderstatus = 'gone'")
    return read_latest(t.spark, path)


@query("""
SELECT o_orderkey, max(o_totalprice) AS price, (arg_min(status, (-rank, status))) AS status FROM (
  SELECT o_orderkey, o_totalprice, 'A' || o_orderstatus AS status, 1 AS rank FROM orders
  UNION ALL SELECT o_orderkey, o_totalprice, 'B' || o_orderstatus, 1 FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, o_totalprice, 'C', 2 FROM orders WHERE o_orderkey % 5 = 0) GROUP BY o_orderkey
""")
def upsert_batches(t):
    """Ties included, the same changes give the same table in one batch and in three."""
    def state(order, label):
        orders = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
        parts = [
            orders.select("o_orderkey", "price", F.concat(F.lit("A"), "o_orderstatus").alias("status"), F.lit(1).alias("rank")),
            orders.where("o_orderkey % 3 = 0").select(
                "o_orderkey", "price", F.concat(F.lit("B"), "o_orderstatus").alias("status"), F.lit(1).alias("rank")
            ),
            orders.where("o_orderkey % 5 = 0").select("o_orderkey", "price", F.lit("C").alias("status"), F.lit(2).alias("rank")),
        ]
        path = scratch_path(t.spark, label)
        for batch in [[parts[i] for i in group] for group in order]:
            upsert(t.spark, union_all(*batch), path, ["o_orderkey"], "rank")
        return read_latest(t.spark, path).drop("rank")

    at_once, one_by_one = state([[0, 1, 2]], "once"), state([[1], [2], [0]], "parts")
    return at_once.intersect(one_by_one)


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def write_tables(t):
    """A catalog table, overwritten and then appended to."""
    name = "millrace_" + scratch_path(t.spark, "t").rpartition("-")[2]
    orders = select_columns(t.orders, ["o_orderkey", "o_totalprice", "o_orderstatus"])
    write_table(orders.where("o_orderstatus = 'P'"), name, fmt="parquet")
    write_table(orders, name, fmt="parquet")
    write_table(orders.where("o_orderstatus = 'F'"), name, mode="append", fmt="parquet")
    return read_table(t.spark, name).select("o_orderkey", "o_totalprice")


@query("""
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) OR c_name LIKE '%7'
""")
def exists_or_ends(t):
    """A subquery beside another condition."""
    text = "SELECT c_custkey, c_name FROM {c} WHERE EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey AND o_totalprice > 300000) OR endswith(c_name, '7')"
    return read_query(t.spark, text, {"c": t.customer, "o": t.orders})


@query("""
SELECT c_mktsegment, cast(sum(cast(o_totalprice AS decimal(18, 2))) AS double) AS "TotalSales", count(*) AS "TransactionCount"
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment
""")
def medallion_gold(t):
    """Two bronze tables (one of them named twice), one silver, one gold."""
    def silver(bronze):
        orders = with_formulas(
            bronze["orders"].where("o_totalprice > 1000"), [("amount", "o_totalprice", "decimal(18,2)")]
        )
        rows = join(orders, select_columns(bronze["customer"], ["c_custkey", "c_mktsegment"]), ["o_custkey"], ["c_custkey"])
        return add_audit_columns(rows, "order_desk", datetime(2024, 5, 1))

    def gold(clean, bronze):
        return summarize(
            clean, ["c_mktsegment"], [Agg("amount", "sum", "TotalSales"), Agg("amount", "count", "TransactionCount")]
        )

    def read(name):
        return getattr(t, name)

    out = medallion(
        t.spark,
        "Sales Summary",
        {"orders": "orders", "orders again": "orders", "customer": "customer"},
        silver,
        {"sales": gold},
        scratch_path(t.spark, "layers"),
        read,
    )
    assert out.bronze["orders"] == out.bronze["orders again"]
    sales = read_files(t.spark, out.gold["sales"], fmt="parquet")
    return sales.withColumn("TotalSales", F.col("TotalSales").cast("double"))


@query("SELECT event_id, user_id, upper(event_type) AS kind, value * 2 AS doubled FROM events WHERE event_type <> 'error'")
def stream_append(t):
    """Events arriving in files, appended in two runs."""
    base = scratch_path(t.spark, "stream")
    source, sink, checkpoint = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    events = t.events

    def transform(df):
        return df.where("event_type <> 'error'").select(
            "event_id", "user_id", F.upper("event_type").alias("kind"), (F.col("value") * 2).alias("doubled")
        )

    for arrived in ("value < 50", "not value < 50"):
        write_path(events.where(arrived), source, mode="append")
        append_stream(read_stream(t.spark, source, events.schema), transform, sink, checkpoint).awaitTermination()
    return read_files(t.spark, sink, fmt="parquet")


@query("""
SELECT event_id, ts, user_id, event_type, value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def stream_upsert(t):
    """The latest event per user, the later events arriving first."""
    base = scratch_path(t.spark, "changes")
    source, target, checkpoint = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    events = select_columns(t.events, ["event_id", "ts", "user_id", "event_type", "value"])
    for arrived in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        write_path(events.where(arrived), source, mode="append")
        stream = read_stream(t.spark, source, events.schema)
        apply_changes(stream, target, ["user_id"], "ts", checkpoint).awaitTermination()
    return read_latest(t.spark, target)


_GOLD_SQL = """
SELECT o_custkey, count(*) AS row_count, cast(sum(cast(o_totalprice AS decimal(18, 2))) AS double) AS total,
       cast(min(cast(o_totalprice AS decimal(18, 2))) AS double) AS smallest,
       cast(max(cast(o_totalprice AS decimal(18, 2))) AS double) AS largest, max(o_orderdate) AS latest
FROM orders WHERE {kept} GROUP BY o_custkey
"""


def _loaded_gold(t, loads, **options):
    """Orders that arrive load by load, and their gold table after the last one."""
    base = scratch_path(t.spark, "gold")
    orders = select_columns(t.orders, ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    orders = orders.withColumn("price", F.col("o_totalprice").cast("decimal(18,2)")).drop("o_totalprice")
    for arrived, gone in loads:
        load = orders.where(arrived).withColumn("gone", F.lit(gone))
        write_path(load, f"{base}/in", mode="append")
        stream = read_stream(t.spark, f"{base}/in", load.schema)
        refresh_gold(stream, f"{base}/out", ["o_custkey"], ["price", "o_orderdate"], "gone", **options).awaitTermination()
    return read_gold(t.spark, f"{base}/out", ["o_custkey"], ["price", "o_orderdate"]).select(
        "o_custkey", "row_count", F.col("sum_price").cast("double").alias("total"),
        F.col("min_price").cast("double").alias("smallest"), F.col("max_price").cast("double").alias("largest"),
        F.col("max_o_orderdate").alias("latest"),
    )


@query(_GOLD_SQL.format(kept="true"))
def layers_incremental(t):
    """Three loads, each read once."""
    return _loaded_gold(t, [(f"o_orderkey % 3 = {i}", False) for i in range(3)])


@query(_GOLD_SQL.format(kept="o_orderkey % 5 <> 1"))
def layers_deleted(t):
    """Two loads, then one that takes back orders, extremes among them; states are merged on the way."""
    loads = [("o_orderkey % 2 = 0", False), ("o_orderkey % 2 = 1", False), ("o_orderkey % 5 = 1", True)]
    return _loaded_gold(t, loads, compact_after=2)
