"""User code, macros and lineage."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import vocabulary as fn
from millrace.operators.columns import select_columns
from millrace.operators.filters import filter_true
from millrace.operators.formulas import with_formulas
from millrace.operators.machines import state_fold
from millrace.operators.relate import lineage_edges
from millrace.operators.scripts import compose, map_groups, map_pandas, scan_groups
from millrace.plans.registry import ORACLES, query


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity >= 25 AS bulk FROM lineitem
""")
def script_batches(t):
    def script(lines):
        return lines[["l_orderkey", "l_linenumber"]].assign(
            net=lines.l_extendedprice * (1 - lines.l_discount), bulk=lines.l_quantity >= 25
        )

    lines = select_columns(t.lineitem, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"])
    return map_pandas(lines, script, "l_orderkey long, l_linenumber int, net double, bulk boolean")


_PAUSE_US = 6 * 3600 * 1_000_000


@query("""
SELECT event_id, user_id, ts, cast(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint)
       AS visit
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts
      FROM events)
""")
def script_groups(t, **limits):
    """Visits: a user's events without a pause above six hours, numbered in order."""
    pause = _PAUSE_US

    def times(rows):
        return rows.column("ts").cast(pa.int64()).to_numpy()

    def summarise(rows):
        at = times(rows)
        return {"first": int(at[0]), "last": int(at[-1]), "visits": int((at[1:] - at[:-1] > pause).sum())}

    def combine(before, block):
        if before is None:
            return {**block, "visits": 1 + block["visits"]}
        opened = int(block["first"] - before["last"] > pause)
        return {**block, "visits": before["visits"] + opened + block["visits"]}

    def emit(rows, before):
        at = times(rows)
        first = 1 if before is None else before["visits"] + int(at[0] - before["last"] > pause)
        visit = first + pc.cumulative_sum(pa.array([0, *(at[1:] - at[:-1] > pause)], pa.int64())).to_numpy()
        return rows.append_column("visit", pa.array(visit, pa.int64()))

    events = select_columns(t.events, ["event_id", "user_id", "ts"])
    return scan_groups(
        events,
        ["user_id"],
        ["ts", "event_id"],
        summarise,
        combine,
        emit,
        "first long, last long, visits long",
        T.StructType([*events.schema.fields, T.StructField("visit", T.LongType())]),
        tie_break=False,
        **limits,
    )


@query(ORACLES["script_groups"])
def script_groups_cut(t):
    """The longest groups cut into blocks."""
    return script_groups(t, group_rows=10)


_STATUS = {
    "signup": {"visitor": "member", "lost": "member"},
    "click": {"warned": "member"},
    "purchase": "buyer",
    "error": {"member": "warned", "warned": "lost", "buyer": "member"},
}
_STEP = """CASE WHEN {e} = 'purchase' THEN 'buyer'
       WHEN {e} = 'signup' AND {s} IN ('visitor', 'lost') THEN 'member'
       WHEN {e} = 'click' AND {s} = 'warned' THEN 'member'
       WHEN {e} = 'error' AND {s} = 'member' THEN 'warned'
       WHEN {e} = 'error' AND {s} = 'warned' THEN 'lost'
       WHEN {e} = 'error' AND {s} = 'buyer' THEN 'member' ELSE {s} END"""


@query(f"""
WITH RECURSIVE n AS (
  SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (
  SELECT event_id, user_id, event_type, i, {_STEP.format(e="event_type", s="'visitor'")} AS status FROM n WHERE i = 1
  UNION ALL
  SELECT n.event_id, n.user_id, n.event_type, n.i, {_STEP.format(e="n.event_type", s="f.status")}
  FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT event_id, user_id, event_type, status FROM f
""")
def fold_status(t, **limits):
    """A user's status, which each event changes according to what it was."""
    events = select_columns(t.events, ["event_id", "user_id", "ts", "event_type"])
    folded = state_fold(events, "status", _STATUS, "visitor", "event_type", ["user_id"], ["ts", "event_id"], False, **limits)
    return folded.drop("ts")


@query(ORACLES["fold_status"])
def fold_status_hot(t):
    """The same with users cut into ten blocks or so."""
    return fold_status(t, group_rows=7)


@query("""
SELECT conv_id, turn, role, cast(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS bigint) AS switches
FROM (SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS changed FROM conversations)
""")
def script_streamed(t):
    """A sequential script per conversation, which counts the changes of speaker so far."""

    def script(key, frames):
        speaker, switches = None, 0
        for frame in frames:
            counted = []
            for role in frame["role"]:
                switches += speaker is not None and role != speaker
                speaker = role
                counted.append(switches)
            yield frame.assign(switches=counted)

    turns = select_columns(t.conversations, ["conv_id", "turn", "role"])
    return map_groups(turns, ["conv_id"], ["turn"], script, "conv_id long, turn long, role string, switches long")


@query("""
SELECT c_custkey, upper(c_name || ' / ' || c_mktsegment) AS full_name FROM customer
WHERE upper(c_name || ' / ' || c_mktsegment) LIKE '%MACHINERY'
""")
def macro_names(t):
    """A macro: one step builds an upper-case name, the next keeps some of them."""
    normalise = compose(
        lambda df: with_formulas(
            df, [("full_name", fn.uppercase(fn.plus(F.col("c_name"), " / ", F.col("c_mktsegment"))))]
        ),
        lambda df: filter_true(df, fn.endswith(F.col("full_name"), F.lit("MACHINERY"))),
    )
    return t.customer.transform(normalise).select("c_custkey", "full_name")


@query("""
WITH io AS (
  SELECT 'load_' || o_custkey AS object, 'order_' || o_orderkey AS tbl, 'write' AS role FROM orders
  UNION SELECT 'ship_' || l_suppkey, 'order_' || l_orderkey, 'read' FROM lineitem
  UNION SELECT 'load_' || o_custkey, 'order_' || o_orderkey, 'read' FROM orders WHERE o_orderstatus = 'F')
SELECT DISTINCT r.object, w.object AS depends_on FROM io r JOIN io w ON r.tbl = w.tbl
WHERE r.role = 'read' AND w.role = 'write' AND r.object <> w.object
""")
def lineage(t):
    """Shipping jobs read the order tables that loading jobs write."""
    def io(df, prefix, owner, table, role):
        return df.select(
            F.concat(F.lit(prefix), owner).alias("object"),
            F.concat(F.lit("order_"), table).alias("table"),
            F.lit(role).alias("role"),
        )

    orders = t.orders
    rows = (
        io(orders, "load_", "o_custkey", "o_orderkey", "write")
        .unionAll(io(t.lineitem, "ship_", "l_suppkey", "l_orderkey", "read"))
        .unionAll(io(orders.where("o_orderstatus = 'F'"), "load_", "o_custkey", "o_orderkey", "read"))
    )
    return lineage_edges(rows)
