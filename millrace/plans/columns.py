"""Projection, filter, formula and cleansing queries."""

from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import vocabulary as fn
from millrace.operators.cleanse import cleanse
from millrace.operators.columns import Col, add_audit_columns, rename_columns, select_columns, standardize_column_names
from millrace.operators.filters import filter_false, filter_true, split
from millrace.operators.formulas import multi_field, with_formulas
from millrace.operators.sets import union_all
from millrace.plans.registry import query


@query("""
SELECT cast(o_orderkey AS varchar) AS "Order ID", cast(o_orderdate AS date) AS order_date,
       cast(o_totalprice AS decimal(18, 2)) AS o_totalprice, o_custkey, o_orderstatus
FROM orders
""")
def select_cast(t):
    return select_columns(
        t.orders,
        [
            Col("o_orderkey", rename="Order ID", cast="string"),
            Col("o_orderdate", rename="order_date", cast="date"),
            Col("o_totalprice", cast="decimal(18,2)"),
            Col("o_orderpriority", drop=True),
        ],
        keep_rest=True,
    )


@query("""
SELECT l_orderkey AS order_key, l_partkey AS part_id, l_suppkey AS supplier_id, l_shipdate AS ship_date,
       l_quantity AS l_quantity, l_extendedprice AS extended_price_usd
FROM lineitem
""")
def snake_names(t):
    narrow = select_columns(
        t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    )
    mixed = rename_columns(
        narrow,
        {
            "l_orderkey": "OrderKey",
            "l_partkey": "PartID",
            "l_suppkey": "Supplier[ID]",
            "l_shipdate": "Ship Date",
            "l_extendedprice": "extendedPrice (USD)",
        },
    )
    return standardize_column_names(mixed)


@query("""
SELECT *, TIMESTAMP '2024-05-01 12:00:00' AS _ingested_at, 'order_desk' AS _source_system FROM orders
""")
def audit(t):
    stamped = add_audit_columns(t.orders, "order_desk", datetime(2024, 5, 1, 12))
    return stamped.withColumn("_ingested_at", F.col("_ingested_at").cast("timestamp_ntz"))


_NOT_VIEW = "nullif(event_type, 'error') <> 'view'"


@query(f"SELECT * FROM events WHERE {_NOT_VIEW}")
def filter_true_rows(t):
    return filter_true(t.events, _NOT_VIEW)


@query(f"SELECT * FROM events WHERE NOT ({_NOT_VIEW})")
def filter_false_rows(t):
    return filter_false(t.events, _NOT_VIEW)


@query(f"""
SELECT *, CASE WHEN {_NOT_VIEW} THEN 'true' ELSE 'false' END AS stream FROM events
""")
def filter_split(t):
    kept, rest = split(t.events, _NOT_VIEW, nulls="false")
    return union_all(kept.withColumn("stream", F.lit("true")), rest.withColumn("stream", F.lit("false")))


@query("""
SELECT * FROM orders
WHERE o_orderpriority LIKE '%-HIGH' AND o_orderstatus IN ('O', 'F')
  AND o_totalprice BETWEEN 1000 AND 400000 AND regexp_matches(o_orderpriority, '^[0-9]')
  AND starts_with(o_orderpriority, '2') AND NOT (o_orderstatus IS NULL OR o_orderstatus = '')
""")
def predicates(t):
    return filter_true(
        t.orders,
        F.expr("o_orderpriority LIKE '%-HIGH' AND o_orderstatus IN ('O', 'F')")
        & F.expr("o_totalprice BETWEEN 1000 AND 400000")
        & fn.regex_match(F.col("o_orderpriority"), "^[0-9]")
        & fn.startswith(F.col("o_orderpriority"), F.lit("2"))
        & ~fn.is_empty(F.col("o_orderstatus")),
    )


@query("""
SELECT *, net * (1 + l_tax) AS gross, CASE WHEN net > 50000 THEN 'big' WHEN net > 20000 THEN 'mid' ELSE 'small' END AS band,
       cast(cast(l_quantity AS integer) AS varchar) AS pieces
FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
""")
def formula_chain(t):
    return with_formulas(
        t.lineitem,
        [
            ("net", "l_extendedprice * (1 - l_discount)"),
            ("gross", "net * (1 + l_tax)"),
            ("band", fn.case_when((F.col("net") > 50000, "big"), (F.col("net") > 20000, "mid"), otherwise="small")),
            ("pieces", "cast(l_quantity AS int)", "string"),
        ],
    )


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, 'l_returnflag=' || l_returnflag AS l_returnflag,
       'l_linestatus=' || l_linestatus AS l_linestatus
FROM lineitem
""")
def multi_field_in_place(t):
    narrow = select_columns(t.lineitem, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"])
    return multi_field(narrow, ["l_returnflag", "l_linestatus"], "concat({name}, '=', {current})")


@query("""
SELECT *, cast(l_quantity AS double) / 10 AS "New_l_quantity", cast(l_linenumber AS double) / 10 AS "New_l_linenumber"
FROM lineitem
""")
def multi_field_prefix(t):
    return multi_field(
        t.lineitem, ["l_quantity", "l_linenumber"], lambda value, name: value.cast("double") / 10, prefix="New_"
    )


@query(r"""
SELECT doc_id, lower(regexp_replace(trim(text, ' '), '\s+', ' ', 'g')) AS text,
       coalesce(lower(nullif(lang, 'en')), '') AS lang, coalesce(nullif(n_chars, 0), 0) AS n_chars
FROM documents
""")
def cleanse_text(t):
    holes = t.documents.select(
        "doc_id",
        "text",
        F.nullif("lang", F.lit("en")).alias("lang"),
        F.nullif("n_chars", F.lit(0).cast("long")).alias("n_chars"),
    )
    return cleanse(
        holes,
        columns=["text", "lang", "n_chars"],
        trim=True,
        collapse_whitespace=True,
        case="lower",
        nulls_to_blank=True,
        numeric_nulls_to_zero=True,
    )


@query(r"""
SELECT p_partkey, upper(regexp_replace(p_name, '\s', '', 'g')) AS p_name,
       coalesce(nullif(upper(p_brand), 'BRAND#2'), '') AS p_brand, coalesce(nullif(p_size, 11), 0) AS p_size
FROM part
""")
def cleanse_names(t):
    holes = t.part.select(
        "p_partkey",
        "p_name",
        F.nullif("p_brand", F.lit("Brand#2")).alias("p_brand"),
        F.nullif("p_size", F.lit(11)).alias("p_size"),
    )
    return cleanse(
        holes, remove_all_whitespace=True, case="upper", nulls_to_blank=True, numeric_nulls_to_zero=True
    )


@query("""
SELECT o_orderkey, upper(o_orderpriority) AS up, lower(o_orderpriority) AS low, left(o_orderpriority, 1) AS first_char,
       right(o_orderpriority, 3) AS last_chars, length(o_orderpriority) AS chars,
       replace(o_orderpriority, '-', ' ') AS spaced, substring(o_orderpriority, 3, 4) AS middle,
       substring(o_orderpriority, 3) AS tail, right('0000000000' || o_orderkey, 10) AS padded,
       rpad(o_orderstatus, 4, '*') AS star, translate(o_orderpriority, '-EI', '_ei') AS swapped,
       contains(o_orderpriority, 'HIGH') AS has_high, ends_with(o_orderpriority, 'LOW') AS is_low,
       regexp_replace(o_orderpriority, '[AEIOU]', '.', 'g') AS dotted,
       regexp_extract(o_orderpriority, '^([0-9])-(.*)$', 2) AS word, md5(o_orderpriority) AS digest,
       o_orderstatus || '/' || o_orderpriority AS joined, cast(o_orderkey AS varchar) AS key_text,
       cast(cast(o_orderkey AS varchar) AS double) AS key_number, trim('  ' || o_orderstatus || ' ') AS trimmed,
       ltrim('  ' || o_orderstatus) AS trimmed_left, rtrim(o_orderstatus || '  ') AS trimmed_right,
       len(string_split(o_orderpriority, '-')) AS parts
FROM orders
""")
def fn_strings(t):
    priority, status, key = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")
    blanks = fn.plus("  ", status, " ")
    return t.orders.select(
        "o_orderkey",
        fn.uppercase(priority).alias("up"),
        fn.lowercase(priority).alias("low"),
        fn.left(priority, F.lit(1)).alias("first_char"),
        fn.right(priority, F.lit(3)).alias("last_chars"),
        fn.length(priority).cast("long").alias("chars"),
        fn.replace(priority, F.lit("-"), F.lit(" ")).alias("spaced"),
        fn.substring(priority, 2, 4).alias("middle"),
        fn.substring(priority, 2).alias("tail"),
        fn.pad_left(fn.to_string(key), 10, "0").alias("padded"),
        fn.pad_right(status, 4, "*").alias("star"),
        fn.replace_char(priority, "-EI", "_ei").alias("swapped"),
        fn.contains(priority, F.lit("HIGH")).alias("has_high"),
        fn.endswith(priority, F.lit("LOW")).alias("is_low"),
        fn.regex_replace(priority, "[AEIOU]", ".").alias("dotted"),
        fn.regexp_extract(priority, "^([0-9])-(.*)$", 2).alias("word"),
        fn.md5_ascii(priority).alias("digest"),
        fn.plus(status, "/", priority).alias("joined"),
        fn.to_string(key).alias("key_text"),
        fn.to_number(fn.to_string(key)).alias("key_number"),
        fn.trim(blanks).alias("trimmed"),
        fn.trim_left(fn.plus("  ", status)).alias("trimmed_left"),
        fn.trim_right(fn.plus(status, "  ")).alias("trimmed_right"),
        fn.size(fn.split(priority, "-")).cast("long").alias("parts"),
    )


@query("""
SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h,
       ts + INTERVAL 1 YEAR AS plus_year, ts + INTERVAL 3 MONTH AS plus_quarter, ts - INTERVAL 2 MONTH AS minus_months,
       ts + INTERVAL 7 DAY AS plus_week, ts + INTERVAL 5 DAY AS plus_days, ts + INTERVAL 36 HOUR AS plus_hours,
       ts + INTERVAL 90 MINUTE AS plus_minutes, ts - INTERVAL 15 SECOND AS minus_seconds,
       date_diff('day', TIMESTAMP '2023-12-25', ts) AS days_since,
       date_sub('hour', TIMESTAMP '2023-12-25', ts) AS hours_since,
       ts - INTERVAL 9 HOUR AS tokyo_as_utc, ts + INTERVAL 9 HOUR AS utc_in_tokyo,
       cast(ts AS date) AS just_date, cast(ts AS date) + 10 AS later_date, cast(ts AS date) - 10 AS earlier_date,
       strftime(ts, '%Y%m%d') AS compact
FROM events
""")
def fn_dates(t):
    ts = F.col("ts")
    base = F.lit("2023-12-25").cast("timestamp_ntz")

    def plain(value):
        return value.cast("timestamp_ntz")

    return t.events.select(
        "event_id",
        fn.date_time_year(ts).cast("long").alias("y"),
        fn.date_time_month(ts).cast("long").alias("m"),
        fn.date_time_day(ts).cast("long").alias("d"),
        fn.date_time_hour(ts).cast("long").alias("h"),
        fn.date_time_add(ts, 1, "years").alias("plus_year"),
        fn.date_time_add(ts, 1, "quarter").alias("plus_quarter"),
        fn.date_time_add(ts, -2, "month").alias("minus_months"),
        fn.date_time_add(ts, 1, "week").alias("plus_week"),
        fn.date_time_add(ts, 5, "days").alias("plus_days"),
        fn.date_time_add(ts, 36, "hour").alias("plus_hours"),
        fn.date_time_add(ts, 90, "minutes").alias("plus_minutes"),
        fn.date_time_add(ts, -15, "second").alias("minus_seconds"),
        fn.date_time_diff(ts, base, "days").cast("long").alias("days_since"),
        fn.date_time_diff(ts, base, "hours").cast("long").alias("hours_since"),
        plain(fn.date_time_to_utc(ts, "Asia/Tokyo")).alias("tokyo_as_utc"),
        plain(fn.date_time_to_local(ts, "Asia/Tokyo")).alias("utc_in_tokyo"),
        fn.date(ts).alias("just_date"),
        fn.date_add(fn.date(ts), 10).alias("later_date"),
        fn.date_sub(fn.date(ts), 10).alias("earlier_date"),
        fn.date_format(ts, "yyyyMMdd").alias("compact"),
    )


@query("""
SELECT p_partkey, ceil(p_retailprice / 7) AS up, floor(p_retailprice / 7) AS down, round(p_retailprice, 0) AS near,
       abs(p_size - 25) AS dist, sqrt(p_size) AS root, pow(p_size, 2) AS squared, p_size % 7 AS rest,
       round(ln(p_size), 9) AS nat, round(log10(p_size), 9) AS dec, round(exp(p_size / 50.0), 9) AS grown,
       isnan(p_retailprice) AS nan
FROM part
""")
def fn_math(t):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return t.part.select(
        "p_partkey",
        fn.ceiling(price / 7).cast("double").alias("up"),
        fn.floor(price / 7).cast("double").alias("down"),
        fn.round(price, 0).alias("near"),
        fn.abs(size - 25).alias("dist"),
        fn.sqrt(size).alias("root"),
        fn.power(size, F.lit(2)).alias("squared"),
        fn.mod(size, 7).alias("rest"),
        fn.round(fn.ln(size), 9).alias("nat"),
        fn.round(fn.log10(size), 9).alias("dec"),
        fn.round(fn.exp(size / 50.0), 9).alias("grown"),
        fn.isnan(price).alias("nan"),
    )


@query("""
SELECT event_id, nullif(event_type, 'error') IS NULL AS missing, nullif(event_type, 'error') IS NOT NULL AS present,
       coalesce(nullif(event_type, 'error'), 'none') AS filled,
       nullif(replace(event_type, 'view', ''), 'error') IS NULL OR nullif(replace(event_type, 'view', ''), 'error') = '' AS empty,
       greatest(value, 50.0) AS high, least(value, 50.0) AS low,
       CASE WHEN nullif(event_type, 'error') = 'click' THEN 1 ELSE 0 END AS clicked
FROM events
""")
def fn_nulls(t):
    kind = fn.nullif(F.col("event_type"), F.lit("error"))
    stripped = fn.nullif(fn.replace(F.col("event_type"), F.lit("view"), F.lit("")), F.lit("error"))
    return t.events.select(
        "event_id",
        fn.is_null(kind).alias("missing"),
        fn.is_not_null(kind).alias("present"),
        fn.coalesce(kind, F.lit("none")).alias("filled"),
        fn.is_empty(stripped).alias("empty"),
        fn.greatest(F.col("value"), F.lit(50.0)).alias("high"),
        fn.least(F.col("value"), F.lit(50.0)).alias("low"),
        fn.iif(kind == "click", 1, 0).alias("clicked"),
    )


@query("""
SELECT o_orderkey, 'Q' || cast(cast(ceil(month(o_orderdate) / 3.0) AS integer) AS varchar) || '/'
       || right(cast(year(o_orderdate) AS varchar), 2) AS quarter_year,
       CASE WHEN NOT (nullif(o_orderstatus, 'P') IS NULL OR nullif(o_orderstatus, 'P') = '') THEN 'Internal' ELSE 'External' END AS kind
FROM orders
""")
def quarter_label(t):
    date = F.col("o_orderdate")
    quarter = fn.to_string(fn.ceil(fn.date_time_month(date) / 3))
    status = fn.nullif(F.col("o_orderstatus"), F.lit("P"))
    return with_formulas(
        t.orders,
        [
            ("quarter_year", fn.plus("Q", quarter, "/", fn.right(fn.to_string(fn.date_time_year(date)), F.lit(2)))),
            ("kind", fn.iif(~fn.is_empty(status), "Internal", "External")),
        ],
    ).select("o_orderkey", "quarter_year", "kind")


@query("""
SELECT event_id, true AS now_is_now, true AS today_is_today, upper(left(event_type, 1)) || substring(event_type, 2) AS title,
       event_type || '-' || event_id AS joined, cast(floor(value + 0.5) AS bigint) AS whole, round(log2(value + 1), 9) AS bits,
       cast(strftime(ts, '%Y-%m-%d') AS date) AS day_read, cast(date_trunc('day', ts) AS timestamp) AS stamp_read,
       cast(ts AS date) + 3 AS later, [event_type, 'x'] AS pair
FROM events
""")
def fn_more(t):
    """The clock, title case, concatenation, casts, logarithms and reading of dates."""
    ts, kind = F.col("ts"), F.col("event_type")
    day = fn.date_format(ts, "yyyy-MM-dd")
    now, today = fn.date_time_now(), fn.date_time_today()
    return t.events.select(
        "event_id",
        ((now <= F.current_timestamp()) & (now > F.lit("2024-01-01").cast("timestamp"))).alias("now_is_now"),
        (today.cast("date") == F.current_date()).alias("today_is_today"),
        fn.title_case(kind).alias("title"),
        fn.concat(kind, F.lit("-"), fn.to_string(F.col("event_id"))).alias("joined"),
        fn.cast(fn.floor(F.col("value") + 0.5), "bigint").alias("whole"),
        fn.round(fn.log(2.0, F.col("value") + 1), 9).alias("bits"),
        fn.to_date(day, "yyyy-MM-dd").alias("day_read"),
        fn.to_timestamp(day, "yyyy-MM-dd").cast("timestamp_ntz").alias("stamp_read"),
        fn.date_add(fn.date(ts), 3).alias("later"),
        fn.array(kind, F.lit("x")).alias("pair"),
    )
