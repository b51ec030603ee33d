"""Text parsing queries over whole texts."""

from pyspark.sql import functions as F

from millrace.operators.columns import select_columns
from millrace.operators.relate import similar_sets, similar_sets_many, tag_counts
from millrace.operators.text import (
    format_datetime,
    parse_datetime,
    regex_match,
    regex_parse,
    regex_replace,
    regex_tokenize,
    regex_tokenize_columns,
    text_to_columns,
    text_to_rows,
)
from millrace.plans.registry import query


@query("""
SELECT p_partkey, p_name, p[1] AS word1, p[2] AS word2, p[3] AS word3
FROM (SELECT *, string_split(p_name, ' ') AS p FROM part)
""")
def split_cols(t):
    return text_to_columns(select_columns(t.part, ["p_partkey", "p_name"]), "p_name", " ", 3, prefix="word", extra="drop")


@query("""
SELECT doc_id, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
""")
def split_rows(t):
    rows = text_to_rows(select_columns(t.documents, ["doc_id", "text"]), "text", "\n", position="line")
    return rows.withColumn("line", F.col("line").cast("long"))


_URL = r"^([a-z]+)://([^/]+)(/[^?#]*)"


@query(rf"""
SELECT page_id, url, CASE WHEN ok THEN regexp_extract(url, '{_URL}', 1) END AS scheme,
       CASE WHEN ok THEN regexp_extract(url, '{_URL}', 2) END AS host, CASE WHEN ok THEN regexp_extract(url, '{_URL}', 3) END AS path
FROM (SELECT *, regexp_matches(url, '{_URL}') AS ok FROM pages)
""")
def regex_parse_urls(t):
    return regex_parse(select_columns(t.pages, ["page_id", "url"]), "url", _URL, ["scheme", "host", "path"])


_MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"


@query(f"SELECT doc_id, regexp_matches(text, '{_MAIL}') AS has_mail FROM documents")
def regex_flag(t):
    return regex_match(t.documents, "text", _MAIL, "has_mail").select("doc_id", "has_mail")


@query("SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS text FROM documents")
def regex_repl(t):
    return regex_replace(select_columns(t.documents, ["doc_id", "text"]), "text", "[0-9]+", "#")


@query(r"""
SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS at
FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}0-9]+') AS tokens FROM documents)
""")
def regex_tokens(t):
    rows = regex_tokenize(
        select_columns(t.documents, ["doc_id", "text"]), "text", r"[\p{L}0-9]+", alias="token", position="at"
    )
    return rows.select("doc_id", "token", F.col("at").cast("long").alias("at"))


@query("""
SELECT page_id, url, p[1] AS part1, p[2] AS part2, p[3] AS part3
FROM (SELECT *, regexp_extract_all(url, '[a-z0-9]+') AS p FROM pages)
""")
def regex_token_cols(t):
    return regex_tokenize_columns(select_columns(t.pages, ["page_id", "url"]), "url", "[a-z0-9]+", 3, prefix="part")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS full_text
FROM orders
""")
def format_dt(t):
    shown = format_datetime(t.orders, "o_orderdate", "%d/%m/%Y", alias="shown")
    return format_datetime(shown, "o_orderdate", "%Y-%m-%d %H:%M:%S", alias="full_text").select(
        "o_orderkey", "shown", "full_text"
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN cast(o_orderdate AS date) END AS day,
       CASE WHEN o_orderstatus <> 'P' THEN cast(cast(o_orderdate AS date) AS timestamp) END AS stamp
FROM orders
""")
def parse_dt(t):
    """Dates written as text, those of pending orders unreadable."""
    text = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("to be fixed")
    written = t.orders.select("o_orderkey", text.alias("text"))
    parsed = parse_datetime(written, "text", "%d/%m/%Y", to="date", alias="day", on_error="null")
    parsed = parse_datetime(parsed, "text", "%d/%m/%Y", to="timestamp", alias="stamp", on_error="null")
    return parsed.select("o_orderkey", "day", F.col("stamp").cast("timestamp_ntz").alias("stamp"))


def _tagged(t):
    return t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("tags"))


_ASKED = ["the", "and", "on", "is", "le", "la", "des", "by"]
_ASKED_SQL = "[" + ", ".join(f"'{w}'" for w in _ASKED) + "]"


@query(rf"""
SELECT doc_id, score FROM (
  SELECT doc_id, len(list_intersect(tags, {_ASKED_SQL}))
         / (len(tags) + len({_ASKED_SQL}) - len(list_intersect(tags, {_ASKED_SQL}))) AS score
  FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{{L}}+')) AS tags FROM documents))
WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20
""")
def similar_tags(t):
    return similar_sets(_tagged(t), "doc_id", "tags", _ASKED, k=20).select("doc_id", "score")


@query(r"""
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}+')) AS tags FROM documents),
p AS (SELECT doc_id, len(tags) AS size, unnest(tags) AS tag FROM d),
pairs AS (
  SELECT q.doc_id AS query_id, r.doc_id AS id, count(*) / (q.size + r.size - count(*)) AS score
  FROM p q JOIN p r ON q.tag = r.tag WHERE q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id
  GROUP BY q.doc_id, r.doc_id, q.size, r.size)
SELECT query_id, rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs) WHERE rank <= 5
""")
def similar_tags_many(t):
    """Every 50th document asks all documents."""
    tagged = _tagged(t)
    return similar_sets_many(tagged.where("doc_id % 50 = 0"), tagged, "doc_id", "tags", 5, exclude_same_id=True)


@query(r"""
SELECT tag, count(*) AS count FROM (
  SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS tag FROM documents) GROUP BY tag
""")
def tag_totals(t):
    return tag_counts(_tagged(t), "tags")
