"""One query per operator, with production parameters over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, quality
from millrace.llm.common import held_out, prepare
from millrace.llm.decontamination import find_phrases, hit_words
from millrace.llm.embedding_dedup import near_vectors
from millrace.llm.inner_products import top_products
from millrace.llm.manifest import checked_manifest, lower_ascii
from millrace.llm.minhash_dedup import near_duplicates
from millrace.llm.mixing import Weights, mix, word_count
from millrace.llm.packing import pack, tokenize
from millrace.llm.phrases import collocations
from millrace.llm.sharding import shard, text_key
from millrace.llm.token_counts import token_count
from millrace.llm.warc import archived_pages

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its own name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Target weights; names that are not listed have weight 1.
MIX_WEIGHTS = Weights(
    domain={"web": 5, "reference": 3, "books": 2},
    language={"en": 5, "de": 2, "fr": 2},
    source={"src0": 4, "src1": 2},
)
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 2, 11


def domain_of(source: Column) -> Column:
    """The crawl is the web; sources of even number are reference works, all others books."""
    return F.when(source == "src0", "web").when(source.rlike("^src[0-9]*[02468]$"), "reference").otherwise("books")


def _weight_sql(name: str, weights: Mapping[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _deal_sql(name: str, parent: str, budget: str, weights: Mapping[str, int]) -> str:
    """CTEs that deal the budgets of ``parent`` (columns up to ``name``, excluded) to the children named ``name``."""
    path = {"d": "d", "l": "d, l", "s": "d, l, s"}[name]
    above = path.rpartition(", ")[0]
    part = f"PARTITION BY {above} " if above else ""
    join = f"JOIN {parent} USING ({above})" if above else f", {parent}"
    return f"""
c_{name} AS (
  SELECT {path}, sum(supply) * {MIX_EPOCHS} AS cap, {_weight_sql(name, weights)} AS w FROM leaf GROUP BY {path}
), o_{name} AS (
  SELECT {", ".join("c." + x for x in path.split(", "))}, cap, w, {budget} AS b,
    sum(w) OVER ({part}ORDER BY cap::DOUBLE / w DESC, {name} DESC) AS heavier,
    coalesce(sum(cap) OVER ({part}ORDER BY cap::DOUBLE / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM c_{name} c {join}
), b_{name} AS (
  SELECT *, cap * heavier <= (b - before) * w AS fills FROM o_{name}
), d_{name} AS (
  SELECT {path}, CASE WHEN fills THEN cap ELSE (b - coalesce(sum(cap) FILTER (fills) OVER ({part.strip()}), 0)) * w
    // sum(w) FILTER (NOT fills) OVER ({part.strip()}) END AS {name}_budget
  FROM b_{name}
)"""


@query(f"""
WITH t AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[0-9]*[02468]$') THEN 'reference'
      ELSE 'books' END AS d, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n
  FROM documents
), leaf AS (
  SELECT d, l, s, sum(n)::HUGEINT AS supply FROM t GROUP BY d, l, s
), total AS (
  SELECT sum(supply) * {MIX_PERCENT} // 100 AS b FROM leaf
), {_deal_sql("d", "total", "b", MIX_WEIGHTS.domain)},
{_deal_sql("l", "d_d", "d_budget", MIX_WEIGHTS.language)},
{_deal_sql("s", "d_l", "l_budget", MIX_WEIGHTS.source)},
plan AS (
  SELECT leaf.*, s_budget // supply AS epochs, s_budget % supply AS room FROM leaf JOIN d_s USING (d, l, s) WHERE supply > 0
), e AS (
  SELECT doc_id, d, l, s, n, room, epochs, unnest(range(0, epochs::BIGINT + 1))::INTEGER AS epoch FROM t JOIN plan USING (d, l, s)
), k AS (
  SELECT *, ('0x' || substr(md5('{MIX_SEED}|' || epoch || '|' || doc_id), 1, 15))::BIGINT AS o FROM e
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY d, l, s, epoch ORDER BY o, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS reached FROM k
)
SELECT doc_id, d AS mix_domain, epoch AS mix_epoch, n AS mix_tokens, o AS mix_order
FROM r WHERE epoch < epochs OR (room > 0 AND reached <= room)
""")
def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix_documents(docs, MIX_EPOCHS).drop("text", "lang", "source")


def mix_documents(docs: DataFrame, max_epochs: int) -> DataFrame:
    return mix(
        docs,
        key=F.col("doc_id"),
        domain=domain_of(F.col("source")),
        language=F.col("lang"),
        source=F.col("source"),
        tokens=word_count(F.col("text")),
        weights=MIX_WEIGHTS,
        share_percent=MIX_PERCENT,
        max_epochs=max_epochs,
        seed=MIX_SEED,
    )


@query("""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM k
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages")).drop("target_uri")


SEQUENCE_TOKENS, END_TOKEN = 4096, 1


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = tokenize(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), END_TOKEN, SEQUENCE_TOKENS)
    return pack(pieces, SEQUENCE_TOKENS, ["doc_id", "piece"])


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))), "text", "lang", ["doc_id"])
    scored = docs.withColumn("found", language_id.language_of(docs, F.col("text"), model))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingles FROM w
), u AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT doc_id, l.b FROM reach JOIN l ON l.a = reach.other
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM s JOIN reach USING (doc_id) GROUP BY doc_id, shingles
""")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", shingle_words=2, percent=80)


@query("""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION SELECT vec_id, l.b FROM reach JOIN l ON l.a = reach.other
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(other) AS component_id,
  vec_id = min(other) AS kept
FROM reach GROUP BY vec_id
""")
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", threshold=0.9)


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
""")
def op7_exact_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5)


GOOD_SCORE = 0.7


@query()
def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    scored = docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        quality.quality_score(docs, F.col("text"), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= GOOD_SCORE).cast("int"))


TOKEN_LIMIT = 512


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counted = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


SHARDS, SHARD_TOLERANCE = 40, 0.01


@query(f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, b)) AS steps
), d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS body,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k,
    octet_length(encode(coalesce(text, ''))) + 16 AS size
  FROM documents
), g AS (
  SELECT *, sum(size) OVER (PARTITION BY k) AS held,
    coalesce(sum(size) OVER (ORDER BY k RANGE UNBOUNDED PRECEDING EXCLUDE GROUP), 0) AS before_key,
    coalesce(sum(size) OVER (PARTITION BY k ORDER BY doc_id RANGE UNBOUNDED PRECEDING EXCLUDE GROUP), 0) AS before_row,
    sum(size) OVER () AS total
  FROM d
), p AS (
  SELECT *, ((before_key + CASE WHEN held <= {SHARD_TOLERANCE} * total / {SHARDS} THEN 0 ELSE before_row END)
    * {SHARDS} // total)::INTEGER AS shard
  FROM g
)
SELECT doc_id, size, xor(list_reduce(list_transform(range(octet_length(body)),
    lambda i: ('0x' || substr(hex(body), 2 * i::INT + 1, 2))::BIGINT), lambda a, b:
      xor(a // 256, steps[(xor(a, b) % 256) + 1]), 4294967295), 4294967295) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS slot,
  NULL::INTEGER AS grown_shard
FROM p, crc_table
""")
def op10_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        text_key(F.col("text")).alias("text_key"),
    )
    placed = shard(narrow, SHARDS, F.col("text_key"), F.col("doc_id"), F.col("size"), SHARD_TOLERANCE)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _record_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return " || ".join(f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')" for v in values)


def _tree_sql(name: str, leaves: str, part: str, levels: int) -> str:
    """CTEs ``name``_0 ... over (part, slot, h) of ``leaves`` up to ``levels``, lone nodes left as they are."""
    ctes = [f"{name}_0 AS (SELECT {part}, slot, h, count(*) OVER (PARTITION BY {part}) AS m FROM {leaves})"]
    for k in range(levels):
        ctes.append(f"""{name}_{k + 1} AS (
  SELECT {part}, slot // 8 AS slot, CASE WHEN m = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY slot)) END AS h,
    (m + 7) // 8 AS m
  FROM {name}_{k} GROUP BY {part}, slot // 8, m
)""")
    return ",\n".join(ctes)


def _fold_sql(name: str, part: str, levels: int, start: str) -> str:
    """CTEs that take the rows of ``start`` (part, slot, cur, proof, other columns) through the levels of ``name``."""
    ctes, last = [], start
    for k in range(levels):
        step = f"{start}_{name}_{k}"
        ctes.append(f"""{step}_runs AS (
  SELECT {part}, slot // 8 AS run, list(h ORDER BY slot) AS hs FROM {name}_{k} WHERE m > 1 GROUP BY {part}, slot // 8
), {step} AS (
  SELECT s.* REPLACE (s.slot // 8 AS slot,
    CASE WHEN hs IS NULL THEN cur ELSE sha256(array_to_string(hs[1:s.slot % 8], '') || cur || array_to_string(hs[s.slot % 8 + 2:], '')) END AS cur,
    CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(hs[1:s.slot % 8], '') || array_to_string(hs[s.slot % 8 + 2:], '') END AS proof)
  FROM {last} s LEFT JOIN {step}_runs r ON s.{part} IS NOT DISTINCT FROM r.{part} AND s.slot // 8 = r.run
)""")
        last = step
    return ",\n".join(ctes)


_CRC_TABLE_SQL = """crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, b)) AS steps
)"""


@query(f"""
WITH {_CRC_TABLE_SQL}, d AS (
  SELECT doc_id, lang, sha256({_record_sql("text")}) AS h,
    sha256({_record_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS altered,
    xor(list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INT + 1, 1))::BIGINT),
      lambda a, b: xor(a // 256, steps[(xor(a, b) % 256) + 1]), 4294967295), 4294967295) % 3 = 0 AS tampered
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS slot FROM d
), {_tree_sql("t", "leaves", "lang", 7)},
subroots AS (
  SELECT 0 AS one, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS slot FROM t_7
), {_tree_sql("u", "subroots", "one", 4)},
f AS (
  SELECT doc_id, lang, slot, h AS leaf, CASE WHEN tampered THEN altered ELSE h END AS cur, '' AS proof FROM leaves
), {_fold_sql("t", "lang", 7, "f")},
g AS (
  SELECT 0 AS one, f.doc_id, f.leaf, s.h AS subroot, s.slot, f.cur, f.proof
  FROM f_t_6 f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang
), {_fold_sql("u", "one", 4, "g")}
SELECT doc_id, leaf, subroot, u_4.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u_4.h AS verified
FROM g_u_3, u_4
""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*MANIFEST_FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = {"text": lower_ascii(F.col("text"))}
    return checked_manifest(docs, "lang", "doc_id", MANIFEST_FIELDS, changed, tampered)


PHRASE_WORDS = 10


@query(r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2),
    lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) > 0
), u AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g
  FROM w, (SELECT DISTINCT size FROM g) WHERE len(w) >= size
), o AS (
  SELECT doc_id, pos, u.size, item_id FROM u JOIN g ON u.g = g.g AND u.size = g.size
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM o) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM o GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
""")
def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    items = _table(spark, sf_dir, "benchmark")
    found = find_phrases(docs, "text", items, "item_id", "text", PHRASE_WORDS)
    counted = found.select("doc_id", "found.n_words", hit_words(F.col("found.spans")).alias("n_hit"), "found.items")
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 1, 0) + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM w, (SELECT unnest([1, 2, 3]) AS k)
), f AS MATERIALIZED (
  SELECT lang, k, g, lang || chr(9) || g AS key, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, g
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, k, g, f AS a, string_split(g, ' ') AS ws FROM f WHERE k >= 2 AND f >= 10
), parts AS MATERIALIZED (
  SELECT lang, k, g, a, 1 AS cut, ws[1] AS p, array_to_string(ws[2:], ' ') AS q FROM c
  UNION ALL SELECT lang, k, g, a, 2, array_to_string(ws[1:2], ' '), ws[3] FROM c WHERE k = 3
), cuts AS (
  SELECT t.lang, t.k, t.g, a, cut, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
  FROM parts t JOIN f x ON x.key = t.lang || chr(9) || p JOIN f y ON y.key = t.lang || chr(9) || q
), best AS (
  SELECT lang, k, g, a, l, r, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS o FROM cuts) WHERE o = 1
), inside AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS g, max(a) AS most FROM c, (SELECT unnest([1, 2]) AS i)
  WHERE k = 3 GROUP BY lang, array_to_string(ws[i:i + 1], ' ')
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside ON best.k = 2 AND best.lang = inside.lang AND best.g = inside.g
  WHERE most IS NULL OR 100 * most < 50 * a
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM kept
)
SELECT lang, rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM r JOIN n USING (lang) WHERE rank <= 2000
""")
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), "text", "lang", longest=3, least=10, top=2000, inside_percent=50)
