"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import gzip
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import embedding_dedup, language_id, quality
from millrace.llm.embedding_dedup import near_vectors
from millrace.llm.inner_products import top_products
from millrace.llm.minhash_dedup import near_duplicates
from millrace.llm.mixing import Weights, budgets, deal, mix, word_count
from millrace.llm.packing import WordIds, pack, plan, tokenize
from millrace.llm.sharding import shard, text_key
from millrace.llm.token_counts import Merges, token_count
from millrace.llm.warc import WarcSource, archived_pages, member, record, write_pages
from millrace.session import scratch_path

LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
EN = "the cat sat on the mat and it was warm that day in the old town "
DE = "der hund lag auf dem sofa und es war kalt an diesem tag in der stadt "
ROWS = [
    (1, EN * 3, "en", "src0"), (2, EN * 3, "en", "src0"), (3, EN * 3 + "by the sea", "en", None),
    (4, DE * 3, "de", "src1"), (4, DE * 3, "de", "src1"), (5, None, "de", "src2"), (6, "", None, "src2"),
    (7, "1234 !!", "en", "src3"), (None, EN, "en", "src3"), (None, None, None, None), (8, LONG, "en", "src4"),
    (9, LONG + " end", "en", "src4"), (10, "single", None, "src0"), (11, "Single", "en", "src0"), (12, " \n ", "fr", "src0"),
]
# Names that the operators use themselves.
EXTRA = ["id", "n", "class", "text_", "score", "shard", "slot", "LENGTH", "piece", "bucket", "component", "sequence_id",
         "offset", "__tag", "__key", "__salt", "mix_epoch", "node", "v", "held"]


def _docs(session, rows=ROWS, extra=True):
    df = session.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for i, name in enumerate(EXTRA if extra else []):
        df = df.withColumn(name, F.lit(i))
    return df.repartition(3)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _shingles(text, k):
    w = _words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _components(nodes, linked):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


# --- near duplicates -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_of_odd_rows(session, size):
    got = near_duplicates(_docs(session), "doc_id", "text", size, 80).collect()
    sets = [(i, r[0], _shingles(r[1], size)) for i, r in enumerate(ROWS)]
    root = {i: i for i, *_ in sets}
    usable = [x for x in sets if x[1] is not None and x[2]]
    links = [(a[0], b[0]) for a, b in itertools.combinations(usable, 2) if 100 * len(a[2] & b[2]) >= 80 * len(a[2] | b[2])]
    root = _components([x[0] for x in sets], links)
    least = {r: min(ROWS[i][0] for i in root if root[i] == r and ROWS[i][0] is not None) for r in {root[x[0]] for x in usable}}
    want = Counter((d, len(s), least.get(root[i], d) if d is not None else None) for i, d, s in sets)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_lose_no_link(session):
    """Chains of edits around a common text, as many as a bucket's tile, against all pairs."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 400, 120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 16)), replace=False):
            words[at] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(words), "en", "s"))
    got = {r.doc_id: r.component_id for r in near_duplicates(_docs(session, rows, False), "doc_id", "text", 2, 80).collect()}
    sets = [_shingles(r[1], 2) for r in rows]
    links = [(a, b) for a, b in itertools.combinations(range(400), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    neighbours = defaultdict(set)
    for a, b in links:
        neighbours[a].add(b)
        neighbours[b].add(a)
    want, seen = {}, set()
    for i in range(400):
        if i not in seen:
            group, todo = set(), [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += neighbours[x]
            seen |= group
            want |= dict.fromkeys(group, min(group))
    assert got == want


def test_near_duplicates_at_low_thresholds(session):
    """Pairs that just reach half: none may be lost."""
    rows = []
    for i in range(60):
        shared = [f"s{i}w{x}" for x in range(200)]
        for side in "ab":
            rows.append((len(rows), " ".join(shared + [f"{side}{i}w{x}" for x in range(100)]), "en", "s"))
    got = {r.doc_id: r.component_id for r in near_duplicates(_docs(session, rows, False), "doc_id", "text", 1, 50).collect()}
    assert got == {i: i - i % 2 for i in range(120)}
    with pytest.raises(ValueError):
        near_duplicates(_docs(session, rows[:2], False), "doc_id", "text", 1, 2)


# --- vectors ---------------------------------------------------------------------------------------------------------

NAN, INF = float("nan"), float("inf")
VECTORS = [
    (0, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (1, [0.95, 0.1, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [NAN, 1.0, 0.0]),
    (5, [INF, 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, [1e-30, 0.0, 0.0]), (8, [0.0, 3e30, 1e29]), (100, [0.0, 1.0, 0.0]),
    (None, [0.0, 1.0, 0.0]), (9, [1.0, 2.0]), (10, [2.0, 4.0]), (11, []), (12, [-1.0, 0.0, 0.0]), (12, [-1.0, 0.0, 0.0]),
]


def _vectors(session, rows=VECTORS):
    df = session.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "class", "score", "rank", "tag", "block", "links", "many", "dimension", "vector"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


def test_near_vectors_of_odd_rows(session):
    good = [(i, k, np.array(v, float)) for i, (k, v) in enumerate(VECTORS) if v and None not in v and np.isfinite(v).all() and any(v)]

    def cosine(a, b):
        a, b = a / abs(a).max(), b / abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b))

    links = [
        (a[0], b[0]) for a, b in itertools.combinations(good, 2) if len(a[2]) == len(b[2]) and cosine(a[2], b[2]) >= 0.9
    ]
    degree = Counter(x for pair in links for x in pair)
    root = _components(range(len(VECTORS)), links)
    want = []
    for i, (k, _) in enumerate(VECTORS):
        group = [VECTORS[j][0] for j in root if root[j] == root[i] and VECTORS[j][0] is not None]
        want.append((k, degree[i], min(group) if group else None))
    got = near_vectors(_vectors(session), "vec_id", "embedding", 0.9).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_lose_no_link(session):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((6, 24))
    x = centre[rng.integers(0, 6, 500)] + 0.32 * rng.standard_normal((500, 24))
    got = near_vectors(session.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, e array<double>"), "k", "e")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert 100 < near.sum() and {r.k: r.n_links for r in got.collect()} == dict(enumerate(near.sum(axis=1).tolist()))


def test_near_vectors_when_later_jobs_split_files_otherwise(session, monkeypatch):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((40, 16))
    x = centre[np.arange(200) % 40] + 0.05 * rng.standard_normal((200, 16))
    df = session.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, e array<double>")

    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.minPartitionNum": "64"}
    before = {k: session.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            session.conf.set(k, v)
        original = embedding_dedup.components
        monkeypatch.setattr(embedding_dedup, "components", lambda *a: _fewer_cores(session, original(*a)))
        got = {r.k: (r.n_links, r.component_id) for r in near_vectors(df, "k", "e").collect()}
    finally:
        for k, v in before.items():
            session.conf.unset(k) if v is None else session.conf.set(k, v)
    assert got == {i: (4, i % 40) for i in range(200)}


def _fewer_cores(session, df):
    session.conf.set("spark.sql.files.minPartitionNum", "1")
    return df


def test_top_products_of_odd_rows(session):
    rows = [(k, v if v is None or len(v) != 3 else [x if x is None or not 1 < abs(x) < INF else 3.5 for x in v]) for k, v in VECTORS]
    good = [(k, np.floor(np.array(v, float) * 256)) for k, v in rows if v and None not in v and np.isfinite(v).all() and k is not None]
    want = []
    for q, x in good:
        if q % 50 == 0:
            scores = sorted((-int(x @ y), k) for k, y in good if k != q and len(y) == len(x))
            want += [(q, n, k, -s) for n, (s, k) in enumerate(scores[:5], 1)]
    got = top_products(_vectors(session, rows), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_top_products_beyond_exact_doubles(session):
    rows = [(0, [3e6, 1.0]), (1, [3e6, 1.0]), (2, [3e6, 0.5])]
    df = session.createDataFrame(rows, "k long, e array<double>")
    got = [(r.k, r.score) for r in top_products(df, "k", "e", F.col("k") == 0).orderBy("rank").collect()]
    big = 256 * 3_000_000
    assert got == [(1, big * big + 65536), (2, big * big + 32768)]


def test_top_products_tell_odd_scores_beyond_doubles(session):
    rows = [(0, [3e6, 1 / 256]), (1, [3e6, 255 / 256]), (2, [3e6, 1.0]), (3, [3e6, 257 / 256])]
    df = session.createDataFrame(rows, "k long, e array<double>")
    got = [(r.k, r.score) for r in top_products(df, "k", "e", F.col("k") == 0).orderBy("rank").collect()]
    big = 256 * 3_000_000
    assert got == [(3, big * big + 257), (2, big * big + 256), (1, big * big + 255)]


# --- sharding --------------------------------------------------------------------------------------------------------


def _sharded(session, rows, shards, tolerance, part_bytes=256 << 20):
    docs = _docs(session, rows)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    return shard(docs, shards, text_key(F.col("text")), F.col("doc_id"), size, tolerance, part_bytes).collect()


@pytest.mark.parametrize("part_bytes", [256 << 20, 2000])
def test_shards_are_even_gapless_and_keep_small_groups(session, part_bytes):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(0, 300)) + str(i // 3 if i < 300 else i), "en", "s") for i in range(900)]
    rows += [(1000 + i, "a hot text that is one of many copies", "en", "s") for i in range(600)]
    got = _sharded(session, rows, 8, 0.05, part_bytes)
    assert len(got) == len(rows) and set(EXTRA) <= set(got[0].asDict())
    size, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += len(r.text.encode()) + 16
        slots[r.shard].append(r.slot)
        places[r.text].add(r.shard)
    mean = sum(size.values()) / 8
    assert set(size) == set(range(8)) and max(abs(v - mean) for v in size.values()) <= 0.05 * mean + 320
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [t for t, s in places.items() if len(s) > 1] == ["a hot text that is one of many copies"]


def test_shards_of_odd_rows_and_of_few_rows(session):
    got = _sharded(session, ROWS, 4, 0.01)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in ROWS)
    assert {r.shard for r in _sharded(session, ROWS[:1], 40, 0.01)} <= set(range(40))


# --- tokens and packing ----------------------------------------------------------------------------------------------


def test_token_counts_of_odd_texts(session):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["  a   b", "a<|endoftext|> b", "<|endoftext|><|endoftext|>", "aaaaaaaaaaa aaaa", "x \n y\n\nz\t\tq ", "don't we'll I'M",
           "\x1c\x1f a\x85b c  d", "日本語 テスト🎉", "a\r\nb \r\n", " lead", "trail ", "é" * 500, "x​x"]
    rows = ROWS + [(100 + i, t, None, None) for i, t in enumerate(odd)]
    got = _docs(session, rows).select("text", token_count(F.col("text"), path).alias("t")).collect()
    assert len(got) == len(rows)
    assert all(r.t == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in got)
    merges = Merges.load(path)
    merges.words["stale"] = 1
    assert merges.count([]).tolist() == []


def test_packing_of_odd_rows(session):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["a.", "x, .", "a...", "Ab. <|EndOfText|> <|endoftext|>.", "é. è,", "don.t, U.S. a., b", "ΣΑΣ İ", "e ́ x"]
    rows = ROWS + [(100 + i, t, None, None) for i, t in enumerate(odd)]
    got = tokenize(_docs(session, rows), "doc_id", "text", path, 1, 4096, keep_ids=True).collect()
    ids = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in rows)
    whole = Counter()
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        if r.start == 0:
            whole[(r.doc_id, r.piece)] += 1
    assert Counter({(k, t): n for (k, t), n in ids.items() if len(t) <= 4096}) == Counter(
        (r.doc_id, tuple(r.ids)) for r in got if r.piece == 0 and r.length < 4096
    )
    assert whole == Counter((k, 0) for (k, _), n in ids.items() for _ in range(n))
    pieces = session.createDataFrame([(1, 0, 3, 7), (1, 0, 3, 8), (None, 1, 1, 9)], "doc_id long, piece int, length long, `offset` int")
    assert sorted(tuple(r) for r in pack(pieces, 4, ["doc_id", "piece"]).select("length", "sequence_id", "offset").collect()) == [
        (1, 0, 3), (3, 0, 0), (3, 1, 0)]


def test_capitals_before_combining_marks_have_the_librarys_ids():
    """Capitals whose small letters alone have composed forms; special strings change no neighbour."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    marked = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    texts = marked + [f"xA{p}Bc, {p}. Q{p}" for p in marked] + ["J\u0323\u030c", "A\u0301 GR\u00d6SSE", "J", "\u030c", "", "AB"]
    special = ["Ab <|EndOfText|>Cd Ab", "X<|endoftext|>Y AB", "<|", "A<", "|B", "<|ENDOFTEXT|>", "<|startoftext|>."]
    for some in (texts, texts + special):
        parts = [t.encode() for t in some]
        words = WordIds(path)
        ids, bounds = words.encode(np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])])
        for i, t in enumerate(some):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    # Special strings keep only their own words from being simplified.
    assert {b"ab", b"<|EndOfText|>Cd"} <= set(words.codes) and b"Ab" not in words.codes


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(4)
    counts = Counter(int(x) for x in np.r_[rng.integers(1, 101, 2000), np.full(500, 37), np.full(90, 100)])
    used = defaultdict(list)
    for length, low, high, first, offset, each in plan(counts, 100):
        for rank in range(low, high):
            k = rank - low
            used[first + k // each].append((offset + k % each * length, length))
    assert sum(len(v) for v in used.values()) == sum(counts.values())
    for places in used.values():
        ends = list(itertools.accumulate(n for _, n in sorted(places)))
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 100
    rooms = []  # best fit, a piece at a time
    for length in sorted(counts.elements(), reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting)[1]] -= length
        else:
            rooms.append(100 - length)
    assert len(used) == len(rooms)
    with pytest.raises(ValueError):
        plan({101: 1}, 100)


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_shortages_go_to_siblings_before_ancestors():
    supply = {("a", "x", "1"): 10, ("a", "x", "2"): 500, ("a", "y", "1"): 500, ("b", "x", "1"): 500, ("b", "y", "1"): 5}
    got = budgets(supply, Weights(), 400, 1)
    assert sum(got.values()) >= 400 - len(supply)
    # The small leaf's rest stays within its language, the other domain keeps its half.
    assert got[("a", "x", "1")] == 10 and got[("a", "x", "2")] == 90 and got[("a", "y", "1")] == 100
    assert got[("b", "y", "1")] == 5 and got[("b", "x", "1")] == 195
    assert deal(100, [("p", 0, 50), ("q", 1, 30)]) == {"p": 0, "q": 30}
    assert budgets({("a", "x", "1"): 3}, Weights(), 100, 2) == {("a", "x", "1"): 6}


def test_mixture_of_odd_rows(session):
    docs = _docs(session)
    source = F.col("source")
    got = mix(docs, F.col("doc_id"), source, F.col("lang"), source, word_count(F.col("text")), Weights(), 80, 2).collect()
    tokens = {(r[0], r[1]): len(_words(r[1])) for r in ROWS}
    assert all(r.mix_tokens == tokens[(r.doc_id, r.text)] and 0 <= r.mix_epoch < 2 for r in got)
    total = sum(len(_words(r[1])) for r in ROWS)
    assert 0 < sum(r.mix_tokens for r in got) <= total * 80 // 100
    again = mix(docs, F.col("doc_id"), source, F.col("lang"), source, word_count(F.col("text")), Weights(), 80, 2).collect()
    assert Counter((r.doc_id, r.mix_epoch) for r in got) == Counter((r.doc_id, r.mix_epoch) for r in again)


# --- archives --------------------------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/\r\nX-Evil: 1", "y" * 1000), (2, None, "y" * 1000), (3, "http://c", "y" * 999), (4, "http://d", "y" * 999),
    (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 200), (7, "u", "WARC/1.1\r\n\r\n" * 200), (None, "n", "é" * 700),
    (8, "u", LONG * 5), (9, "u", "é" * 700),
]


def test_archives_give_back_odd_pages(session):
    import hashlib

    pages = session.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = archived_pages(pages.withColumn("record_type", F.lit("x")).withColumn("digest", F.lit("x")))
    want = Counter()
    for k, _, html in PAGES:
        body = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == body and p is not None]
        owner = max(same, default=None)
        revisit = len(body) >= 1000 and owner is not None and owner != k
        kind, refers = ("revisit", owner) if revisit else ("response", None)
        want[(k, len(body), hashlib.sha1(body).hexdigest(), kind, refers)] += 1
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.select(columns).collect())) == want


def test_archive_reader_cuts_files_and_pushes_predicates(session):
    path = scratch_path(session, "warc")
    rows = [(i, f"http://{i % 7}/{i}", f"{i} " * (20 + 40 * (i % 50))) for i in range(3000)]
    write_pages(session.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    session.dataSource.register(WarcSource)
    source = session.read.format("warc").option("header_columns", "X-Page-Id")
    cut = source.option("partition_bytes", "20000").load(path)
    assert cut.rdd.getNumPartitions() > 5
    responses = cut.where("record_type = 'response'")
    assert {int(r[0]): bytes(r[1]).decode() for r in responses.select("X-Page-Id", "payload").collect()} == {r[0]: r[2] for r in rows}
    some = cut.where("`X-Page-Id` IN ('5', '77') AND target_uri LIKE 'http://0%'").select("X-Page-Id", "payload")
    assert [r[0] for r in some.collect()] == ["77"]
    bare = source.option("payload", "false").load(path)
    assert bare.where("record_type = 'response' AND payload IS NULL").count() == len(rows)


@pytest.mark.parametrize("tells", [True, False])
def test_archive_reader_is_not_misled_by_archives_inside(session, tmp_path, tells):
    noise = np.random.default_rng(1)

    def entry(name, block):
        whole = record({"WARC-Type": "response", "WARC-Record-ID": name}, block)
        return member(whole) if tells else gzip.compress(whole)

    payloads = {}
    for i in range(3):  # records that cannot be compressed are stored as they are, with their own headers in sight
        inner = b"".join(entry(f"inner{i}-{j}", noise.bytes(9000)) for j in range(6))
        payloads[f"outer{i}"] = inner
    body = b"".join(entry(name, block) for name, block in payloads.items())
    (tmp_path / "a.warc.gz").write_bytes(body)
    session.dataSource.register(WarcSource)
    for size in (len(body), len(body) // 2, len(body) // 7, 5000):
        found = session.read.format("warc").option("partition_bytes", str(size)).load(str(tmp_path))
        assert {r.record_id: bytes(r.payload) for r in found.collect()} == payloads
        assert found.count() == 3


def test_archive_writer_replaces_files_only_when_it_is_done(session):
    path = scratch_path(session, "warc")
    session.dataSource.register(WarcSource)
    rows = session.range(5).selectExpr(
        "'response' AS record_type", "concat('r', id) AS record_id", "'u' AS target_uri", "'2024-01-01T00:00:00Z' AS date",
        "cast(null AS string) AS refers_to", "'sha1:x' AS digest", "cast('body' AS binary) AS payload", "id",
    )

    def read():
        return sorted(r[0] for r in session.read.format("warc").load(path).where("record_type = 'response'").select("record_id").collect())

    rows.drop("id").write.format("warc").mode("overwrite").save(path)
    failing = rows.withColumn("record_id", F.when(F.col("id") < 9, F.raise_error(F.lit("lost")).cast("string"))).drop("id")
    with pytest.raises(Exception, match="lost"):
        failing.write.format("warc").mode("overwrite").save(path)
    assert read() == [f"r{i}" for i in range(5)]
    rows.where("id = 2").drop("id").write.format("warc").mode("overwrite").save(path)
    assert read() == ["r2"]


def test_archive_reader_takes_other_writers_files(session, tmp_path):
    import gzip

    from millrace.llm.warc import record

    one = record({"WARC-Type": "response", "X-Page-Id": "1", "Content-Type": "text/plain"}, b"abc\r\n\r\nWARC/1.1\r\nWARC-Type: bad\r\n\r\n")
    two = record({"WARC-Type": "resource", "X-Page-Id": "2", "Content-Type": "text/plain"}, bytes(range(256)) * 2000)
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "_c.warc.gz").write_bytes(b"unfinished")
    session.dataSource.register(WarcSource)
    got = session.read.format("warc").option("header_columns", "X-Page-Id").load(f"file://{tmp_path}").collect()
    assert sorted((r.record_type, len(r.payload), r["X-Page-Id"]) for r in got) == [
        ("resource", 512_000, "2"), ("resource", 512_000, "2"), ("response", 35, "1"), ("response", 35, "1")]


# --- models ----------------------------------------------------------------------------------------------------------


def test_language_of_odd_rows(session):
    docs = _docs(session)
    model = language_id.train(docs, "text", "lang", ["doc_id"])
    got = docs.select("text", language_id.language_of(docs, F.col("text"), model).alias("f")).select("text", "f.*").collect()
    for r in got:
        lettered = bool(r.text and re.search(r"[^\W\d_]", r.text))
        assert (r.lang_pred == "und" and r.score == 0) == (not lettered) and 0 <= r.score <= 1
        if r.text and r.text.startswith(("the cat", "der hund")):
            assert r.lang_pred == ("en" if r.text[0] == "t" else "de")
    nobody = language_id.train(docs.where("lang IS NULL"), "text", "lang", ["doc_id"])
    blind = docs.select(language_id.language_of(docs, F.col("text"), nobody).alias("f")).select("f.*").distinct().collect()
    assert [tuple(r) for r in blind] == [("und", 0.0)]


def test_code_lengths_are_exact():
    """Every context's distribution adds up to one over all bytes."""
    grams, counts = np.unique(
        [int.from_bytes(b"   abracadabra"[i : i + 4], "big") for i in range(11)], return_counts=True
    )
    model = language_id.build(("x",), np.zeros(len(grams), np.int64), grams.astype(np.int64), counts.astype(float), 100)
    for context in (b"", b"a", b"abr", b"zzz", b"cad"):
        total = 0.0
        for byte in range(256):
            if 65 <= byte <= 90 or byte in (9, 10, 11, 12, 13):
                continue  # folded into other bytes
            text = np.frombuffer(context + bytes([byte]), np.uint8)
            both = model.code_lengths(text, np.array([0, len(text)])), model.code_lengths(text[:-1], np.array([0, len(context)]))
            total += 2.0 ** -(both[0][0, 0] - both[1][0, 0])
        assert 0.85 < total <= 1.0001


def test_quality_of_odd_rows_and_brute_force(session):
    docs = _docs(session)
    labels = session.createDataFrame([(1, 1), (2, 1), (4, 0), (8, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, "doc_id", "text", "quality", neighbours=3)
    assert len(model.labels) == 6  # one for each pair of rows
    got = docs.select("text", quality.quality_score(docs, F.col("text"), model).alias("s")).collect()
    for r in got:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        z = model.project(quality.histograms(data, np.array([0, len(data)])))[0]
        cosine = model.vectors @ z
        nearest = np.argsort(-cosine, kind="stable")[:3]
        weight = np.maximum(cosine[nearest], 0)
        want = (weight * model.labels[nearest]).sum() / weight.sum() if weight.sum() > 0 else model.labels.mean()
        assert abs(r.s - want) < 1e-3 or len(set(np.round(np.sort(-cosine)[2:4], 5))) == 1
    nobody = quality.train(docs, labels.limit(0), "doc_id", "text", "quality")
    assert {r[0] for r in docs.select(quality.quality_score(docs, F.col("text"), nobody)).collect()} == {0.5}


# --- empty tables and the pipeline -----------------------------------------------------------------------------------


def test_empty_tables(session):
    import public_tokenizers

    docs, vectors = _docs(session, []), _vectors(session, [])
    pages = session.createDataFrame([], "page_id long, url string, html string")
    pieces = tokenize(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 1, 4096)
    source = F.col("source")
    for got in (
        near_duplicates(docs, "doc_id", "text"),
        near_vectors(vectors, "vec_id", "embedding"),
        top_products(vectors, "vec_id", "embedding", F.lit(True)),
        archived_pages(pages),
        pack(pieces, 4096, ["doc_id", "piece"]),
        mix(docs, F.col("doc_id"), source, F.col("lang"), source, word_count(F.col("text")), Weights(), 80),
        shard(docs, 4, text_key(F.col("text")), F.col("doc_id"), F.lit(1)),
        docs.select(token_count(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))),
    ):
        assert got.count() == 0


@pytest.fixture()
def small(session, tmp_path):
    def write(rows, labels):
        _docs(session, rows).write.parquet(f"{tmp_path}/documents.parquet")
        session.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_pipeline_on_odd_rows(session, small):
    sf_dir = small(ROWS, [(1, 1, 0), (4, 1, 0), (8, 1, None), (None, None, None)])
    docs = session.read.parquet(f"{sf_dir}/documents.parquet")
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(session, docs, sf_dir)
        assert got.columns == docs.columns, name
        after = Counter((r.doc_id, r.text) for r in got.collect())
        assert after <= before, name
        docs, before = got, after
    assert corpus_pipeline.run(session, sf_dir).count() >= 1


def test_pipeline_keeps_one_row_of_each_group_where_ids_repeat(session, small):
    first, second, other = EN * 3, DE * 3, "none of these words is found in any other row of the table"
    rows = [(1, first), (2, first), (2, other), (3, second), (3, second), (4, None), (4, None), (None, first), (2, second)]
    sf_dir = small([(*r, "en", "src0") for r in rows], [])
    docs = session.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.without_near_duplicates(session, docs, sf_dir).collect()
    want = [(1, first), (2, other), (2, second), (4, None), (4, None), (None, first)]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_pipeline_on_empty_tables(session, small):
    assert corpus_pipeline.run(session, small([], [])).count() == 0


def test_pipeline_stages_by_brute_force(session, sf_dir):
    """What each stage keeps of the driver's documents, from its own input."""
    docs = session.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.without_near_duplicates(session, docs, sf_dir).collect()
    rows = docs.collect()
    sets = {r.doc_id: _shingles(r.text, 5) for r in rows}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = _components(sets, near)
    assert {r.doc_id for r in kept} == {k for k in sets if root[k] == k}
    good = {r.doc_id for r in corpus_pipeline.good_quality(session, docs, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in session.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(k in good for k, q in labels.items() if q == 1) >= 0.95 * sum(q == 1 for q in labels.values())
    known = {r.doc_id for r in corpus_pipeline.known_language(session, docs, sf_dir).collect()}
    assert len(known) >= 0.98 * len(rows)
    mixed = corpus_pipeline.mixed(session, docs, sf_dir).collect()
    words = lambda found: sum(len(_words(r.text)) for r in found)
    assert len({r.doc_id for r in mixed}) == len(mixed) and 0.7 * words(rows) <= words(mixed) <= 0.8 * words(rows)
