"""Collocations, Merkle manifests and test phrases against plain Python, on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import manifest, phrases
from millrace.llm.decontamination import FMIndex, Phrases, WaveletMatrix, find_phrases, hit_words, merge_spans, suffix_array
from millrace.llm.manifest import checked_manifest, folded, leaf_hash, lower_ascii, merkle_paths
from millrace.llm.phrases import collocations


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- collocations ----------------------------------------------------------------------------------------------------


def _collocations(rows, least, top, percent, longest=3):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", _lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        mine = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = (q for q, b in f.items() if len(q) > len(p) and b >= least and 100 * b >= percent * a)
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            mine.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        mine.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, r, total[lang], s) for i, (s, a, p, left, r) in enumerate(mine[:top])]
    return sorted(out)


def _prose(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "A", "new", "york", "city", "ñu", "\x00", "x y", "日本", "rare%d"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\v", "; ", "!", "?"]
    return "".join((w % rng.randrange(40) if "%" in w else w) + rng.choice(marks) for w in rng.choices(words, k=n))


@pytest.mark.parametrize("small", [False, True])
def test_collocations_of_odd_rows(session, monkeypatch, small):
    if small:  # most words without a rank, counts over many chunks
        monkeypatch.setattr(phrases, "_CHUNK_WORDS", 50)
        monkeypatch.setattr(phrases, "_RANKED", 3)
    rows = [(_prose(i, 60), ["en", "de", None, "und"][i % 4]) for i in range(30)]
    rows += [("x y z " * 30, "fr"), ("x y z " * 30, "fr"), (None, "en"), ("", None), ("  \t.", "en"), ("lone", "it")]
    rows += [("w " * 300, "hot")]
    docs = session.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("g", "w1", "c", "rank", "n")})
    for least, top, percent, longest in ((5, 2000, 50, 3), (2, 7, 80, 3), (5, 100, 50, 2)):
        got = collocations(docs.repartition(5), "text", "lang", longest, least, top, percent)
        assert sorted(map(tuple, got.collect())) == _collocations(rows, least, top, percent, longest)


def test_collocations_of_nothing(session):
    empty = session.createDataFrame([], "text string, lang string")
    assert collocations(empty, "text", "lang").collect() == []
    assert collocations(session.createDataFrame([(None, None)], "text string, lang string"), "text", "lang").collect() == []


# --- manifest --------------------------------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _record(*values):
    texts = [None if v is None else str(v) for v in values]
    return _h(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def _up(level):
    while len(level) > 1:
        level = [_h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0]


def _siblings(level, at):
    out = []
    while len(level) > 1:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        level = [_h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at //= 8
    return out


def _manifest(rows):
    """rows: (key, lang, text); Counter of the result."""
    by_lang = defaultdict(list)
    for key, lang, text in rows:
        by_lang[lang].append((key is not None, key or 0, _record(key, lang, text), text))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {x: [r[2] for r in sorted(by_lang[x])] for x in langs}
    subroots = [_up(leaves[x]) for x in langs]
    root, out = _up(subroots) if subroots else None, Counter()
    for i, lang in enumerate(langs):
        for at, (known, key, leaf, text) in enumerate(sorted(by_lang[lang])):
            path = _siblings(leaves[lang], at) + _siblings(subroots, i)
            now = leaf
            if known and zlib.crc32(str(key).encode()) % 3 == 0:
                now = _record(key, lang, None if text is None else _lower(text))
            for before, behind in path:
                now = _h(before, now, behind)
            proof = _h(*[x for pair in path for x in pair])
            out[key if known else None, leaf, subroots[i], root, proof, now, now == root] += 1
    return out


def _checked(session, rows, extra=()):
    docs = session.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({c: F.lit(0) for c in extra})
    where = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = {"text": lower_ascii(F.col("text"))}
    got = checked_manifest(docs.repartition(4), "lang", "doc_id", ["doc_id", "lang", "text"], changed, where)
    return Counter(map(tuple, got.collect()))


def test_manifest_of_odd_rows(session):
    ids = [0, 1, 63, 64, -1, -64, -65, 2**62, -(2**63), 2**63 - 1, 2**40, 2**20 * 64, 5, 6, 7, 8]
    rows = [(i, "en", f"Text {i}") for i in ids] + [(None, "en", "No id"), (None, "en", "No id"), (None, None, None)]
    rows += [(3, "de", "Same"), (3, "de", "Same"), (3, "de", "other"), (4, "", ""), (9, "ä", "Ä"), (9, "z", None), (9, "Z", "ONE")]
    assert _checked(session, rows, ("slot", "word", "leaf", "g", "size")) == _manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_manifest_heights(session, n):
    rows = [(i * 37 % 1000 - 200, "en" if i % 3 else None, f"T{i}") for i in range(n)]
    assert _checked(session, rows) == _manifest(rows)


def test_manifest_of_many_copies_and_groups(session, monkeypatch):
    monkeypatch.setattr(manifest, "_CHUNK", 7)
    monkeypatch.setattr(manifest, "_WINDOW_GROUPS", 3)
    rows = [(1, "en", "copy")] * 40 + [(1, "en", f"C{i}") for i in range(30)] + [(i, f"l{i}", "Q") for i in range(70)]
    assert _checked(session, rows) == _manifest(rows)


def test_manifest_of_nothing_and_a_changed_leaf(session):
    assert not _checked(session, session.createDataFrame([], "doc_id long, lang string, text string").collect())
    rows = session.range(20).select(F.lit("g").alias("group"), F.col("id").alias("key"), leaf_hash([F.col("id")]).alias("leaf"))
    found = merkle_paths(rows, "group", "key").select("root", folded(F.col("leaf"), F.col("path")).alias("a"),
                                                      folded(leaf_hash([F.col("key") + 1]), F.col("path")).alias("b"))
    assert all(r.a == r.root != r.b for r in found.collect())


# --- test phrases ----------------------------------------------------------------------------------------------------


def test_fm_index_against_search():
    rng = np.random.default_rng(3)
    for size, n in ((2, 40), (3, 300), (9, 500)):
        text = rng.integers(1, size, n)
        index = FMIndex(text, size)
        for length in (1, 2, 5):
            phrases_ = np.unique(rng.integers(1, size, (30, length)), axis=0)
            low, high = index.ranges(phrases_)
            for p, a, b in zip(phrases_, low, high, strict=True):
                want = [i for i in range(n - length + 1) if (text[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want
    tree = WaveletMatrix(text, 9)
    ends = rng.integers(0, len(text) + 1, 50)
    symbols = rng.integers(0, 9, 50)
    assert tree.rank(symbols, ends).tolist() == [int((text[:e] == s).sum()) for s, e in zip(symbols, ends, strict=True)]
    assert tree.access(np.arange(len(text))).tolist() == text.tolist()
    assert suffix_array(np.array([1, 1, 1, 0])).tolist() == [3, 2, 1, 0]


def _phrase_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))


def _brute(docs, items, size):
    windows = defaultdict(set)
    for name, text in items:
        w = _phrase_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add("" if name is None else str(name))
    out = []
    for key, text in docs:
        w, hit, seen = _phrase_words(text), set(), set()
        for length in {len(p) for p in windows}:
            for i in range(len(w) - length + 1):
                if tuple(w[i : i + length]) in windows:
                    hit |= set(range(i, i + length))
                    seen |= windows[tuple(w[i : i + length])]
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        spans = [(i, next(j for j in itertools.count(i) if j not in hit)) for i in starts]
        out.append((key, len(w), spans, sorted(seen)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4 << 20, 30])
def test_phrases_in_odd_rows(session, block):
    rng = random.Random(7)
    words = ["the", "The", "cat", "sat", "on", "ñu", "日本", "42", "mat", "dog"]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(12)]
    items += [(None, "cat cat cat"), (99, None), (98, "..."), (97, "mat"), (96, "never seen anywhere"), (5, items[5][1]), (5, "dog sat")]
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(words + ["other"], k=rng.randrange(60)))) for i in range(60)]
    docs += [(i, items[3][1].upper()) for i in range(5)] + [(None, None), (7, ""), (8, "cat " * 400), (8, "cat " * 400)]
    left = session.createDataFrame(docs, "k long, t string").withColumns({c: F.lit(1) for c in ("text", "items", "spans")})
    right = session.createDataFrame(items, "id long, t string")
    got = find_phrases(left.repartition(3), "t", right, "id", "t", 4, name="f", block_bytes=block)
    assert got.columns == [*left.columns, "f"]
    rows = got.select("k", "f.n_words", "f.spans", F.array_sort("f.items").alias("i"), hit_words(F.col("f.spans")).alias("n")).collect()
    assert sorted([(r.k, r.n_words, [tuple(s) for s in r.spans], r.i) for r in rows], key=repr) == _brute(docs, items, 4)
    assert all(r.n == sum(e - b for b, e in r.spans) for r in rows)


def test_phrases_without_rows(session):
    docs, items = session.createDataFrame([], "k long, t string"), session.createDataFrame([], "id long, t string")
    assert find_phrases(docs, "t", items, "id", "t", 3).collect() == []
    some = session.createDataFrame([(1, "a b c")], "k long, t string")
    assert [tuple(r.found) for r in find_phrases(some, "t", items, "id", "t", 3).collect()] == [(3, [], [])]
    spans = F.expr("array(named_struct('begin', 4L, 'end', 6L), named_struct('begin', 1L, 'end', 2L), named_struct('begin', 2L, 'end', 5L))")
    assert [tuple(s) for s in session.range(1).select(merge_spans(spans).alias("s")).first().s] == [(1, 6)]
    assert Phrases.of([], 3).search(pa.array(["x y", None])).to_pylist()[1] == {"n_words": 0, "spans": [], "items": []}
