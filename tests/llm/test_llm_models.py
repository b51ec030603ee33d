"""Models and tiles against plain versions: PPM code lengths, and vectors of many components."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, inner_products, language_id
from millrace.llm.vectors import block_rows

_DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


class PlainPpm:
    """Prediction by partial matching by dictionaries, byte by byte, a whole distribution per context."""

    def __init__(self, texts):
        self.counts, self.known = defaultdict(Counter), {}
        for text in texts:
            padded = b"   " + text
            for i in range(3, len(padded)):
                for order in range(4):
                    self.counts[padded[i - order : i]][padded[i]] += 1

    def distribution(self, context):
        if context not in self.known:
            shorter = self.distribution(context[1:]) if context else [1 / 256] * 256
            seen = self.counts.get(context)
            if seen:
                all_, kinds = sum(seen.values()), len(seen)
                rest = sum(p for b, p in enumerate(shorter) if b not in seen)
                shorter = [
                    seen[b] / (all_ + kinds) if b in seen else kinds / (all_ + kinds) * p / rest for b, p in enumerate(shorter)
                ]
            self.known[context] = shorter
        return self.known[context]

    def bits(self, text):
        padded = b"   " + text
        return -sum(np.log2(self.distribution(padded[i - 3 : i])[padded[i]]) for i in range(3, len(padded)))


def _folded(text):
    return bytes(language_id._FOLD[np.frombuffer(text.encode(), np.uint8)])


def _grams(texts, language):
    found = Counter()
    for text in texts:
        padded = b"   " + text
        found.update(int.from_bytes(padded[i - 3 : i + 1], "big") for i in range(3, len(padded)))
    return [(language, g, n) for g, n in found.items()]


@pytest.fixture(scope="module")
def learned():
    rows = duckdb.sql(f"SELECT lang, text FROM '{_DOCUMENTS}' WHERE lang IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    texts = defaultdict(list)
    for lang, text in rows:
        texts[lang].append(text)
    names = tuple(sorted(texts))
    halves = {n: (texts[n][::2][:12], texts[n][1::2][:3]) for n in names}
    grams = [g for i, n in enumerate(names) for g in _grams([_folded(t) for t in halves[n][0]], i)]
    of, gram, count = (np.array(c) for c in zip(*sorted(grams), strict=True))
    return names, halves, (of, gram, count.astype(float))


def test_code_lengths_equal_a_plain_coder(learned):
    names, halves, counted = learned
    assert len(names) >= 4
    model = language_id.build(names, *counted, 1 << 22)
    asked = [t[:1500] for n in names for t in halves[n][1]] + ["Z", "", "a\tB§ 中文 q\x00", "zzzz" * 20]
    data = [t.encode() for t in asked]
    offsets = np.r_[0, np.cumsum([len(d) for d in data])]
    got = model.code_lengths(np.frombuffer(b"".join(data), np.uint8), offsets)
    for i, name in enumerate(names):
        plain = PlainPpm([_folded(t) for t in halves[name][0]])
        wanted = [plain.bits(_folded(t)) for t in asked]
        np.testing.assert_allclose(got[:, i], wanted, rtol=1e-5, atol=1e-4)
    best, score = model.predict(pa.array(asked))
    assert (best == got.argmin(axis=1)).all() and ((score > 0) & (score <= 1)).all()


@pytest.mark.parametrize("max_states", [1, 40, 1000, 1 << 22])
def test_every_distribution_sums_to_one(learned, max_states):
    names, _, counted = learned
    model = language_id.build(names, *counted, max_states)
    weight = np.ones(model.width)
    weight[0] = 256 - (model.width - 1)  # all bytes that no text held, those that are folded away among them
    for bits in model.bits:
        totals = np.exp2(-bits.astype(float)).reshape(-1, model.width) @ weight
        assert np.abs(totals - 1).max() < 1e-4


def _wide(session, parts=3):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 2048))
    near = base[:20] + rng.normal(size=(20, 2048)) * np.linspace(0.3, 0.6, 20)[:, None]
    vectors = np.r_[base, near, base[:3]]
    frame = session.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<double>")
    return vectors, frame.repartition(parts)


def test_near_vectors_of_2048_components(session):
    vectors, frame = _wide(session)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    root = np.arange(len(vectors))
    for _ in range(10):
        root = np.array([min([root[i], *root[linked[i]]]) for i in range(len(root))])
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(frame, "vec_id", "v").collect()}
    assert [got[i].n_links for i in range(len(vectors))] == linked.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(vectors))] == root.tolist()
    assert 0 < linked.sum() < 60


def test_top_products_of_2048_components(session):
    vectors, frame = _wide(session)
    whole = np.floor(vectors * 256).astype(np.int64)
    got = inner_products.top_products(frame, "vec_id", "v", F.col("vec_id") % 10 == 0).collect()
    wanted = []
    for q in range(0, len(vectors), 10):
        scores = sorted((-int(whole[q] @ whole[c]), c) for c in range(len(vectors)) if c != q)[:5]
        wanted += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores)]
    assert sorted(map(tuple, got)) == wanted


def test_blocks_are_bounded_by_bytes():
    assert block_rows(32_768, 64) == 32_768
    assert block_rows(32_768, 2048) * 2048 * 8 <= 32 << 20
    assert block_rows(32_768, 1 << 30) == 1
