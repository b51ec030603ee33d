"""Every query of the package: against its SQL, or against the library or a brute-force version of its own."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.queries import ORACLES, QUERIES


def _comparable(records, names, wanted):
    at = [names.index(n) for n in wanted]
    return sorted((tuple(r[i] for i in at) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(session, sf_dir, duck, name):
    got = QUERIES[name](session, sf_dir)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    assert _comparable(got.collect(), got.columns, sorted(names)) == _comparable(result.fetchall(), names, sorted(names))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) - set(ORACLES) == {
        "op3_best_fit_packing", "op4_language_id", "op8_quality_votes", "op9_token_counts",
    }


def _texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_token_counts_are_the_librarys(session, sf_dir, duck):
    texts = _texts(duck)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op9_token_counts"](session, sf_dir).collect():
        text = texts.pop(r.doc_id) or ""
        tokens = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), tokens, tokens > 512)
    assert not texts


def test_packing_holds_the_librarys_ids_gapless(session, sf_dir, duck):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in _texts(duck).items()}
    rows = QUERIES["op3_best_fit_packing"](session, sf_dir).collect()
    sequences = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length <= 4096
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.02 * -(-sum(map(len, ids.values())) // 4096) + 1


def test_language_of_held_out_texts(session, sf_dir, duck):
    truth = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op4_language_id"](session, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)


def test_quality_of_held_out_texts(session, sf_dir, duck):
    truth = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = QUERIES["op8_quality_votes"](session, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.85 * len(unseen)
