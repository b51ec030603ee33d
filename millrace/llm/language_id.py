"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts (up to three bytes) with symbol counts from a sample of
labelled texts.  A symbol seen n times among N in a context with d distinct symbols has probability n / (N + d); the
escape d / (N + d) passes the rest to the next shorter context, from which the symbols already offered are excluded,
down to a uniform choice of bytes.  The counts are frozen after learning, so every context's whole distribution is
worked out once, and the code length of a text is a sum of table entries, exact for all of its bytes.

The prediction is the language with the shortest code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, share, slices, trim, utf8

UNDETERMINED = "und"
_SPACE = 32
_ORDER = 3


def _fold() -> np.ndarray:
    """Bytes as the model sees them: ASCII letters in lower case, ASCII white space alike."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[[9, 10, 11, 12, 13]] = _SPACE
    return fold


_FOLD = _fold()


def _context(symbols: np.ndarray, starts: np.ndarray, back: int, before: int) -> np.ndarray:
    """For every position the symbol ``back`` places earlier in its text; ``before`` where there is none."""
    out = np.empty_like(symbols)
    out[back:] = symbols[: len(symbols) - back]
    for k in range(back):
        at = starts + k
        out[at[at < len(out)]] = before
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Code lengths of all languages: ``bits[language][state * classes + class]``."""

    languages: tuple[str, ...]
    classes: np.ndarray  # of each byte; 0 for bytes that no tree holds
    states: np.ndarray  # of (third last, second last, last) class
    bits: np.ndarray

    @property
    def width(self) -> int:
        return round(len(self.states) ** (1 / _ORDER))

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        starts, lengths = offsets[:-1], np.diff(offsets)
        held = lengths > 0
        if not held.any() or not len(self.languages):
            return out
        starts = starts[held]
        symbols = self.classes[data].astype(np.int32)
        before, width = int(self.classes[_SPACE]), np.int32(self.width)
        at = _context(symbols, starts, 3, before)
        for back in (2, 1):
            at *= width
            at += _context(symbols, starts, back, before)
        at = self.states[at] * width
        at += symbols
        for i in range(len(self.languages)):
            out[held, i] = np.add.reduceat(self.bits[i].take(at), starts, dtype=np.float64)
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share 2**-bits among all languages, per text."""
        release()
        data, offsets = utf8(texts)
        parts = [
            self.code_lengths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)
        ]
        bits = np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))
        if not len(self.languages):
            return np.zeros(len(bits), np.int64), np.zeros(len(bits))
        best = bits.argmin(axis=1)
        gap = bits - bits.min(axis=1, keepdims=True)
        return best, 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)


def build(languages: tuple[str, ...], of: np.ndarray, grams: np.ndarray, counts: np.ndarray, max_states: int) -> LanguageModel:
    """A model from counts of 4-byte grams (three bytes of context, big-endian, and the symbol) per language.

    ``max_states`` contexts with the most symbols are kept; a kept context's suffixes are kept as well.
    """
    seen = np.unique(np.concatenate([(grams >> (8 * k)) & 255 for k in range(_ORDER + 1)] + [[_SPACE]]))
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    folded = classes[_FOLD]
    unseen = max(1, 256 - len(seen))
    digits = [classes[(grams >> (8 * k)) & 255] for k in range(_ORDER, -1, -1)]
    symbol = digits[-1]

    # Contexts of each order as base-`width` numbers of their last symbols, with their weight over all languages.
    keys, weights, orders = [np.zeros(1, np.int64)], [np.array([np.inf])], [np.zeros(1, np.int64)]
    for order in range(1, _ORDER + 1):
        key = np.zeros(len(grams), np.int64)
        for d in digits[_ORDER - order : _ORDER]:
            key = key * width + d
        found, where = np.unique(key, return_inverse=True)
        keys.append(found)
        weights.append(np.bincount(where, counts, len(found)))
        orders.append(np.full(len(found), order))
    key, weight, order = map(np.concatenate, (keys, weights, orders))
    chosen = np.lexsort((key, order, -weight))[:max_states]
    chosen = chosen[np.lexsort((key[chosen], order[chosen]))]
    key, order = key[chosen], order[chosen]

    # The state of every triple: the longest suffix that was kept.
    at = np.zeros(1, np.int32)
    level = []
    for o in range(1, _ORDER + 1):
        at = np.tile(at, width)
        mine = np.flatnonzero(order == o)
        parent = at[key[mine]].copy()
        level.append((mine, parent))
        at[key[mine]] = mine
    states = at.astype(np.int32)

    base = np.full(width, 1 / 256)
    bits = np.empty((len(languages), len(key) * width), np.float32)
    for i in range(len(languages)):
        rows = of == i
        table = np.zeros((len(key), width))
        for o in range(_ORDER + 1):
            mine = np.flatnonzero(order == o)
            code = np.zeros(int(rows.sum()), np.int64)
            for d in digits[_ORDER - o : _ORDER]:
                code = code * width + d[rows]
            place = np.searchsorted(key[mine], code)
            hit = place < len(mine)
            hit[hit] = key[mine][place[hit]] == code[hit]
            n = np.zeros((len(mine), width))
            np.add.at(n, (place[hit], symbol[rows][hit]), counts[rows][hit])
            shorter = base[None, :] if o == 0 else table[level[o - 1][1]]
            offered = n > 0
            total, distinct = n.sum(axis=1, keepdims=True), offered.sum(axis=1, keepdims=True)
            # The shorter context without the symbols offered here; class 0 stands for all bytes never seen.
            weight_of = np.r_[unseen, np.ones(width - 1)]
            rest = (shorter * ~offered * weight_of).sum(axis=1, keepdims=True)
            escaped = distinct / np.maximum(total + distinct, 1) * shorter / np.maximum(rest, 1e-300)
            known = n / np.maximum(total + distinct, 1)
            table[mine] = np.where(total > 0, np.where(offered, known, escaped), shorter)
        bits[i] = -np.log2(np.maximum(table, 1e-30)).ravel()
    return LanguageModel(languages, folded, states, bits)


def train(
    docs: DataFrame,
    text: str,
    language: str,
    row_key: list[str],
    docs_per_language: int = 3000,
    max_states: int = 6000,
    max_languages: int = 500,
    seed: int = 17,
) -> LanguageModel:
    """A model from about ``docs_per_language`` whole texts of each language.

    Rows with a NULL language or text teach nothing.  The sample is by a hash of ``row_key`` and the text, so it does
    not depend on the order of rows.  Without any labelled row the model knows no language.  ``docs_per_language``,
    ``max_states`` and ``max_languages`` bound what reaches the driver and the executors.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(
        F.col(language).cast("string").alias("l"), F.col(text).alias("t"), share(seed, *row_key, text).alias("u")
    )
    sizes = {r[0]: r[1] for r in labelled.groupBy("l").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return LanguageModel((), np.zeros(256, np.int64), np.zeros(1, np.int32), np.zeros((0, 1), np.float32))
    languages = tuple(sorted(sizes))
    index = {name: i for i, name in enumerate(languages)}
    rates = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, docs_per_language / sizes[name]))])
    sample = labelled.where(F.col("u") < rates[F.col("l")]).select("l", "t")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            of = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, b in slices(offsets):
                part, bounds = _FOLD[data[offsets[a] : offsets[b]]].astype(np.int64), offsets[a : b + 1] - offsets[a]
                starts = bounds[:-1][np.diff(bounds) > 0]
                code = np.repeat(of[a:b], np.diff(bounds))
                for back in (3, 2, 1):
                    code = code * 256 + _context(part, starts, back, _SPACE)
                found, n = np.unique(code * 256 + part, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["g", "n"])

    counted = sample.mapInArrow(grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    g, n = (counted.column(c).to_numpy() for c in ("g", "n"))
    in_order = np.argsort(g)
    g, n = g[in_order], n[in_order].astype(np.float64)
    del counted
    model = build(languages, g >> 32, g & 0xFFFFFFFF, n, max_states)
    del g, n
    trim()
    return model


def language_of(docs: DataFrame, text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score) of whole texts.

    ``lang_pred`` is ``und`` with score 0 where the text is NULL or has no letter, or the model knows no language.
    Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        names = np.array(shared.value.languages or (UNDETERMINED,), object)
        best, score = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = F.arrow_udf(predict, "lang_pred string, score double")(text)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\p{L}"), found).otherwise(nothing)
