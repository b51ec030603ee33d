"""Test phrases found in training texts by an FM-index of every shard of texts.

A shard is one Arrow batch.  Its words become numbers of the phrases' vocabulary; words that no phrase holds, and runs
of words shorter than the shortest phrase, cannot take part in an occurrence and shrink to one separator.  The index
of what is left is its Burrows-Wheeler transform in a wavelet matrix, with every eighth text position kept.  All
phrases are searched backwards at once, a step per word from their last; occurrences are located by walking to the
next kept position, and overlapping ones merge into spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, held_by_worker
from millrace.llm.words import word_array
from millrace.session import materialize, with_row_tag

BLOCK_BYTES = 4 << 20
"""Text of test items that tasks hold at a time; more is searched in blocks."""

FOUND = "struct<n_words: bigint, spans: array<struct<begin: bigint, end: bigint>>, items: array<string>>"
_SAMPLED = 8
# Words are longest runs of digits, letters and all bytes of other characters.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class WaveletMatrix:
    """Symbols below ``size`` with access and rank for many places at once."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for bit in reversed(range(max(1, int(size - 1).bit_length()))):
            zero = (symbols >> bit) & 1 == 0
            before = np.zeros(len(symbols) + 1, np.int32 if len(symbols) < 1 << 31 else np.int64)
            np.cumsum(zero, out=before[1:])
            self.levels.append((bit, before))
            symbols = np.concatenate([symbols[zero], symbols[~zero]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        start, end = np.zeros(len(ends), np.int64), ends
        for bit, before in self.levels:
            one, zeros = (symbols >> bit) & 1 == 1, int(before[-1])
            start = np.where(one, zeros + start - before[start], before[start])
            end = np.where(one, zeros + end - before[end], before[end])
        return end - start

    def access(self, places: np.ndarray) -> np.ndarray:
        symbols, at = np.zeros(len(places), np.int64), places
        for bit, before in self.levels:
            one, zeros = before[at + 1] == before[at], int(before[-1])
            symbols |= one.astype(np.int64) << bit
            at = np.where(one, zeros + at - before[at], before[at])
        return symbols


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling the compared length until all differ."""
    rank, length, n = symbols.astype(np.int64), 1, len(symbols)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - length)] = rank[length:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        if int(rank[order[-1]]) == n - 1:
            return order
        length *= 2


class FMIndex:
    """Symbols from 1 on, which this class ends with a 0."""

    def __init__(self, symbols: np.ndarray, size: int):
        symbols = np.concatenate([symbols, [0]])
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.tree = WaveletMatrix(last, size)
        self.kept = order % _SAMPLED == 0
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.samples = order[self.kept]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of the suffixes that begin with each phrase (a row of symbols)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.kept), np.int64)
        alive = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            symbols = phrases[alive, k]
            both = self.tree.rank(np.tile(symbols, 2), np.concatenate([low[alive], high[alive]]))
            low[alive] = self.less[symbols] + both[: len(alive)]
            high[alive] = self.less[symbols] + both[len(alive) :]
            gone = low[alive] >= high[alive]
            low[alive[gone]] = high[alive[gone]] = 0
            alive = alive[~gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        found, steps = np.zeros(len(rows), np.int64), 0
        open_rows = np.arange(len(rows))
        while len(open_rows):
            here = self.kept[rows]
            found[open_rows[here]] = self.samples[self.kept_before[rows[here]]] + steps
            open_rows, rows = open_rows[~here], rows[~here]
            symbols = self.tree.access(rows)
            rows = self.less[symbols] + self.tree.rank(symbols, rows)
            steps += 1
        return found


@dataclass(frozen=True)
class Phrases:
    """Distinct windows of items, by length, and the items of each."""

    vocabulary: pa.Array
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per length: symbols, bounds into items, items
    names: np.ndarray

    @classmethod
    def of(cls, items: Sequence[tuple[str | None, str | None]], size: int) -> Phrases:
        names, item = np.unique(np.array([i or "" for i, _ in items], dtype=object).astype(str), return_inverse=True)
        found, _, _, bounds = word_array(pa.array([t for _, t in items], pa.large_string()), _WORD)
        coded = found.dictionary_encode()
        symbols = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
        lengths = np.diff(bounds)
        windows = []
        for length in np.unique(np.minimum(lengths[lengths > 0], size)).tolist():
            counts = np.where(lengths >= size, lengths - size + 1, 0) if length == size else (lengths == length).astype(np.int64)
            owner = np.repeat(np.arange(len(items)), counts)
            first = bounds[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            distinct, at = np.unique(symbols[first[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([at.reshape(-1), item[owner]], 1), axis=0)
            windows.append((distinct, np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1]))
        return cls(coded.dictionary, windows, names)

    def search(self, texts: pa.Array) -> pa.Array:
        """Words, merged spans of words inside occurrences, and item names of every text."""
        found, _, _, bounds = word_array(texts, _WORD)
        words = np.diff(bounds)
        hits, pairs = self._occurrences(found, bounds)
        owner, begin, end = _runs(hits, bounds)
        return _result(words, (owner, begin - bounds[owner], end - bounds[owner]), pairs, self.names)

    def _occurrences(self, found: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hit, and (text, item) pairs."""
        hits, none = np.zeros(len(found), bool), np.empty((0, 2), np.int64)
        if not self.windows or not len(found):
            return hits, none
        codes = pc.fill_null(pc.index_in(found, self.vocabulary), -1).to_numpy(zero_copy_only=False)
        owner, begin, end = _runs(codes >= 0, bounds)
        long = end - begin >= self.windows[0][0].shape[1]
        owner, begin, end = owner[long], begin[long], end[long]
        if not len(begin):
            return hits, none
        # Every run of known words, then the separator 1.
        lengths = end - begin + 1
        place = np.arange(int(lengths.sum())) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
        last = np.cumsum(lengths) - 1
        symbols = codes[np.minimum(place, len(codes) - 1)].astype(np.int64) + 2
        symbols[last] = 1
        index = FMIndex(symbols, len(self.vocabulary) + 2)
        present = np.zeros(len(self.vocabulary) + 2, bool)
        present[symbols] = True
        change, pairs = np.zeros(len(found) + 1, np.int64), [none]
        for windows, item_bounds, items in self.windows:
            some = np.flatnonzero(present[windows].all(axis=1))
            low, high = index.ranges(windows[some])
            counts = high - low
            window = np.repeat(some, counts)
            rows = np.arange(len(window)) + np.repeat(low - (np.cumsum(counts) - counts), counts)
            at = place[index.locate(rows)]
            np.add.at(change, at, 1)
            np.add.at(change, at + windows.shape[1], -1)
            text = np.searchsorted(bounds, at, side="right") - 1
            seen = np.unique(np.stack([text, window], 1), axis=0)
            many = np.diff(item_bounds)[seen[:, 1]]
            which = np.arange(int(many.sum())) + np.repeat(item_bounds[seen[:, 1]] - (np.cumsum(many) - many), many)
            pairs.append(np.stack([np.repeat(seen[:, 0], many), items[which]], 1))
        return np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _runs(held: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the longest runs of true values within one text."""
    if not held.any():
        return (np.empty(0, np.int64),) * 3
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    begin = bounds[:-1][bounds[:-1] < len(held)]
    first[begin] = held[begin]
    last[begin[begin > 0] - 1] = held[begin[begin > 0] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(bounds, begin, side="right") - 1, begin, end


def _result(words: np.ndarray, spans: tuple[np.ndarray, ...], pairs: np.ndarray, names: np.ndarray) -> pa.Array:
    owner, begin, end = spans
    rows = np.arange(len(words) + 1)
    parts = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["begin", "end"])
    span_lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, rows), pa.int32()), parts)
    values = pa.array(names[pairs[:, 1]].tolist(), pa.string())
    item_lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], rows), pa.int32()), values)
    return pa.StructArray.from_arrays([pa.array(words, pa.int64()), span_lists, item_lists], ["n_words", "spans", "items"])


def _searched(text: Column, items: object, size: int) -> Column:
    """``FOUND`` of a text for items of one block (a broadcast list of names and texts)."""
    key = uuid.uuid4().hex

    def search(texts: pa.Array) -> pa.Array:
        phrases = held_by_worker(("phrases", key, size), lambda: Phrases.of(items.value, size))
        return phrases.search(texts)

    return F.arrow_udf(search, FOUND)(text)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Distinct items in lists of about ``block_bytes`` of text; a longer item stands alone or with few others."""
    items = items.where(F.col("text").isNotNull()).distinct()
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-held // block_bytes)
    if blocks > 1:
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks))))
    for k in range(blocks):
        rows = items.where(F.col("block") == k) if blocks > 1 else items
        yield [(r["name"], r["text"]) for r in rows.select("name", "text").collect()]


def find_phrases(
    docs: DataFrame,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    window_words: int,
    name: str = "found",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``name``: ``n_words``, ``spans`` of words inside occurrences, and ``items`` that occur.

    A phrase is ``window_words`` words of an item in a row; an item of fewer words is one phrase, one without words
    none.  Words are runs of ASCII letters (case ignored), digits and non-ASCII characters.  Spans are merged,
    ascending, counted in words, ends excluded; items are distinct ids as text, an id that is NULL as the empty text.
    NULL and empty texts have no words.  All items are searched, however many: blocks of ``block_bytes`` are shipped
    one after another.
    """
    session, column = docs.sparkSession, F.col(f"`{text}`")
    named = items.select(F.col(f"`{item_id}`").cast("string").alias("name"), F.col(f"`{item_text}`").alias("text"))
    blocks = _blocks(named, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.withColumn(name, _searched(column, session.sparkContext.broadcast(first), window_words))
    tag = fresh(docs, "__row")
    tagged = materialize(with_row_tag(docs, tag))
    parts = []
    for block in chain([first, second], blocks):
        shipped = session.sparkContext.broadcast(block)
        parts.append(materialize(tagged.select(tag, _searched(column, shipped, window_words).alias("f"))))
        shipped.destroy()
    merged = reduce(DataFrame.unionByName, parts).groupBy(tag).agg(
        F.max("f.n_words").alias("n_words"),
        F.flatten(F.collect_list("f.spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("f.items"))).alias("items"),
    )
    found = merged.select(tag, F.struct("n_words", merge_spans(F.col("spans")).alias("spans"), "items").cast(FOUND).alias(name))
    return tagged.join(found, tag).select(*[f"`{c}`" for c in docs.columns], name)


def merge_spans(spans: Column) -> Column:
    """Spans in any order as ascending ones that neither overlap nor touch."""

    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(last["end"] >= span["begin"], F.concat(shorter, F.array(grown))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
