"""Collocations from counts of the longest windows only.

Every word occurrence opens one window of ``longest`` words, padded where its piece ends.  Windows are counted once;
Spark's ROLLUP over their words then sums them to the counts of all shorter phrases, as every occurrence of a phrase
is the beginning of exactly one window.  Two exact reductions keep the rollup small: a word rarer than the least
count cannot be in a candidate, so it ends its window like a pad; and windows that are rarer than that give their
count to their first words before the rollup.

Windows hold numbers: the 2**20 most frequent words their rank, which tasks look up in a table of that size, other
frequent words their hash, which tasks know from a bit set of fixed size (a wrong bit only spares a rare word).
Hashes of different words are compared beforehand, and drawn anew should two be equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import slices, utf8
from millrace.llm.words import hashes_of, mix, word_array
from millrace.session import materialize

_CHUNK_WORDS = 3 << 20  # occurrences that a task counts together
_ROWS = 1 << 16
_RANKED = 1 << 20
_BITS = 26  # the bit set of frequent words without a rank: 8 MB
_HASHED = np.int64(-(1 << 63))
_SALTS = 256
_EXACT = "decimal(38,0)"
_SCALE = 1_000_000
# Pieces end at . , ; : ! ? and U+000A to U+000D; space and tab part words.
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_WORD = ~_CUT
_WORD[[9, 32]] = False


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    yield from slices(utf8(texts)[1])


def _hashes(words: pa.Array, seed: int) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    if not len(words):
        return np.empty(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]
    return mix(hashes_of(data, offsets[:-1], offsets[1:]) + np.uint64(seed))


@dataclass(frozen=True)
class _Numbers:
    """Numbers of words from their hashes: 1 ... for the most frequent, negative ones for other frequent words, else 0."""

    seed: int
    ranked: np.ndarray  # hashes in order
    ranks: np.ndarray
    bits: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.ranked, hashes), len(self.ranked) - 1)
        short = hashes >> np.uint64(64 - _BITS)
        other = (self.bits[short >> np.uint64(6)] >> (short & np.uint64(63))) & np.uint64(1) == 1
        numbers = np.where(other, hashes.view(np.int64) | _HASHED, 0)
        return np.where(self.ranked[place] == hashes, self.ranks[place], numbers) if len(self.ranked) else numbers


def _word_counts(texts: DataFrame, seed: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a, b in _slices(texts):
                coded = word_array(texts.slice(a, b - a), _WORD)[0].dictionary_encode()
                words = coded.dictionary
                counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(words))
                arrays = [pa.array(_hashes(words, seed).view(np.int64)), _strings(words), pa.array(counts, pa.int64())]
                yield from pa.table(arrays, names=["h", "word", "c"]).to_batches(max_chunksize=_ROWS)

    return texts.mapInArrow(count, "h long, word string, c long")


def _strings(words: pa.Array) -> pa.Array:
    return words.cast(options=pc.CastOptions(pa.large_string(), allow_invalid_utf8=True)).cast(pa.string())


def _vocabulary(texts: DataFrame, least: int) -> tuple[_Numbers, DataFrame]:
    """Numbers of all words that occur ``least`` times, and (id, word) of these."""
    seed = 0
    while True:
        # All rows of a hash meet, so equal hashes of different words show without another shuffle.
        counts = _word_counts(texts, seed).groupBy("h", "word").agg(F.sum("c").alias("c")).repartition("h")
        counts = counts.groupBy("h", "word").agg(F.sum("c").alias("c"))
        found = counts.groupBy("h").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("words"), F.min("word").alias("word"))
        found = materialize(found.where(F.col("c") >= least))
        if found.where(F.col("words") > 1).isEmpty():
            break
        seed += 1
    # Counts by eighths of a doubling: the ranked words are those above one such step.
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    steps = sorted(found.groupBy(step.alias("step")).count().collect(), reverse=True)
    total, lowest = 0, 1 << 30
    for row in steps:
        total += row["count"]
        if total > _RANKED:
            break
        lowest = row["step"]
    ranked = found.where(step >= lowest).select("h", "c").toArrow()
    hashes, counts = ranked["h"].to_numpy().view(np.uint64), ranked["c"].to_numpy()
    ranks = np.empty(len(hashes), np.int64)
    ranks[np.lexsort((hashes, -counts))] = np.arange(1, len(hashes) + 1)
    order = np.argsort(hashes)
    bit = F.shiftrightunsigned("h", 64 - _BITS)
    others = found.where(step < lowest).select(F.shiftright(bit, 6).alias("at"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    others = others.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    bits[others["at"].to_numpy()] = others["mask"].to_numpy()
    return _Numbers(seed, hashes[order], ranks[order], bits.view(np.uint64)), found.select("h", "word")


def _counted(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns``, whose values lie below ``sizes``, and how often each stands there."""
    bits = sum(int(n).bit_length() for n in sizes)
    if bits < 63:
        key = columns[0].astype(np.int64)
        for column, n in zip(columns[1:], sizes[1:], strict=True):
            key = key * n + column
        distinct, counts = np.unique(key, return_counts=True)
        found = []
        for n in reversed(sizes[1:]):
            distinct, last = np.divmod(distinct, n)
            found.append(last)
        return [distinct, *reversed(found)], counts
    order = np.lexsort(columns[::-1])
    sorted_columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in sorted_columns])
    first = np.flatnonzero(new)
    return [c[first] for c in sorted_columns], np.diff(np.append(first, len(order)))


def _windows(codes: np.ndarray, pieces: np.ndarray, longest: int) -> list[np.ndarray]:
    """The word at each place and those behind it, 0 from the first pad or 0 on."""
    columns = [codes]
    for k in range(1, longest):
        ahead = np.zeros_like(codes)
        if len(codes) > k:
            same = (pieces[k:] == pieces[:-k]) & (columns[-1][:-k] > 0)
            ahead[:-k] = np.where(same, codes[k:], 0)
        columns.append(ahead)
    return columns


class _Chunk:
    """Windows of some texts with the numbers of their words, counted when enough have come."""

    def __init__(self, numbers: _Numbers, longest: int):
        self.numbers, self.longest = numbers, longest
        self.parts: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        self.held = 0

    def add(self, groups: np.ndarray, texts: pa.Array) -> None:
        found, starts, data, bounds = word_array(texts, _WORD)
        if not len(found):
            return
        coded = found.dictionary_encode()
        ids = self.numbers.of(_hashes(coded.dictionary, self.numbers.seed))
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        pieces = np.cumsum(_CUT[data], dtype=np.int32 if len(data) < 1 << 31 else np.int64)[starts] + text
        # Numbered within the slice; 0 stays 0.
        local, place = np.unique(np.append(ids, 0), return_inverse=True)
        zero = int(place[-1])
        codes = place[:-1].astype(np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
        codes = np.where(codes == zero, 0, np.where(codes < zero, codes + 1, codes))
        local = np.concatenate([[0], np.delete(local, zero)])
        self.parts.append((groups[text], local, _windows(codes, pieces, self.longest)))
        self.held += len(codes)

    def counted(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        ids = np.unique(np.concatenate([[0], *[local for _, local, _ in self.parts]]))
        zero = int(np.searchsorted(ids, 0))
        ids[0], ids[zero] = ids[zero], ids[0]  # 0 first, so that it is number 0 here as well
        order = np.argsort(ids)
        columns: list[list[np.ndarray]] = [[] for _ in range(self.longest)]
        for _, local, windows in self.parts:
            number = order[np.searchsorted(ids, local, sorter=order)].astype(np.int32)
            for k, w in enumerate(windows):
                columns[k].append(number[w])
        groups, group = np.unique(np.concatenate([g for g, _, _ in self.parts]), return_inverse=True)
        self.parts, self.held = [], 0
        distinct, counts = _counted([group, *map(np.concatenate, columns)], [len(groups), *[len(ids)] * self.longest])
        arrays = [pa.array(groups[distinct[0]]), *[pa.array(ids[c]) for c in distinct[1:]], pa.array(counts, pa.int64())]
        table = pa.table(arrays, names=["g", *_names(self.longest), "c"])
        yield from table.to_batches(max_chunksize=_ROWS)


def _names(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def phrase_counts(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(g, w1 ... w<longest>, f) of all phrases that occur ``least`` times and of every group; and (id, word).

    ``texts``: g (long) and text.  Words are ids, NULL behind a phrase's last one; f of a group counts all its words.
    """
    numbers, vocabulary = _vocabulary(texts.select("text"), least)
    shipped = texts.sparkSession.sparkContext.broadcast(numbers)
    names = _names(longest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(shipped.value, longest)
        for batch in batches:
            groups, texts = batch.column(0).to_numpy(), batch.column(1)
            for a, b in _slices(texts):
                chunk.add(groups[a:b], texts.slice(a, b - a))
                if chunk.held >= _CHUNK_WORDS:
                    yield from chunk.counted()
        yield from chunk.counted()

    schema = ", ".join(["g long", *[f"{w} long" for w in names], "c long"])
    counts = texts.select("g", "text").mapInArrow(count, schema).repartition("g", *names[:-1])
    counts = counts.groupBy("g", *names).agg(F.sum("c").alias("c"))
    # What is rarer than a candidate goes to its first words; all rows of these lie in one partition.
    last, before = names[-1], names[:-1]
    counts = counts.withColumn(last, F.when(F.col("c") >= least, F.col(last)).otherwise(0))
    counts = counts.groupBy("g", *names).agg(F.sum("c").alias("c"))
    if len(names) > 2:
        total = F.sum("c").over(Window.partitionBy("g", *before))
        counts = counts.withColumn("t", total)
        counts = counts.withColumn(before[-1], F.when(F.col("t") >= least, F.col(before[-1])).otherwise(0))
    summed = counts.rollup("g", *names).agg(F.sum("c").alias("f"))
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.col(w) != 0, F.lit(True)) for w in names])
    groups = F.col(names[0]).isNull() & F.col("g").isNotNull()
    found = materialize(summed.where(whole & F.col("g").isNotNull() & (groups | (F.col("f") >= least))))

    def number(hashes: pa.Array) -> pa.Array:
        return pa.array(shipped.value.of(hashes.to_numpy().view(np.uint64)))

    named = materialize(vocabulary.select(F.arrow_udf(number, "long")("h").alias("id"), "word"))
    shipped.destroy()
    return found, named


def collocations(
    docs: DataFrame, text: str, lang: str, longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50
) -> DataFrame:
    """The first ``top`` phrases of 2 to ``longest`` words of each language by score, then count, then phrase.

    (lang, rank, phrase, a, l, r, n, score): a counts the phrase, l and r the parts at its lowest-scoring cut, n all
    words of the language; score = floor(1000000 a a / (l r)), ties of cuts to the shorter first part.  Phrases with
    a < ``least`` are no candidates; one whose words lie inside a longer candidate of ``inside_percent`` of its count
    is dropped.  A-Z are lower-cased; NULL texts are empty, a NULL language is ``und``.  All numbers are exact.
    """
    language = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    seed, known = 0, docs.select(language.alias("lang")).distinct()
    known = materialize(known)
    while not known.groupBy(F.xxhash64(F.lit(seed), "lang")).count().where(F.col("count") > 1).isEmpty():
        seed += 1
    texts = docs.select(F.xxhash64(F.lit(seed), language).alias("g"), F.col(f"`{text}`").alias("text"))
    names = _names(longest)
    counts, vocabulary = phrase_counts(texts, longest, least)
    languages = counts.where(F.col("w1").isNull()).select("g", F.col("f").alias("n"))
    languages = known.withColumn("g", F.xxhash64(F.lit(seed), "lang")).join(languages, "g")
    by_size = {}
    for k in range(1, longest + 1):
        mine = F.col(f"w{k}").isNotNull()
        if k < longest:
            mine &= F.col(f"w{k + 1}").isNull()
        by_size[k] = counts.where(mine).select("g", *names[:k], "f")
    candidates = None
    for size in range(2, longest + 1):
        rows = by_size[size].withColumnRenamed("f", "a")
        for k in range(1, size):
            rows = _joined(rows, by_size[k], names[:k], f"l{k}")
            rows = _joined(rows, by_size[size - k], names[k:size], f"r{k}")
        cuts = [
            F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
            for k in range(1, size)
        ]
        rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
        for longer in range(size + 1, longest + 1):
            rows = _outside(rows, by_size[longer], names, size, longer, inside_percent)
        for w in names[:size]:
            rows = rows.join(vocabulary.select(F.col("id").alias(w), F.col("word").alias(f"word_{w}")), w)
        phrase = F.concat_ws(" ", *[f"word_{w}" for w in names[:size]])
        rows = rows.select("g", phrase.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        candidates = rows if candidates is None else candidates.unionByName(rows)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # First among the rows of one salt, so that no task sorts all candidates of a language.
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = Window.partitionBy("g", "salt").orderBy(*order)
    few = salted.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("salt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= top).join(languages, "g")
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _joined(rows: DataFrame, counts: DataFrame, words: list[str], name: str) -> DataFrame:
    """``rows`` with the count of the phrase in their columns ``words``: a part of a candidate is counted as well."""
    keys = [F.col("g").alias("g_"), *[F.col(f"w{k + 1}").alias(f"p{k + 1}") for k in range(len(words))]]
    part = counts.select(*keys, F.col("f").alias(name))
    same = F.col("g") == F.col("g_")
    for k, w in enumerate(words):
        same &= F.col(w) == F.col(f"p{k + 1}")
    return rows.join(part, same).drop("g_", *[f"p{k + 1}" for k in range(len(words))])


def _score(a: Column, left: Column, right: Column) -> Column:
    square = a.cast(_EXACT) * a.cast(_EXACT)
    whole = (square.cast(_EXACT) * F.lit(_SCALE).cast(_EXACT)).cast(_EXACT)
    product = (left.cast(_EXACT) * right.cast(_EXACT)).cast(_EXACT)
    # div of decimals is exact and gives a long; the score is at most 1000000 as a <= l and a <= r
    return F.call_function("div", whole, product)


def _outside(rows: DataFrame, longer: DataFrame, names: list[str], size: int, length: int, percent: int) -> DataFrame:
    """``rows`` without phrases inside a phrase of ``length`` words that has ``percent`` of their count."""
    parts = [
        longer.select("g", *[F.col(names[at + k]).alias(names[k]) for k in range(size)], "f")
        for at in range(length - size + 1)
    ]
    most = reduce(DataFrame.unionByName, parts).groupBy("g", *names[:size]).agg(F.max("f").alias("most"))
    held = rows.join(most, ["g", *names[:size]], "left")
    inside = F.lit(100).cast(_EXACT) * F.col("most") >= F.lit(percent).cast(_EXACT) * F.col("a")
    return held.where(~F.coalesce(inside, F.lit(False))).drop("most")
