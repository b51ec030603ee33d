"""Best-fit packing planned on a histogram of lengths.

Only the counts of pieces per length reach the driver, at most ``capacity`` of them.  Best-fit decreasing runs over
those counts: a run of equal pieces goes into a run of equally full sequences in one step.  The plan is a small table
of (length, ranks, first sequence, offset); pieces take their slots by joining it on their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.common import fresh, held_by_worker, slices, utf8
from millrace.llm.words import spans
from millrace.session import local_table, materialize

_CACHED = 600_000
_LEARNED = 4_000  # words that the library encodes at a time
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANK_ROWS = 50_000  # pieces of one length that one group numbers


def _lowered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ASCII capitals in lower case where the library's ids stay the same.

    It composes (NFC) before it lower-cases, and some small letters have composed forms that their capitals lack: a
    capital before a byte of another character stays, one before ASCII takes no part in composing.  Special strings are
    told apart by case: words that hold the beginning of one stay.
    """
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 128
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # <|
    if len(special):
        cuts = np.union1d(np.flatnonzero(_BLANK[data]), offsets)
        stays = np.zeros(len(cuts) - 1, bool)
        stays[np.searchsorted(cuts, special, side="right") - 1] = True
        capital &= ~np.repeat(stays, np.diff(cuts))
    return data + (capital.astype(np.uint8) << 5)


class WordIds:
    """Token ids of texts for a vocabulary whose pre-tokens never span white space.

    The library encodes every distinct word once per worker; texts are put together from the ids of their words.
    Where the vocabulary ignores the case of ASCII letters and parts them from a comma or full stop, so do the words.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = ["a b", "a", "b", "Ab", "ab", "Q.", "q", ".", "q,", ","]
        x = [e.ids for e in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]
        if x[0] != x[1] + x[2]:
            raise ValueError(f"{path} keeps white space in its tokens")
        self.caseless = x[3] == x[4]
        self.parts_marks = x[5] == x[6] + x[7] and x[8] == x[6] + x[9]
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), _LEARNED):
            texts = [w.decode() for w in words[k : k + _LEARNED]]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ends = self.starts[-1] + np.cumsum([len(x) for x in ids])
            if ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), int(ends[-1])), np.uint32)])
            self.ids[self.starts[-1] : ends[-1]] = list(chain.from_iterable(ids))
            self.starts = np.concatenate([self.starts, ends])

    def _simplified(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same tokens in fewer distinct words: lower case, and a blank before a mark that ends a word."""
        if self.caseless:
            data = _lowered(data, offsets)
        if self.parts_marks and len(data) > 1:
            mark = (data == 44) | (data == 46)
            mark[1:] &= _LETTER[data[:-1]]
            mark[:-1] &= _BLANK[data[1:]]
            mark[0] = False
            last = offsets[1:][(offsets[1:] > 1)] - 1
            mark[last] = ((data[last] == 44) | (data[last] == 46)) & _LETTER[data[last - 1]]
            begin = offsets[:-1][offsets[:-1] < len(data)]
            mark[begin] = False
            at = np.flatnonzero(mark)
            data = np.insert(data, at, 32)
            offsets = offsets + np.searchsorted(at, offsets)
        return data, offsets

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and len+1 offsets into them."""
        data, offsets = self._simplified(data, offsets)
        held = ~_BLANK[data]  # no multi-byte character holds an ASCII white space
        starts, ends = spans(held, offsets) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        buffers = [None, pa.py_buffer(at), pa.py_buffer(data[held])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        codes = self._codes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        begins, sizes = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)
        return self.ids[at], np.r_[0, ends][np.searchsorted(starts, offsets)]

    def _codes(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words; new ones are learned."""
        if len(self.codes) > _CACHED:
            self._clear()
        new = [w for w in words if w not in self.codes]
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        if new:
            self._learn(new)
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))


def tokenize(
    docs: DataFrame, id_column: str, text_column: str, vocabulary: str, end: int, capacity: int, keep_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: the id column, piece, start, length, ids_crc32 (and ids: array<int>).

    A document is its ids and then ``end``; NULL and empty texts are ``end`` alone.  Only documents longer than
    ``capacity`` are cut, into pieces of ``capacity`` and a rest.  Repeated rows give repeated pieces.
    """
    source = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    kinds = "__id {}, piece int, start long, length long, ids_crc32 long".format(source.schema["__id"].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held_by_worker(("words", vocabulary), lambda: WordIds(vocabulary))
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last in slices(offsets):
                ids, bounds = words.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                whole = np.insert(ids, bounds[1:], np.uint32(end)).astype("<u4", copy=False)
                bounds = bounds + np.arange(len(bounds))
                sizes = np.diff(bounds)
                counts = -(-sizes // capacity)
                rows = np.repeat(np.arange(last - first), counts)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[rows] - start)
                begin = bounds[rows] + start
                spans_of = list(zip(begin.tolist(), (begin + length).tolist(), strict=True))
                body = memoryview(whole).cast("B")
                columns = [
                    pc.take(batch.column(0), pa.array(first + rows)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(body[4 * i : 4 * j]) for i, j in spans_of], pa.int64()),
                ]
                names = ["__id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([whole[i:j].astype(np.int32) for i, j in spans_of], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(cut, kinds + (", ids array<int>" if keep_ids else "")).withColumnRenamed("__id", id_column)


PLAN = "length long, low long, high long, first long, offset long, each long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: rows of ``PLAN``.

    Ranks low..high-1 of a length go to sequences first, first+1, ...; ``each`` behind one another in each sequence,
    beginning at ``offset``.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    # Sequences with the same room: room -> [(first sequence, how many)].
    by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    sequences = 0

    def put(room: int, group: tuple[int, int]) -> None:
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(group)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        low, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                room, first, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            # A sequence just used has the least room, so best fit goes on with it while it can.
            each = min(room // length, left)
            used = min(many, left // each)
            if used < many:
                put(room, (first + used, many - used))
            rows.append((length, low, low + used * each, first, capacity - room, each))
            low, left = low + used * each, left - used * each
            put(room - each * length, (first, used))
    return rows


def pack(pieces: DataFrame, capacity: int, order: Sequence[str]) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    ``order`` names the columns that rank pieces of equal length, NULLs first; rows equal in all of them take the
    slots of their length in any order.  An empty table stays empty; columns of the two new names are replaced.
    """
    spark = pieces.sparkSession
    stored = materialize(pieces.drop("sequence_id", "offset"))
    counts = {r[0]: r[1] for r in stored.groupBy("length").count().collect()}
    planned = local_table(spark, plan(counts, capacity), PLAN)
    salt, ranked, before = (fresh(stored, n) for n in ("__salt", "__rank", "__before"))
    salts = max(64, -(-max(counts.values(), default=0) // _RANK_ROWS))
    salted = stored.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    earlier = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", salt).count().select(
        "length", salt, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before)
    )
    within = F.row_number().over(Window.partitionBy("length", salt).orderBy(*order))
    numbered = salted.withColumn(ranked, within).join(offsets, ["length", salt])
    rank = numbered.withColumn(ranked, F.col(ranked) + F.col(before) - 1).alias("n")
    slots = planned.select(*[F.col(c).alias(f"__plan_{c}") for c in planned.columns])
    fits = (F.col("length") == F.col("__plan_length")) & (F.col(ranked) >= F.col("__plan_low")) & (F.col(ranked) < F.col("__plan_high"))
    place = F.col(ranked) - F.col("__plan_low")
    # The plan is bounded by lengths, not by rows: best fit opens and splits at most two runs per length.
    return rank.join(F.broadcast(slots), fits).select(
        *[F.col(f"n.`{c}`") for c in stored.columns],
        (F.col("__plan_first") + (place - place % F.col("__plan_each")) / F.col("__plan_each")).cast("long").alias("sequence_id"),
        (F.col("__plan_offset") + place % F.col("__plan_each") * F.col("length")).cast("long").alias("offset"),
    )
