"""Blocks of tag sets that each task holds beside its records, and the best records of every set so far.

A block's queries are sorted into kinds that hold much the same tags, ordered by size and cut into stripes. A tag that
several queries of a stripe hold is a row of bits, one per query; the rows of a record's tags are added up bit by bit for
64 queries at once, which gives the shared tags with all of them. All other tags go through posting lists. Both counts are
exact, so is their sum; kinds only decide what is compared first, and how many rows a stripe has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STRIPE = 2048
"""Queries of a stripe."""
SLICE_ROWS, SLICE_TAGS = 1 << 14, 1 << 22
"""Most records and tags of a slice; one record always fits."""
BATCH = 1 << 19
"""Pairs of a stripe and records alike that meet at once."""
COLUMNS, COLUMN_SHARE = 8192, 80
"""Most tags of a stripe that are rows of bits; one in how many of its queries a tag must be in to become one."""
RARE, NOWHERE = -1, -2
KINDS, KIND_ROWS, KIND_TAGS = 6, 256, 512
"""Most kinds of a block, fewest queries for each kind, and how many of the most common tags tell them apart."""
HITS = 1 << 16
"""Posting list entries that are written out at once."""


def plain(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Values that Arrow can look up: nested ones as text, minus zero as zero."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if pa.types.is_nested(values.type):
        return pa.array([repr(v) for v in values.to_pylist()], pa.string())
    return pc.add(values, pa.scalar(0, values.type)) if pa.types.is_floating(values.type) else values


def numbered(sets: pa.Array, known: Sequence[pa.Array]) -> pa.Array:
    """Sets of the places of their tags among ``known``, one part after the other; -1 for other tags."""
    tags = plain(pc.list_flatten(sets))
    found, before = np.full(len(tags), -1, np.int32), 0
    for part in known:
        here = _numbers(pc.index_in(tags, part))
        found = np.where(here >= 0, here + before, found).astype(np.int32)
        before += len(part)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(found))
    return pc.if_else(sets.is_null(), pa.scalar(None, lists.type), lists) if sets.null_count else lists


def _numbers(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, -1).to_numpy(zero_copy_only=False)


def _tags(sets: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many tags every set has, and all tags in a row."""
    return pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64), plain(pc.list_flatten(sets))


def _reordered(tag: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The tags of sets, which lie one after the other, with the sets in another order."""
    begin, size = (np.cumsum(size) - size)[order], size[order]
    return tag[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]


def _cut(kind: np.ndarray, wide: int) -> list[tuple[int, int]]:
    """Ranges of at most ``wide`` rows, each of one kind."""
    ends = [*(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
    return [(i, min(i + wide, end)) for begin, end in zip([0, *ends], ends, strict=False) for i in range(begin, end, wide)]


class Kinds:
    """Sets are of the kind whose middle is nearest by the tags that are common among the queries (k-means by cosine)."""

    def __init__(self, size: np.ndarray, tag: np.ndarray, vocabulary: int):
        wanted = min(KINDS, len(size) // KIND_ROWS)
        held = np.bincount(tag, minlength=vocabulary)
        common = np.argsort(-held, kind="stable")[:KIND_TAGS]
        self.column = np.full(vocabulary, NOWHERE, np.int32)
        self.column[common] = np.arange(len(common))
        self.weight = np.log(1 + len(size) / held[common]).astype(np.float32)
        self.middles = np.zeros((1, len(common)), np.float32)
        if wanted < 2:
            return
        many = np.flatnonzero(size >= np.median(size))
        many = many[:: max(1, len(many) // 2048)]
        place = np.full(len(size), -1)
        place[many] = np.arange(len(many))
        row = place[np.repeat(np.arange(len(size)), size)]
        seen = self._vectors(len(many), row[row >= 0], tag[row >= 0])
        middles, near = [seen.sum(axis=0)], np.full(len(seen), -1.0, np.float32)
        near = seen @ (middles[0] / max(np.linalg.norm(middles[0]), 1e-9))
        for step in range(wanted - 1):  # of some rows, the one that brings all nearest to a middle
            tried = seen[step :: max(1, len(seen) // 64)]
            gains = np.maximum(seen @ tried.T, near[:, None]).sum(axis=0)
            middles.append(tried[gains.argmax()])
            near = np.maximum(near, seen @ middles[-1])
        found = np.array(middles)
        for _ in range(8):
            found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
            mine = (seen @ found.T).argmax(axis=1)
            found = np.array([seen[mine == c].sum(axis=0) for c in range(wanted)])
        self.middles = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def _vectors(self, count: int, row: np.ndarray, tag: np.ndarray) -> np.ndarray:
        column = self.column[tag]
        common = column >= 0
        out = np.zeros((count, len(self.weight)), np.float32)
        out[row[common], column[common]] = self.weight[column[common]]
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return out

    def of(self, count: int, row: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The kinds of ``count`` sets, in which set ``row[i]`` holds ``tag[i]``."""
        if len(self.middles) == 1:
            return np.zeros(count, np.int64)
        out = np.empty(count, np.int64)
        for first in range(0, count, SLICE_ROWS):
            last = min(first + SLICE_ROWS, count)
            some = slice(*np.searchsorted(row, (first, last)))
            out[first:last] = (self._vectors(last - first, row[some] - first, tag[some]) @ self.middles.T).argmax(axis=1)
        return out


class Stripe:
    """Queries of a block from ``first`` on, and which of them hold a tag."""

    def __init__(self, first: int, size: np.ndarray, row: np.ndarray, tag: np.ndarray, vocabulary: int, kind: int):
        self.first, self.size, self.kind = first, size, kind
        held = np.bincount(tag, minlength=vocabulary)
        common = np.argsort(-held, kind="stable")[:COLUMNS]
        common = common[COLUMN_SHARE * held[common] >= max(len(size), 3 * COLUMN_SHARE)]
        # the row of bits of a tag, RARE for a posting list, NOWHERE if no query holds it
        self.column = np.where(held > 0, RARE, NOWHERE).astype(np.int32)
        self.column[common] = np.arange(len(common))
        column = self.column[tag]
        dense = column >= 0
        order = np.argsort(column[dense], kind="stable")
        column, mine = column[dense][order], row[dense][order]
        self.bits = np.zeros((len(common) + 1, -(-len(size) // 64)), np.uint64)  # the last row is empty
        for first in range(0, len(common), 1024):
            some = slice(*np.searchsorted(column, (first, first + 1024)))
            wide = np.zeros((min(1024, len(common) - first), 64 * self.bits.shape[1]), np.uint8)
            wide[column[some] - first, mine[some]] = 1
            self.bits[first : first + len(wide)] = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)
        tag, row = tag[~dense], row[~dense]
        self.rows = row[np.argsort(tag, kind="stable")].astype(np.int32)
        self.starts = np.r_[0, np.cumsum(np.bincount(tag, minlength=vocabulary))].astype(np.int32)


class Block:
    """Some queries, ready to be compared with any records."""

    def __init__(self, queries: pa.Table, exclude_same_key: bool):
        sets = queries.column("set").combine_chunks()
        size, tags = _tags(sets)
        known = tags.dictionary_encode()
        tag = _numbers(known.indices)
        often = np.argsort(-np.bincount(tag, minlength=len(known.dictionary)), kind="stable")  # near each other in memory
        self.vocabulary = known.dictionary.take(pa.array(often))
        place = np.empty(len(often), np.int32)
        place[often] = np.arange(len(often))
        tag = place[tag]
        self.kinds = Kinds(size, tag, len(self.vocabulary))
        kind = self.kinds.of(len(size), np.repeat(np.arange(len(size)), size), tag)
        order = np.lexsort((size, kind))
        tag = _reordered(tag, size, order)
        self.q, self.size, self.kind = queries.column("q").to_numpy()[order], size[order], kind[order]
        self.keys = self.key = None
        if exclude_same_key:
            keys = plain(queries.column("key")).take(pa.array(order))
            self.keys = pc.unique(keys)
            self.key = _numbers(pc.index_in(keys, self.keys))
        row = np.repeat(np.arange(len(self.size)), self.size)
        ends = np.r_[0, np.cumsum(self.size)]
        self.stripes = []
        for first, last in _cut(self.kind, STRIPE):
            some = slice(ends[first], ends[last])
            self.stripes.append(Stripe(first, self.size[first:last], row[some] - first, tag[some], len(self.vocabulary), self.kind[first]))

    def slices(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Slices of a batch: first record, sizes, record and number of every tag that a query has, numbers of the keys."""
        size, tags = _tags(batch.column("set"))
        tag = _numbers(pc.index_in(tags, self.vocabulary))
        key = None if self.keys is None else _numbers(pc.index_in(plain(batch.column("key")), self.keys))
        ends = np.cumsum(size)
        first = 0
        while first < len(size):
            begin = ends[first] - size[first]
            last = int(np.searchsorted(ends, begin + SLICE_TAGS, side="right"))
            last = min(max(last, first + 1), first + SLICE_ROWS)
            some = tag[begin : ends[last - 1]]
            record = np.repeat(np.arange(last - first, dtype=np.int32), size[first:last])
            known = some >= 0
            yield first, size[first:last], record[known], some[known], None if key is None else key[first:last]
            first = last


class Best:
    """The ``k`` best records of every query of a block, among the records seen so far.

    The number of a record decides between equal scores.
    """

    def __init__(self, block: Block, k: int, rounds: Sequence[int]):
        self.block, self.k = block, k
        self.rounds = sorted(rounds)
        self.score = np.zeros((len(block.size), k))
        self.at = np.full((len(block.size), k), -1, np.int64)

    def see(self, at: int, size: np.ndarray, record: np.ndarray, tag: np.ndarray, key: np.ndarray | None) -> None:
        """Compare all queries with a slice of records, the first of which is number ``at`` of all."""
        kind = self.block.kinds.of(len(size), record, tag)
        order = np.lexsort((size, kind))
        held = np.bincount(record, minlength=len(size))
        tag, record = _reordered(tag, held, order), np.repeat(np.arange(len(size), dtype=np.int32), held[order])
        size, kind, numbers = size[order], kind[order], at + order
        key = None if key is None else key[order]
        for stripe in self.block.stripes:
            tags = Split(stripe, len(size), record, tag)
            ranges = _cut(kind, max(1, BATCH // (64 * stripe.bits.shape[1])))
            # records alike first: they raise the scores that others have to reach
            far = np.abs(np.log([size[(first + last) // 2] for first, last in ranges]) - np.log(stripe.size[len(stripe.size) // 2]))
            far += [1e3 * (kind[first] != stripe.kind) for first, _ in ranges]
            for i in np.argsort(far, kind="stable"):
                for first, last in self._steps(stripe, *ranges[i]):
                    least, most = self._reaching(stripe)
                    if size[last - 1] < least or size[first] > most:
                        continue
                    mine = slice(first, last)
                    order, shared = tags.shared(first, last)
                    self._meet(stripe, shared, numbers[mine][order], size[mine][order], None if key is None else key[mine][order])

    def _steps(self, stripe: Stripe, first: int, last: int) -> Iterator[tuple[int, int]]:
        """The range at once, or small parts first while no query has ``k`` records."""
        wide = last - first
        if not self.score[stripe.first : stripe.first + len(stripe.size), -1].any():
            wide = 16
        while first < last:
            yield first, min(first + wide, last)
            first, wide = first + wide, 2 * wide

    def _reaching(self, stripe: Stripe) -> tuple[int, float]:
        """The sizes of records that can still enter: a query with ``k`` records at a round needs none that lie below."""
        mine = stripe.size
        lowest = self.score[stripe.first : stripe.first + len(mine), -1]
        floor = np.zeros(len(mine), np.int64)
        for percent in self.rounds:
            floor[lowest >= percent / 100] = percent
        if not floor.all():
            return 0, np.inf
        # sizes ascend within a stripe, floors do not: the widest range that any query leaves open
        return ((floor * mine + 99) // 100).min(), (100 * mine // floor).max()

    def _meet(self, stripe: Stripe, shared: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray | None) -> None:
        rows = slice(stripe.first, stripe.first + len(stripe.size))
        # a score above t means more than t / (1 + t) of both sizes shared; half a tag covers the rounding here, exact scores follow
        lowest = self.score[rows, -1]
        part = lowest / (1 + lowest) * (1 - 1e-6)
        above = (part * stripe.size + np.where(lowest > 0, -0.5, 0.5)).astype(np.float32)
        need = np.multiply.outer(size.astype(np.float32), part.astype(np.float32))
        need += above
        which, row = np.divmod(np.flatnonzero(shared[:, : len(stripe.size)] > need), len(stripe.size))
        if not len(row):
            return
        both = shared[which, row].astype(np.float64)
        score = both / (stripe.size[row] + size[which] - both)
        row, at = row + stripe.first, at[which]
        enters = (score > self.score[row, -1]) | ((score == self.score[row, -1]) & (at < self.at[row, -1]))
        if key is not None:
            enters &= self.block.key[row] != key[which]
        if enters.any():
            self._enter(row[enters], score[enters], at[enters])

    def _enter(self, row: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        touched = np.unique(row)
        old_row, old_place = np.nonzero(self.at[touched] >= 0)
        old = touched[old_row], old_place
        row = np.r_[touched[old_row], row]
        score, at = np.r_[self.score[old], score], np.r_[self.at[old], at]
        order = np.lexsort((at, -score, row))
        row, score, at = row[order], score[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.score[row[best], place[best]] = score[best]
        self.at[row[best], place[best]] = at[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, record numbers and scores."""
        row, place = np.nonzero(self.at >= 0)
        return self.block.q[row], self.at[row, place], self.score[row, place]


class Split:
    """The tags of some records: those that are rows of bits of a stripe, and those with posting lists."""

    def __init__(self, stripe: Stripe, count: int, record: np.ndarray, tag: np.ndarray):
        self.stripe = stripe
        column = stripe.column[tag]
        dense = np.flatnonzero(column >= 0)
        self.column, self.row = column[dense], record[dense]
        self.many = np.bincount(self.row, minlength=count)
        self.ends = np.r_[0, np.cumsum(self.many)]
        rare = np.flatnonzero(column == RARE)
        self.record, tag = record[rare], tag[rare]
        self.begin = stripe.starts[tag]
        self.held = stripe.starts[tag + 1] - self.begin
        self.rare = np.bincount(self.record, minlength=count)
        self.last = np.r_[0, np.cumsum(self.rare)]

    def shared(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of these records; how many tags they share with each query, and further columns up to whole words."""
        many = self.many[first:last]
        order = np.argsort(-many, kind="stable")
        rank = np.empty(len(many), np.int32)
        rank[order] = np.arange(len(many))
        some = slice(self.ends[first], self.ends[last])
        rows = np.full((many.max(initial=0), len(many)), len(self.stripe.bits) - 1, np.int64)
        place = np.arange(some.start, some.stop) - np.repeat(self.ends[first:last], many)
        place *= len(many)
        place += rank[self.row[some] - first]
        rows.reshape(-1)[place] = self.column[some]
        planes = _add(self.stripe.bits, rows, np.searchsorted(-many[order], -np.arange(len(rows))))
        most = (1 << len(planes)) - 1 + int(self.rare[first:last].max(initial=0))
        kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64
        width = 64 * self.stripe.bits.shape[1]
        shared = np.zeros((len(many), width), kind)
        for j, plane in enumerate(planes):
            bits = np.unpackbits(plane.view(np.uint8), axis=1, bitorder="little")
            if j < 8:  # eight bytes at once
                np.left_shift(bits.view(np.uint64), j, out=bits.view(np.uint64))
                np.bitwise_or(shared, bits, out=shared)
            else:
                shared |= np.left_shift(bits, j, dtype=kind)
        some = slice(self.last[first], self.last[last])
        row, begin, held = rank[self.record[some] - first], self.begin[some], self.held[some]
        ends = np.cumsum(held, dtype=np.int64)
        flat, at = shared.reshape(-1), 0
        while at < len(ends):
            before = ends[at] - held[at]
            end = max(at + 1, int(np.searchsorted(ends, before + HITS, side="right")))
            few = held[at:end]
            entry = np.repeat(begin[at:end] - (ends[at:end] - few - before).astype(np.int32), few)
            entry += np.arange(len(entry), dtype=np.int32)
            pair = np.repeat(row[at:end].astype(np.int64) * width, few)
            pair += self.stripe.rows[entry]
            np.add.at(flat, pair, kind(1))
            at = end
        return order, shared


def _add(bits: np.ndarray, rows: np.ndarray, widths: np.ndarray) -> list[np.ndarray]:
    """Bit by bit, lowest first, the sums of the bits in ``rows[:, i]`` for every ``i``; none that are all 0 on top.

    Beyond the first ``widths[n]``, which fall, ``rows[n]`` are empty. Carry-save adders: two new numbers of a level and
    its sum so far give a new sum and one number of the next level.
    """
    shape = rows.shape[1], bits.shape[1]
    half = np.empty(shape, np.uint64)
    sums: list[np.ndarray] = []
    kept: list[tuple[np.ndarray, int] | None] = []
    spare: list[np.ndarray] = []

    def put(new: np.ndarray, wide: int, level: int) -> None:
        while True:
            if level == len(sums):
                new[wide:] = 0
                sums.append(new)
                kept.append(None)
                return
            if kept[level] is None:
                kept[level] = new, wide
                return
            old, most = kept[level]
            kept[level] = None
            if most > wide:
                new[wide:most] = 0
            elif wide > most:
                old[most:wide] = 0
                most = wide
            total, one, two, tmp = sums[level][:most], old[:most], new[:most], half[:most]
            np.bitwise_xor(total, one, tmp)
            np.bitwise_and(total, one, one)
            np.bitwise_xor(tmp, two, total)
            np.bitwise_and(tmp, two, tmp)
            np.bitwise_or(one, tmp, one)
            spare.append(new)
            new, wide, level = old, most, level + 1

    for some, wide in zip(rows, widths.tolist(), strict=True):
        new = spare.pop() if spare else np.empty(shape, np.uint64)
        bits.take(some[:wide], 0, new[:wide], "clip")
        put(new, wide, 0)
    level = 0
    while level < len(sums):
        if kept[level] is not None:
            (old, wide), kept[level] = kept[level], None
            total = sums[level][:wide]
            carry = np.zeros(shape, np.uint64)
            np.bitwise_and(total, old[:wide], carry[:wide])
            np.bitwise_xor(total, old[:wide], total)
            put(carry, wide, level + 1)
        level += 1
    while sums and not sums[-1].any():
        sums.pop()
    return sums
