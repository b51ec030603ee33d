"""Token counts of byte-level BPE vocabularies by rank-synchronous merging of arrays.

A batch's pre-tokens are held as one ragged numpy array of symbols.  Each step finds every pre-token's lowest-ranked
adjacent pair, merges all its occurrences (left to right where they overlap) in all pre-tokens at once, and drops
pre-tokens that have nothing left to merge; what survives is counted.

Counts are kept per piece of text between spaces, so that a worker merges each distinct piece once; the memory of
this cache is bounded, and clearing it changes no result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.llm.common import held_by_worker

# The pattern that byte-level BPE vocabularies of this kind split texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The vocabulary's \s is the Unicode property, which Python's differs from in four control characters.
_PATTERN = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
_ADJACENT_SPACE = re.compile(r"[\s\x85][\s\x85]")
_CACHED = 600_000
_NONE = np.int64(1 << 40)


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Merges:
    """A vocabulary's merge ranks as sorted arrays."""

    first: np.ndarray  # symbol of each byte
    pairs: np.ndarray  # sorted left * size + right
    ranks: np.ndarray
    merged: np.ndarray  # by rank
    size: int
    specials: tuple[str, ...]
    cache: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Merges:
        """From a tokenizers file; only plain byte-level BPE is understood."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not spec["normalizer"] and split.get("type") == "ByteLevel"
        if not plain or not split.get("use_regex", True) or split["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(ids.values()) + 1
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            first[byte] = ids[char]
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        return cls(first, keys[order], order, merged, size, tuple(t["content"] for t in spec["added_tokens"]))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], _NONE)

    def surviving(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each pre-token ends with."""
        counts = np.zeros(len(pieces), np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owners = np.flatnonzero(lengths)
        lengths = lengths[owners]
        rank = None
        while len(owners):
            starts = np.cumsum(lengths) - lengths
            if rank is None:
                rank = np.full(len(symbols), _NONE)
                rank[:-1] = self.rank(symbols[:-1], symbols[1:])
                rank[starts + lengths - 1] = _NONE
            lowest = np.minimum.reduceat(rank, starts)
            alive = lowest < _NONE
            if not alive.all():
                counts[owners[~alive]] = lengths[~alive]
                kept = np.repeat(alive, lengths)
                symbols, rank = symbols[kept], rank[kept]
                owners, lengths, lowest = owners[alive], lengths[alive], lowest[alive]
                starts = np.cumsum(lengths) - lengths
                if not len(owners):
                    break
            hit = rank == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            # In a run of overlapping occurrences every second one, from the left, is merged.
            begins = np.r_[True, np.diff(at) != 1]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            lengths = lengths - np.add.reduceat(gone.astype(np.int64), starts)
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            kept = ~gone
            symbols, rank, changed = symbols[kept], rank[kept], changed[kept]
            ends = np.cumsum(lengths) - 1
            changed[:-1] |= changed[1:]
            new = np.flatnonzero(changed[:-1])
            rank[new] = self.rank(symbols[new], symbols[new + 1])
            rank[ends] = _NONE
        return counts

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string of the vocabulary stands alone."""
        if not any(s in text for s in self.specials):
            return _SPLIT.findall(text)
        found: list[str] = []
        for part in re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text):
            found += [part] if part in self.specials else _SPLIT.findall(part)
        return found

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        plans, missing = [], {}
        for text in texts:
            if _ADJACENT_SPACE.search(text):
                plans.append(None)
                continue
            # No two spaces touch: every single space belongs to what follows it, every line break is by itself.
            lines = text.split("\n")
            plans.append(lines)
            for line in lines:
                head, *tail = line.split(" ")
                for piece in (head, *[" " + w for w in tail]):
                    if piece not in self.words:
                        missing[piece] = None
        self._learn(missing)
        counts = np.zeros(len(texts), np.int64)
        words = self.words
        newline = self._sum("\n") if any(p and len(p) > 1 for p in plans) else 0
        for i, lines in enumerate(plans):
            if lines is None:
                counts[i] = self._sum(texts[i])
                continue
            total = newline * (len(lines) - 1)
            for line in lines:
                head, *tail = line.split(" ")
                total += words[head] + sum([words[" " + w] for w in tail])
            counts[i] = total
        if len(words) > _CACHED:
            words.clear()
        return counts

    def _learn(self, pieces: dict[str, None]) -> None:
        split = {piece: self.pre_tokens(piece) for piece in pieces}
        self._merge({t for tokens in split.values() for t in tokens})
        for piece, tokens in split.items():
            self.words[piece] = sum([self.cache[t] for t in tokens])
        self._trim()

    def _sum(self, text: str) -> int:
        tokens = self.pre_tokens(text)
        self._merge(set(tokens))
        total = sum([self.cache[t] for t in tokens])
        self._trim()
        return total

    def _merge(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.cache]
        ordinary = [t for t in new if t not in self.specials]
        self.cache |= dict(zip(ordinary, self.surviving([t.encode() for t in ordinary]).tolist(), strict=True))
        self.cache |= {t: 1 for t in new if t in self.specials}

    def _trim(self) -> None:
        if len(self.cache) > _CACHED:
            self.cache.clear()


_SPLIT = regex.compile(_PATTERN)
def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of whole texts without added begin or end tokens; NULL and empty texts have 0.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has.
    """

    def count(texts: pa.Array) -> pa.Array:
        merges = held_by_worker(("merges", vocabulary), lambda: Merges.load(vocabulary))
        out, some, held = [], [], 0
        for text in texts.to_pylist():
            some.append(text or "")
            held += len(some[-1])
            if held > 1 << 20:
                out.append(merges.count(some))
                some, held = [], 0
        out.append(merges.count(some))
        return pa.array(np.concatenate(out), pa.int64())

    return F.arrow_udf(count, "long")(text)
