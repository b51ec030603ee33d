"""Find and replace against a lookup table."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.naming import OrderBy, col, cols, order_names, require
from millrace.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PHRASES_IN_PATTERN = 500
PATTERN_CHARS = 50_000
"""Up to these many search phrases, and characters in them, become one regular expression."""


def find_replace(
    df: DataFrame,
    lookup: DataFrame,
    find: str,
    search: str,
    replace: str | None = None,
    mode: str = "exact",
    fields: Sequence[str] = (),
    order_by: OrderBy = (),
    phrases_in_pattern: int = PHRASES_IN_PATTERN,
) -> DataFrame:
    """Replace, or extend, column ``find`` by what the lookup says about it.

    * ``exact``: a whole value equal to ``search`` becomes ``replace``; a NULL
      replacement, like no match, keeps the value.
    * ``any``: every occurrence of a search phrase inside the text is replaced, in
      one pass from left to right, the longest phrase first.
    * ``append``: the text stays, and lookup ``fields`` are added (NULL: no match).

    Where a search value repeats, the first by ``order_by`` (then by value) counts.
    """
    require(df, [find])
    if mode == "append":
        if not fields:
            raise ValueError("mode 'append' needs fields")
        return _append(df, lookup, find, search, list(fields), order_by)
    if replace is None:
        raise ValueError(f"mode {mode!r} needs replace")
    if mode == "exact":
        first = _first_per_key(lookup, search, [replace], order_by)
        joined = df.join(first, col(find) == F.col("__search"), "left")
        return joined.withColumn(find, F.coalesce(F.col("__field_0"), col(find))).select(*cols(df.columns))
    if mode == "any":
        phrases = _first_per_key(lookup, search, [replace], order_by).where(
            (F.length("__search") > 0) & F.col("__field_0").isNotNull()
        )
        return _replace_inside(df, phrases, find, phrases_in_pattern)
    raise ValueError(f"mode must be 'exact', 'any' or 'append', not {mode!r}")


def _append(df, lookup, find, search, fields, order_by):
    taken = [f for f in fields if f in df.columns]
    if taken:
        raise ValueError(f"fields already in the data: {taken}")
    first = _first_per_key(lookup, search, fields, order_by)
    joined = df.join(first, col(find) == F.col("__search"), "left")
    return joined.select(*cols(df.columns), *[F.col(f"__field_{i}").alias(f) for i, f in enumerate(fields)])


def _first_per_key(lookup: DataFrame, search: str, fields: Sequence[str], order_by: OrderBy) -> DataFrame:
    """One row per search value, so that a left join never multiplies rows.

    An aggregation, not a window: repeated search values shrink before the shuffle.
    """
    if any(not isinstance(k, str) and k[1] for k in order_by):
        raise ValueError("the lookup order must be ascending")
    require(lookup, [search, *fields, *order_names(order_by)])
    values = F.struct(*[col(f).alias(f"__field_{i}") for i, f in enumerate(fields)])
    rank = F.struct(*cols(order_names(order_by)), values)
    first = lookup.where(col(search).isNotNull()).groupBy(col(search).alias("__search"))
    return first.agg(F.min_by(values, rank).alias("__first")).select("__search", "__first.*")


def _replace_inside(df: DataFrame, phrases: DataFrame, find: str, limit: int) -> DataFrame:
    count, chars = phrases.agg(F.count(F.lit(1)), F.sum(F.length("__search") + F.length("__field_0"))).first()
    if not count:
        return df
    if count <= limit and chars <= PATTERN_CHARS:
        known = {r["__search"]: r["__field_0"] for r in phrases.collect()}
        return df.withColumn(find, _by_pattern(col(find), known))
    return _by_substrings(df, phrases, find)


def _by_pattern(text: Column, values: dict[str, str]) -> Column:
    """Cut the text into phrases and the stretches between them, map, and glue."""
    longest_first = sorted(values, key=lambda p: (-len(p), p))
    either = "|".join(_literal(p) for p in longest_first)
    # most characters cannot begin a phrase, which the class finds out at once
    first = "".join(sorted({rf"\x{{{ord(p[0]):x}}}" for p in longest_first}))
    between = rf"(?:(?!(?=[{first}])(?:{either})).)++"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?:{either})|{between}"), F.lit(0))
    table = F.create_map(*[F.lit(v) for p in longest_first for v in (p, values[p])])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def _literal(phrase: str) -> str:
    """Every ASCII mark escaped; other characters mean themselves."""
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", phrase)


def _by_substrings(df: DataFrame, phrases: DataFrame, find: str) -> DataFrame:
    """The same replacement for lookups of any size, through equi-joins.

    A phrase of length n is found by its anchor, the hash of its first 2^b characters
    where 2^b <= n < 2^(b+1).  Every text computes the hashes of its substrings of
    these few lengths; where one meets an anchor, the phrase lengths of that anchor
    are tried, and the piece must equal a whole phrase.  Rows carry ids, so only
    positions and hashes are shuffled, and equal texts do not meet.
    """
    rows = materialize(df.withColumn("__id", F.monotonically_increasing_id()))
    sized = phrases.withColumn("__size", F.length("__search"))
    kinds = T.StructType([*sized.schema.fields, T.StructField("__bits", T.IntegerType()), T.StructField("__hash", T.LongType())])
    phrases = materialize(sized.mapInPandas(_anchors, kinds))
    anchors = phrases.groupBy("__bits", "__hash").agg(F.collect_set("__size").alias("__sizes"))
    bits = sorted(r[0] for r in phrases.select("__bits").distinct().collect())  # some 30 at most

    wanted = df.sparkSession.sparkContext.broadcast(_prefilter(anchors.select("__hash")))
    grams = rows.select(F.col("__id").alias("__row"), col(find).alias("__text")).mapInPandas(
        _gram_lister(bits, wanted), "__row long, __at int, __gram_bits int, __gram long"
    )
    hits = grams.join(anchors, (F.col("__gram_bits") == F.col("__bits")) & (F.col("__gram") == F.col("__hash")))
    hits = hits.select("__row", "__at", F.explode("__sizes").alias("__size"))
    pieces = rows.select("__id", col(find).alias("__text")).join(hits, F.col("__id") == F.col("__row"))
    pieces = pieces.select("__row", "__at", F.col("__text").substr(F.col("__at"), F.col("__size")).alias("__piece"))
    match = F.struct(
        F.col("__at").alias("at"), (-F.length("__search")).alias("shorter"), F.col("__field_0").alias("value")
    )
    matches = (
        pieces.join(phrases, F.col("__piece") == F.col("__search"))
        .groupBy("__row")
        .agg(F.array_sort(F.collect_list(match)).alias("__matches"))
    )
    text = col(find)
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("done"))

    def apply(state: Column, m: Column) -> Column:
        grown = F.struct(
            (m["at"] - m["shorter"]).alias("next"),
            F.concat(state["done"], text.substr(state["next"], m["at"] - state["next"]), m["value"]).alias("done"),
        )
        return F.when(m["at"] >= state["next"], grown).otherwise(state)

    def finish(state: Column) -> Column:
        return F.concat(state["done"], text.substr(state["next"], F.length(text)))

    joined = rows.join(matches, F.col("__id") == F.col("__row"), "left")
    replaced = F.when(F.col("__row").isNull(), text).otherwise(F.aggregate("__matches", start, apply, finish))
    return joined.withColumn(find, replaced).select(*cols(df.columns))


# Base of the rolling hash, any odd number, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _window_hashes(texts: Iterable[str], bits: Sequence[int]) -> Iterator[list[np.ndarray]]:
    """For each text, per window length 2^bits, the hashes of all its windows.

    Prefix sums of a polynomial over the characters make the cost of a text linear
    in its length for every window length.
    """
    powers = inverses = np.ones(1, np.uint64)
    for text in texts:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(codes) > len(powers):
            factors = np.ones(2 * len(codes), np.uint64)
            factors[1:] = _BASE
            powers = np.cumprod(factors)
            factors[1:] = _INVERSE
            inverses = np.cumprod(factors)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers[: len(codes)], out=sums[1:])
        hashes = []
        for b in bits:
            count = max(0, len(codes) - (1 << b) + 1)
            hashes.append(((sums[1 << b :] - sums[:count]) * inverses[:count] if count else sums[:0]).view(np.int64))
        yield hashes


def _anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        bits = [int(n).bit_length() - 1 for n in frame["__size"]]
        hashes = [
            next(_window_hashes([phrase[: 1 << b]], [b]))[0][0] for phrase, b in zip(frame["__search"], bits, strict=True)
        ]
        yield frame.assign(__bits=np.array(bits, np.int32), __hash=np.array(hashes, np.int64))


def _prefilter(hashes: DataFrame) -> np.ndarray:
    """A bit set in which every anchor's hash is marked: some 16 bits per anchor, 128 MB at most.

    A hash that is not marked is no anchor's, so nothing is lost; few others pass, and
    the join drops them.  Tasks put the bits together; the driver gets finished words.
    """
    size = 1 << min(30, max(16, (16 * hashes.count()).bit_length()))
    name = hashes.columns[0]
    slot = (F.col(name).bitwiseXOR(F.shiftright(name, 32))).bitwiseAND(F.lit(size - 1))
    slots = hashes.select(F.shiftright(slot, 6).cast("int").alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = slots.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    marks = np.zeros(size // 64, "<i8")
    marks[words["at"].to_numpy()] = words["mask"].to_numpy()
    return marks.view(np.uint8)


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes ^ (hashes >> 32)) & (size - 1)


def _marked(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    bits = _slots(hashes, 8 * len(marks))
    return (marks[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


_HITS = 50_000


def _gram_lister(bits: Sequence[int], wanted):
    """Lists (row, 1-based position, bits, hash) of the windows whose hash is marked in the broadcast ``wanted``."""

    def frame_of(hits: list[tuple[int, np.ndarray, int, np.ndarray]]) -> pd.DataFrame:
        counts = [len(at) for _, at, _, _ in hits]
        return pd.DataFrame(
            {
                "__row": np.repeat([row for row, *_ in hits], counts),
                "__at": np.concatenate([at + 1 for _, at, _, _ in hits]),
                "__gram_bits": np.repeat([b for _, _, b, _ in hits], counts),
                "__gram": np.concatenate([g for *_, g in hits]),
            }
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, hits, rows = wanted.value, [], 0
        for frame in frames:
            frame = frame[frame["__text"].notna()]
            for row, hashes in zip(frame["__row"], _window_hashes(frame["__text"], bits), strict=True):
                for b, found in zip(bits, hashes, strict=True):
                    at = np.flatnonzero(_marked(found, marks))
                    if len(at):
                        hits.append((row, at, b, found[at]))
                        rows += len(at)
                if rows >= _HITS:
                    yield frame_of(hits)
                    hits, rows = [], 0
        if hits:
            yield frame_of(hits)

    return run
