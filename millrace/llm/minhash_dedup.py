"""Near-duplicate texts by HyperMinHash sketches, banding and exact confirmation.

* A text's set is its distinct word shingles.  Texts with equal sets form one class; only classes are compared.
* A sketch deals the shingles' hashes to ``REGISTERS`` buckets and keeps of each bucket's minimum the count of leading
  zeros and ``MANTISSA`` further bits.  Empty registers of small sets copy another one, chosen by a fixed probing order.
* Registers are banded; classes that agree in a band meet in its bucket.  A pair of similarity 0.8 meets in none of
  the 40 bands of 5 registers once in eight million; lower thresholds get shorter bands that miss no more.
* A bucket's pairs are not listed.  Every class is compared with one leader, the first class of its buckets with which
  it shares most bands; links found join components.  What is left are buckets that hold several components.  Their members are compared sketch by sketch inside tiles of bounded size; classes of different
  components that may reach the similarity fall into one cluster.  Each cluster's full sets then meet in tiles, which
  multiply incidence matrices, so every pair is confirmed exactly and a tile returns at most one row per component.
  Tiles within one component are left out: however large it is, only what may still join it is compared with it.
* The similarity of a pair is estimated from its registers, corrected for accidental agreement; pairs that are more
  than five standard deviations below the threshold go, and all others are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, slices, utf8
from millrace.llm.components import components
from millrace.llm.forest import Forest
from millrace.llm.vectors import groups
from millrace.llm.words import mix, shingles, words
from millrace.session import materialize

REGISTERS, BAND, MANTISSA = 200, 5, 10
_MISSES = 1.3e-7  # how often a pair at the threshold may meet in no band
_TILE = 2048  # sketches of one bucket that meet in a task, twice at most
_CHUNK = 128  # full sets of one cluster, likewise
_STRIPE, _PAIRS, _COLUMNS = 64, 1 << 16, 4096
_BROADCAST_IDS = 1_000_000  # 16 MB of ids and classes
_PROBES = np.random.default_rng(5).integers(0, REGISTERS, (400, REGISTERS))
_FACTORS = np.random.default_rng(6).integers(1, 1 << 62, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (uint16) of sets of hashes that are sorted within each set; sets must not be empty."""
    rows = len(bounds) - 1
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    at = owner * REGISTERS + ((hashes >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    low = np.minimum.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    fraction, exponent = np.frexp(low.astype(np.float64))
    zeros = np.minimum(64 - exponent, 63)
    value = (zeros << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64).clip(0)
    filled = np.zeros(rows * REGISTERS, bool)
    filled[at[starts]] = True
    out = np.zeros(rows * REGISTERS, np.uint16)
    out[at[starts]] = value
    filled, out = filled.reshape(rows, REGISTERS), out.reshape(rows, REGISTERS)
    own = out.copy()
    row, column = np.nonzero(~filled)
    for probe in _PROBES:
        if not len(row):
            break
        source = probe[column]
        hit = filled[row, source]
        out[row[hit], column[hit]] = own[row[hit], source[hit]]
        row, column = row[~hit], column[~hit]
    out[row, column] = own[row, filled[row].argmax(axis=1)]
    return out


def band_of(percent: int) -> int:
    """Registers per band: ``BAND`` at most, and as few as a pair of similarity ``percent`` needs to meet in a band."""
    for band in range(BAND, 0, -1):
        if (1 - (percent / 100) ** band) ** (REGISTERS // band) <= _MISSES:
            return band
    raise ValueError(f"{REGISTERS} registers do not find all pairs of {percent} percent")


def band_keys(registers: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key per band of each sketch; equal registers of different bands give different keys."""
    count = REGISTERS // band
    parts = registers[:, : count * band].astype(np.uint64) * _FACTORS[: count * band]
    bands = parts.reshape(len(registers), count, band).sum(axis=2) + np.arange(count, dtype=np.uint64)
    return mix(bands).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity.  Unequal minima of sets of n_a and n_b agree by accident with the probability
    ln 2 * n_a * n_b / (n_a + n_b)**2 / 2**MANTISSA: the mean width of a register's cell against the minima's densities."""
    equal = (a == b).mean(axis=-1)
    accident = np.log(2) * n_a * n_b / (n_a + n_b).astype(np.float64) ** 2 / (1 << MANTISSA)
    return (equal - accident) / (1 - accident)


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Estimates from which a pair may reach the threshold; sketches of small sets spread more, and those of pairs
    near 50 percent: the margins are five standard deviations and more."""
    spread = max(1.0, (percent / 100 * (1 - percent / 100) / 0.16) ** 0.5) if percent > 50 else 1.25
    return percent / 100 - spread * np.where(n >= REGISTERS, 0.145, 0.25)


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    release()
    data, offsets = utf8(texts)
    for a, b in slices(offsets):
        found, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, *shingles(found, bounds, size)


def _identity(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes), out=sums[1:])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _sketched(docs: DataFrame, key: str, text: str, size: int, band: int, tag: str | None) -> DataFrame:
    """id, tag, n, class, registers, bands; class and sketch are NULL for texts without words."""
    numbered = F.lit(0) if tag is None else F.col(tag)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), numbered.cast("long").alias("tag"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found, bounds in _sets(batch.column(1), size):
                n = np.diff(bounds)
                some = n > 0
                inner = np.r_[0, np.cumsum(n[some])]
                registers = sketch(found, inner) if some.any() else np.zeros((0, REGISTERS), np.uint16)
                place = np.full(b - a, -1)
                place[some] = np.arange(some.sum())
                take = pa.array(place, pa.int64(), mask=~some)
                keys = band_keys(registers, band)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), REGISTERS // band)
                columns = [
                    batch.column(0).slice(a, b - a),
                    batch.column(2).slice(a, b - a),
                    pa.array(n, pa.int64()),
                    pc.take(pa.array(_identity(found, inner)), take),
                    pc.take(pa.array([r.tobytes() for r in registers], pa.binary()), take),
                    pc.take(lists.cast(pa.list_(pa.int64())), take),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tag", "n", "class", "registers", "bands"])

    return source.mapInArrow(work, "id long, tag long, n long, class long, registers binary, bands array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _plausible(percent: int) -> Column:
    """Whether a pair's sketches leave the threshold possible."""

    def test(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        x, y = n_a.to_numpy(), n_b.to_numpy()
        good = similarity(_matrix(a), _matrix(b), x, y) >= _least(np.minimum(x, y), percent)
        return pa.array(good & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)))

    return F.arrow_udf(test, "boolean")("registers_a", "registers_b", "n_a", "n_b")


def _confirmed(percent: int) -> Column:
    """Whether a pair's full sets reach the threshold."""

    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(test, "boolean")("set_a", "set_b")


def _set_of_class(size: int) -> Column:
    """The full set of a text where it is that of the class, else NULL.

    One function of both columns: as a comparison of two it would become a join key and run over all documents.
    """

    def work(texts: pa.Array, classes: pa.Array) -> pa.Array:
        wanted, out = classes.to_numpy(), []
        for a, b, found, bounds in _sets(texts, size):
            same = (np.diff(bounds) > 0) & (_identity(found, bounds) == wanted[a:b])
            out += [found[bounds[i] : bounds[i + 1]].tobytes() if same[i] else None for i in range(b - a)]
        return pa.array(out, pa.binary())

    return F.arrow_udf(work, "binary")("text", "class")


def _sets_of(docs: DataFrame, key: str, text: str, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class, set) of the ``wanted`` classes, written."""
    wanted = materialize(wanted.distinct().join(classes.select("class", "id"), "class"))
    if wanted.count() <= _BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    # An id may stand in rows of several texts: the class is worked out again.
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id")
    sets = materialize(texts.select("class", _set_of_class(size).alias("set")))
    return sets.where(F.col("set").isNotNull()).dropDuplicates(["class"])


def _links(docs: DataFrame, key: str, text: str, classes: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) of classes that are links, written."""
    side = classes.select("class", "n", "registers")
    for x in ("a", "b"):
        pairs = pairs.join(side.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}")), x)
    likely = materialize(pairs.where(_plausible(percent)).select("a", "b"))
    ends = likely.select(F.col("a").alias("class")).unionByName(likely.select(F.col("b").alias("class")))
    sets = _sets_of(docs, key, text, classes, ends, size)
    for x in ("a", "b"):
        likely = likely.join(sets.select(F.col("class").alias(x), F.col("set").alias(f"set_{x}")), x)
    return materialize(likely.where(_confirmed(percent)).select("a", "b"))


def _edges(names: np.ndarray, forest: Forest) -> pa.RecordBatch:
    """Rows (a, b) that join every thing with its root."""
    a, b = names, names[forest.root]
    joined = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[joined]), pa.array(b[joined])], ["a", "b"])


def _plausible_edges(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Joins classes of one bucket tile that lie in different components and may reach the threshold."""
    n, component = rows.column("n").to_numpy(), rows.column("component").to_numpy()
    registers, forest = _matrix(rows.column("registers").combine_chunks()), Forest(len(rows))
    # The largest component is compared with the others, never with itself.
    names, sizes = np.unique(component, return_counts=True)
    asking = np.flatnonzero(component != names[sizes.argmax()])
    for first in range(0, len(asking), _STRIPE):
        x = asking[first : first + _STRIPE]
        small, large = np.minimum(n[x, None], n), np.maximum(n[x, None], n)
        open_ = (component[x, None] != component) & (100 * small >= percent * large)
        at, y = np.nonzero(open_)
        for k in range(0, len(at), _PAIRS):
            i, j = x[at[k : k + _PAIRS]], y[k : k + _PAIRS]
            near = similarity(registers[i], registers[j], n[i], n[j]) >= _least(np.minimum(n[i], n[j]), percent)
            forest.link(i[near], j[near])
    return _edges(rows.column("class").to_numpy(), forest)


def _confirmed_edges(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """Joins components of one cluster tile that hold classes whose full sets reach the threshold."""
    sets = [np.frombuffer(x, np.int64) for x in rows.column("set").to_pylist()]
    n, component = np.array([len(x) for x in sets]), rows.column("component").to_numpy()
    names, at = np.unique(component, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    found, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    useful = uses[column] > 1  # a shingle of one class is in no intersection
    owner, column = owner[useful], (np.cumsum(uses > 1) - 1)[column[useful]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int((uses > 1).sum()), _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        shared += has @ has.T
    reach = 100 * shared >= percent * (n[:, None] + n - shared)
    reach &= (shared > 0) & (component[:, None] != component)
    x, y = np.nonzero(reach)
    forest = Forest(len(names))
    forest.link(at[x], at[y])
    return _edges(names, forest)


def _tiled(tiles: DataFrame, keys: list[str], join, percent: int) -> DataFrame:
    """Run ``join`` over each tile's rows; (a, b) pairs that join."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups(batches, keys):
            yield join(tile, percent)

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "a long, b long")


def _pairs_of_chunks(members: DataFrame, size: Column, rows: int) -> DataFrame:
    """Deal each bucket's members to chunks of about ``rows`` and bring every two chunks together: columns i, j."""
    chunks = F.ceil(size / rows).cast("int")
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("class"), chunks).cast("int"))
    spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return spread.withColumn("i", F.least("chunk", "with")).withColumn("j", F.greatest("chunk", "with")).drop("with", "chunk")


def _cluster_tiles(members: DataFrame) -> DataFrame:
    """(cluster, class, component) dealt to tiles ``i``, ``j``; two chunks of one component do not meet.

    A component of at least ``_CHUNK`` classes has chunks of its own, small ones share chunks.
    """
    sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    small = sizes.where(F.col("size") < _CHUNK).groupBy("cluster").agg(F.sum("size").alias("small"))
    sized = members.join(sizes, ["cluster", "component"]).join(small, "cluster", "left")
    own = F.when(F.col("size") >= _CHUNK, F.col("component"))
    of_own = F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / _CHUNK))
    of_small = F.pmod(F.xxhash64("component"), F.ceil(F.coalesce("small", F.lit(1)) / _CHUNK))
    dealt = sized.select(
        "cluster", "class", "component", own.alias("own"),
        F.xxhash64(own, F.when(own.isNotNull(), of_own).otherwise(of_small)).alias("chunk"),
    )
    dealt = materialize(dealt)
    chunks = dealt.select("cluster", "chunk", "own").distinct()
    other = chunks.select("cluster", F.col("chunk").alias("j"), F.col("own").alias("own_j"))
    both = chunks.withColumnRenamed("chunk", "i").withColumnRenamed("own", "own_i").join(other, "cluster")
    both = both.where((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("own_i") == F.col("own_j"), F.lit(False)))
    both = both.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    return dealt.join(both, ["cluster", "chunk"]).select("cluster", "i", "j", "class", "component")


class _Labels:
    """Component of every linked class; a class without a link is its own."""

    def __init__(self, classes: DataFrame):
        self.roots = materialize(classes.select(F.col("class").alias("node"), F.col("class").alias("root")).limit(0))

    def of(self, df: DataFrame, column: str, name: str) -> DataFrame:
        found = df.join(self.roots.select(F.col("node").alias(column), F.col("root").alias("__root")), column, "left")
        return found.withColumn(name, F.coalesce("__root", column)).drop("__root")

    def merge(self, links: DataFrame) -> None:
        named = self.of(self.of(links, "a", "u"), "b", "v")
        newer = components(named, "u", "v").select(F.col("node").alias("root"), F.col("root").alias("newer"))
        renamed = self.roots.join(newer, "root", "left").select("node", F.coalesce("newer", "root").alias("root"))
        roots = newer.select(F.col("root").alias("node"), F.col("newer").alias("root"))
        self.roots = materialize(renamed.unionByName(roots))


def _rest(docs, key, text, classes, meetings, labels: _Labels, tested: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) that leave no two components to be joined, among all classes that meet in a bucket."""
    held = labels.of(meetings, "class", "component")
    mixed = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left = materialize(held.join(mixed.where(F.col("low") != F.col("high")).select("bucket"), "bucket"))
    # A bucket of two is a pair, its smaller class the leader.
    pairs = left.where((F.col("size") == 2) & (F.col("class") != F.col("lead"))).select(F.col("class").alias("a"), F.col("lead").alias("b"))
    pairs = materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
    wide = left.where(F.col("size") > 2).join(classes.select("class", "n", "registers"), "class")
    tiles = _pairs_of_chunks(wide, F.col("size"), _TILE).select("bucket", "i", "j", "class", "component", "n", "registers")
    near = _tiled(tiles, ["bucket", "i", "j"], _plausible_edges, percent)
    links = _links(docs, key, text, classes, pairs, percent, size)
    roots = components(near, "a", "b").select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    firsts = roots.select(F.col("cluster").alias("class"), "cluster").distinct()
    members = materialize(labels.of(roots.unionByName(firsts), "class", "component"))
    if members.isEmpty():
        return links
    meeting = _cluster_tiles(members)
    sets = _sets_of(docs, key, text, classes, members.select("class"), size)
    confirmed = _tiled(meeting.join(sets, "class"), ["cluster", "i", "j"], _confirmed_edges, percent)
    return materialize(links.unionByName(confirmed))


def near_duplicates(
    docs: DataFrame, key: str, text: str, shingle_words: int = 5, percent: int = 80, tag: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: the key (long), n_shingles, component_id, kept (and the ``tag``).

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; with fewer than ``shingle_words`` words the
    whole sequence is the one shingle.  Rows are linked where 100 * intersection >= percent * union;
    ``component_id`` is the smallest key reachable and ``kept`` marks the row with that key.  NULL texts and texts
    without words, and rows with a NULL key, are linked with nothing and kept.  Rows that repeat a key are each
    compared by their own text; all rows with the smallest key are kept.

    ``tag`` names a column of unique stored numbers.  It is carried through, and only the row of the smallest
    (key, tag) of each component is kept.  A ``percent`` too low for the registers is an error.
    """
    rows = materialize(_sketched(docs, key, text, shingle_words, band_of(percent), tag))
    usable = rows.where(F.col("class").isNotNull() & F.col("id").isNotNull())
    classes = materialize(
        usable.groupBy("class").agg(
            F.min("id").alias("id"),
            F.min(F.struct("id", "tag")).alias("least"),
            F.first("n").alias("n"),
            F.first("registers").alias("registers"),
            F.first("bands").alias("bands"),
        )
    )
    members = classes.select("class", F.explode("bands").alias("bucket"))
    found = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("class").alias("lead"))
    meetings = materialize(members.join(found.where(F.col("size") > 1), "bucket"))
    labels = _Labels(classes)
    met = meetings.where(F.col("class") != F.col("lead"))
    by_leader = met.groupBy(F.col("class").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("bands"))
    best = by_leader.groupBy("a").agg(F.max(F.struct("bands", "b")).alias("best")).select("a", "best.b")
    tested = materialize(best)
    if not tested.isEmpty():
        labels.merge(_links(docs, key, text, classes, tested, percent, shingle_words))
        labels.merge(_rest(docs, key, text, classes, meetings, labels, tested, percent, shingle_words))
    placed = labels.of(classes.select("class", "least"), "class", "component")
    least = placed.groupBy("component").agg(F.min("least").alias("least"))
    by_class = placed.drop("least").join(least, "component").select(
        "class", F.col("least.id").alias("component_id"), F.col("least.tag").alias("first")
    )
    found = rows.select("id", "tag", "n", "class").join(by_class, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    kept = component.eqNullSafe(F.col("id"))
    if tag is not None:
        kept = kept & (F.col("id").isNull() | F.col("first").isNull() | (F.col("first") == F.col("tag")))
    return found.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        kept.alias("kept"),
        *([] if tag is None else [F.col("tag").alias(tag)]),
    )
