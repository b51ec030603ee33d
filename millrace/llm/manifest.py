"""Merkle manifest of a table, its leaves placed by the ranks of their ids in bitmaps.

Per group, the ids become 64-bit bitmap words; only words that hold an id are kept, and each word is merged from all
partitions by an aggregation.  A popcount directory of three levels (words, boxes of 2**20 words, halls of 2**20 boxes)
holds how many rows lie before each word, so a row's slot is one lookup: rows before its word plus the bits below its
own.  Nothing is sorted as a whole; a window sees at most 2**20 directory rows.

Slots are the coordinates of the tree.  512 neighbouring slots meet in one array, which is reduced by three levels of
eight at once; so a tree over 10**12 leaves takes five rounds.  On the way back every array hands the siblings above
it to its leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import record_id
from millrace.session import materialize

FAN_OUT = 8
_ROUND_LEVELS = 3
_ROUND = FAN_OUT**_ROUND_LEVELS
_DIRECTORY_BITS = 20
_NO_ID = -(1 << 62)  # bitmap word of rows without an id: before all others
_MOST_LEVELS = 21  # 8**21 is above 2**62
_CHUNK = 4096  # copies of one row that a task writes at a time
_WINDOW_GROUPS = 100_000
PATH = "array<struct<left: string, right: string>>"


def record_bytes(columns: Sequence[Column]) -> Column:
    """All values in one text: ``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of a record as 32 bytes."""
    return F.unhex(F.sha2(record_bytes(columns), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def slots(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` (group, key, leaf, other; none of the names below) with ``slot`` from 0 within its group and ``size``, the rows of the group.

    Ascending by key, NULL first; rows of one key ascend by leaf.  Rows may be repeated.
    """
    word = F.coalesce(F.shiftright(F.col(key).cast("long"), 6), F.lit(_NO_ID))
    bit = F.coalesce(F.col(key).cast("long").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    placed = rows.withColumn("word", word).withColumn("bit", bit)
    ids = placed.groupBy(group, "word", "bit").agg(F.count(F.lit(1)).alias("c"))
    mask = F.expr("shiftleft(1L, bit)")
    words = materialize(
        ids.groupBy(group, "word").agg(
            F.bit_or(mask).alias("mask"),
            F.sum("c").alias("n"),
            F.collect_list(F.when(F.col("c") > 1, F.struct("bit", "c"))).alias("extra"),  # of at most 64 ids
        )
    )
    found = placed.join(_directory(words, group), [group, "word"])
    below = F.expr("bit_count(mask & ~shiftleft(-1L, bit))").cast("long")
    more = F.expr("aggregate(filter(extra, e -> e.bit < bit), 0L, (a, e) -> a + e.c - 1L)")
    copies = F.expr("aggregate(filter(extra, e -> e.bit = bit), 1L, (a, e) -> e.c)")
    found = found.withColumn("slot", F.col("before") + below + more)
    if words.where(F.size("extra") > 0).isEmpty():
        return found.select(*rows.columns, "slot", "size")
    found = found.withColumn("copies", copies)
    single = found.where(F.col("copies") == 1).select(*rows.columns, "slot", "size")
    tied = found.where(F.col("copies") > 1)
    return single.unionByName(_ties(tied, rows.columns, [group, "word", "bit"]))


def _directory(words: DataFrame, group: str) -> DataFrame:
    """Bitmap words with ``before``, the rows of the group in smaller words, and ``size``, all rows of the group."""

    def before(part: Sequence[str], order: str) -> Column:
        window = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0).cast("long"))

    boxed = words.withColumn("box", F.shiftright("word", _DIRECTORY_BITS))
    boxes = boxed.groupBy(group, "box").agg(F.sum("n").alias("n"))
    boxes = boxes.withColumn("hall", F.shiftright("box", _DIRECTORY_BITS))
    halls = boxes.groupBy(group, "hall").agg(F.sum("n").alias("n"))
    halls = halls.select(
        group, "hall", before([group], "hall").alias("above"), F.sum("n").over(Window.partitionBy(group)).alias("size")
    )
    boxes = boxes.withColumn("inside", before([group, "hall"], "box")).join(halls, [group, "hall"])
    boxes = boxes.select(group, "box", (F.col("above") + F.col("inside")).alias("above"), "size")
    boxed = boxed.withColumn("inside", before([group, "box"], "word")).join(boxes, [group, "box"])
    return boxed.select(
        group, "word", "mask", "extra", (F.col("above") + F.col("inside")).alias("before"), "size"
    )


def _ties(tied: DataFrame, columns: Sequence[str], at: Sequence[str]) -> DataFrame:
    """Rows of repeated ids, ordered by leaf: counted by the first 16 bits of it, then within these.

    Equal rows are counted, not listed, and written out again in chunks that many tasks share.
    """
    cell = F.conv(F.substring(F.hex("leaf"), 1, 4), 16, 10).cast("int")
    distinct = tied.groupBy(*columns, "word", "bit", "slot", "size").agg(F.count(F.lit(1)).alias("k"))
    distinct = materialize(distinct.withColumn("cell", cell))

    def before(part: Sequence[str], *order: str) -> Column:
        window = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("k").over(window), F.lit(0).cast("long"))

    cells = distinct.groupBy(*at, "cell").agg(F.sum("k").alias("k"))
    cells = cells.select(*at, "cell", before(at, "cell").alias("above"))
    others = [c for c in columns if c not in (*at, "leaf")]
    ranked = distinct.withColumn("inside", before([*at, "cell"], "leaf", *others)).join(cells, [*at, "cell"])
    first = ranked.withColumn("slot", F.col("slot") + F.col("above") + F.col("inside"))
    chunks = first.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (k - 1L) div {_CHUNK})")))
    chunks = chunks.repartition("slot", "chunk")
    each = F.expr(f"sequence(chunk * {_CHUNK}, least(k, (chunk + 1L) * {_CHUNK}) - 1L)")
    return chunks.withColumn("step", F.explode(each)).select(
        *columns, (F.col("slot") + F.col("step")).alias("slot"), "size"
    )


def _levels(size: Column) -> Column:
    """Levels of hashes over ``size`` leaves: 0 for one leaf."""
    total = F.lit(0)
    for k in range(_MOST_LEVELS):
        total = total + (size > FAN_OUT**k).cast("int")
    return total


def _round(nodes: DataFrame, group: str, at: int) -> DataFrame:
    """Arrays of up to 512 neighbours with the levels above them; ``top`` is the highest node of each.

    ``nodes``: group, levels (of the whole tree), slot, item (struct whose ``digest`` is 32 bytes).
    """
    arrays = nodes.groupBy(group, "levels", F.expr(f"slot div {_ROUND}").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("slot", "item"))).alias("items")
    )
    arrays = arrays.withColumn("steps", F.least(F.lit(_ROUND_LEVELS), F.col("levels") - _ROUND_LEVELS * at))
    arrays = arrays.withColumn("h0", F.transform("items", lambda x: _hex(x["item"]["digest"])))
    for k in range(1, _ROUND_LEVELS + 1):
        runs = F.sequence(F.lit(0), F.expr(f"cast((size(h{k - 1}) - 1) div {FAN_OUT} as int)"))
        joined = F.transform(runs, _hash_of_run(F.col(f"h{k - 1}")))
        arrays = arrays.withColumn(f"h{k}", F.when(F.col("steps") >= k, joined))
    top = F.element_at(F.element_at(F.array("h0", "h1", "h2", "h3"), F.col("steps") + 1), 1)
    return materialize(arrays.withColumn("top", top).drop("h3"))


def _hash_of_run(h: Column) -> Callable[[Column], Column]:
    return lambda i: F.sha2(F.array_join(F.slice(h, i * FAN_OUT + 1, FAN_OUT), ""), 256)


def _step(level: int) -> Column:
    """Siblings of node ``i`` of the array at this level, those before it and those after it."""
    place = F.expr(f"i div {FAN_OUT**level}")
    inside = F.pmod(place, F.lit(FAN_OUT)).cast("int")
    h = F.col(f"h{level}")
    return F.struct(
        F.array_join(F.slice(h, (place - inside + 1).cast("int"), inside), "").alias("left"),
        F.array_join(F.slice(h, (place + 2).cast("int"), FAN_OUT - 1 - inside), "").alias("right"),
    )


def _up(nodes: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of every round over ``nodes`` (group, size, slot, item), and (group, top) of every group."""
    nodes = nodes.withColumn("levels", _levels(F.col("size"))).drop("size")
    rounds = [_round(nodes, group, 0)]
    most = rounds[0].agg(F.max("levels")).first()[0] or 0
    while len(rounds) * _ROUND_LEVELS < most:
        risen = rounds[-1].where(F.col("levels") > len(rounds) * _ROUND_LEVELS)
        item = F.struct(F.unhex("top").alias("digest"))
        rounds.append(_round(risen.select(group, "levels", F.col("chunk").alias("slot"), item.alias("item")), group, len(rounds)))
    return rounds, reduce(DataFrame.unionByName, [_ended(arrays, at).select(group, "top") for at, arrays in enumerate(rounds)])


def _ended(arrays: DataFrame, at: int) -> DataFrame:
    """Of the arrays of a round those that hold a group's top."""
    return arrays.where(F.col("levels") <= _ROUND_LEVELS * (at + 1))  # a round holds no groups that ended before it


def _down(rounds: Sequence[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """(group, item, path) of every leaf; ``above`` (group, path) is what lies over each group's top."""
    path = None
    for at in reversed(range(len(rounds))):
        arrays = rounds[at]
        ends = _ended(arrays, at).select(group, "chunk").join(above, group)
        suffix = ends if path is None else ends.unionByName(path)
        own = F.slice(F.array(*[_step(k) for k in range(_ROUND_LEVELS)]), F.lit(1), F.col("steps"))
        each = arrays.join(suffix.withColumnRenamed("path", "upper"), [group, "chunk"])
        each = each.select("*", F.posexplode("items").alias("i", "node"))
        full = F.concat(own, "upper").alias("path")
        if at:
            path = each.select(group, F.col("node.slot").alias("chunk"), full)
        else:
            return each.select(group, "node.item", full)
    raise ValueError("no rounds")


def merkle_paths(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` (group, key, leaf, other columns) with ``subroot``, ``root`` and ``path``.

    Leaves of a group ascend by key, NULL first, equal keys by leaf; every eight nodes become one until one is left,
    the subroot.  Subroots, ordered by group (NULL first, else by UTF-8 bytes), give the root in the same way.
    ``path`` lists the siblings level by level from the leaf to the root.  An empty table has no rows and no root.
    """
    others = [c for c in rows.columns if c not in (group, key, "leaf")]
    tree = rows.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("!")).alias("g"),
        F.col(key).alias("key"),
        "leaf",
        F.struct(F.col(group).alias("group"), *others).alias("other"),
    )
    item = F.struct(F.col("leaf").alias("digest"), "key", "other").alias("item")
    rounds, tops = _up(slots(tree, "g", "key").select("g", "size", "slot", item), "g")
    tops = materialize(tops)
    count = tops.count()
    if count <= _WINDOW_GROUPS:
        ordered = tops.withColumn("slot", F.row_number().over(Window.orderBy("g")).cast("long") - 1)
    else:
        ordered = record_id(tops, "slot", ["g"], start=0)
    item = F.struct(F.unhex("top").alias("digest"), "g").alias("item")
    upper = ordered.select(F.lit("").alias("all"), F.lit(count).cast("long").alias("size"), "slot", item)
    upper_rounds, root = _up(upper, "all")
    nothing = root.select("all", F.array().cast(PATH).alias("path"))
    over = _down(upper_rounds, "all", nothing).select(
        F.col("item.g").alias("g"), _hex(F.col("item.digest")).alias("subroot"), "path"
    )
    top = root.first()
    over = materialize(over.withColumn("root", F.lit(top["top"] if top else None).cast("string")))
    found = _down(rounds, "g", over.select("g", "path"))
    found = found.join(over.select("g", "subroot", "root"), "g")
    return found.select(
        F.col("item.other.group").alias(group),
        F.col("item.key").alias(key),
        F.col("item.digest").alias("leaf"),
        *[F.col(f"item.other.{c}").alias(c) for c in others],
        "subroot",
        "root",
        "path",
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (32 bytes) gives with the siblings of ``path``."""
    return F.aggregate(path, _hex(leaf), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from below, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checked_manifest(
    docs: DataFrame, group: str, key: str, fields: Sequence[str], changed: dict[str, Column], where: Column
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Leaves hash ``fields`` in order.  Rows where ``where`` is true are checked as if ``changed`` stood for their
    fields, all others as they are; NULL counts as false.  Repeated rows have one leaf each.
    """
    altered = F.when(where, leaf_hash([changed.get(c, F.col(f"`{c}`")) for c in fields]))
    rows = docs.select(
        F.col(f"`{group}`").cast("string").alias("group"),
        F.col(f"`{key}`").cast("long").alias("key"),
        leaf_hash([F.col(f"`{c}`") for c in fields]).alias("leaf"),
        altered.alias("altered"),
    )
    rows = rows.withColumn("altered", F.when(F.col("altered") != F.col("leaf"), F.col("altered")))
    found = merkle_paths(materialize(rows), "group", "key")
    result = found.select(
        F.col("key").alias(key),
        _hex(F.col("leaf")).alias("leaf"),
        "subroot",
        "root",
        proof_hash(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _CAPITALS, _CAPITALS.lower())
