"""Mixing sources to target weights by hierarchical token budgets.

Documents are leaves of a tree, domain - language - source.  Every node's budget is dealt to its children by weight;
a child that cannot use its share (its documents, repeated in at most ``max_epochs`` epochs) leaves the rest to its
siblings, and only what a whole node cannot use goes to the node's own siblings.  The budgets are whole numbers.

A leaf takes full epochs and of one more epoch the longest prefix of whole documents that fits.  Each epoch has an
order of its own, by a hash of the seed, the epoch and the key.  The prefix is found without sorting the leaf: tokens are
summed by 4096 buckets of the hash, and only the rows of the bucket in which the budget ends are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh
from millrace.session import local_table

MISSING = "(none)"
_BUCKET_BITS = 12
_KEY_BITS = 60


@dataclass(frozen=True)
class Weights:
    """Whole-number weights of names at each level; a name that is not listed has ``default``."""

    domain: Mapping[str, int] = field(default_factory=dict)
    language: Mapping[str, int] = field(default_factory=dict)
    source: Mapping[str, int] = field(default_factory=dict)
    default: int = 1

    def of(self, level: int, name: str) -> int:
        return (self.domain, self.language, self.source)[level].get(name, self.default)


def deal(budget: int, children: list[tuple[str, int, int]]) -> dict[str, int]:
    """Deal ``budget`` to (name, weight, capacity) by weight; what a child cannot use goes to the others.

    Rests of the last division (fewer tokens than children) are not dealt.  Weight 0 gets nothing.
    """
    waiting = sorted((c for c in children if c[1] > 0), key=lambda c: (Fraction(c[2], c[1]), c[0]))
    weight = sum(w for _, w, _ in waiting)
    out = {name: 0 for name, _, _ in children}
    for i, (name, w, capacity) in enumerate(waiting):
        if capacity * weight > budget * w:
            out |= {n: budget * v // weight for n, v, _ in waiting[i:]}
            break
        out[name] = capacity
        budget, weight = budget - capacity, weight - w
    return out


def budgets(supply: Mapping[tuple[str, str, str], int], weights: Weights, total: int, max_epochs: int) -> dict[tuple[str, str, str], int]:
    """Token budget of every leaf; never more than its supply times ``max_epochs``."""

    def down(path: tuple[str, ...], leaves: Mapping[tuple[str, str, str], int], budget: int) -> dict:
        level = len(path)
        if level == 3:
            return {path: min(budget, leaves[path])}
        below: dict[str, dict] = {}
        for leaf, n in leaves.items():
            below.setdefault(leaf[level], {})[leaf] = n
        shares = deal(budget, [(k, weights.of(level, k), sum(v.values())) for k, v in sorted(below.items())])
        return {leaf: n for k, v in below.items() for leaf, n in down((*path, k), v, shares[k]).items()}

    return down((), {leaf: n * max_epochs for leaf, n in supply.items()}, total)


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    """60 bits that order an epoch."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(MISSING)))
    return F.conv(F.substring(F.md5(text), 1, _KEY_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    key: Column,
    domain: Column,
    language: Column,
    source: Column,
    tokens: Column,
    weights: Weights,
    share_percent: int,
    max_epochs: int = 2,
    seed: int = 11,
    max_leaves: int = 100_000,
) -> DataFrame:
    """The chosen rows of ``docs`` with ``mix_domain``, ``mix_epoch`` (int, from 0), ``mix_tokens``, ``mix_order``.

    Weights and the budget are met in ``tokens``, whatever they count: with ``word_count`` they are words, and a text in
    a script without blanks weighs about one.  The budget is ``share_percent`` of all tokens (rounded down).  NULL names form a leaf "(none)"; NULL tokens are 0.
    A row without tokens goes with the place of its hash, and rows equal in key stand next to each other in an order
    that may vary between equal hashes only.  Columns of the four new names are replaced.  A leaf without tokens, and
    an empty table, give no rows.  ``max_leaves`` bounds the plan on the driver; more leaves are an error.
    """
    names = ["mix_domain", "mix_epoch", "mix_tokens", "mix_order"]
    kept = docs.drop(*names)
    d, lang, src, tok, epoch, bucket = (fresh(kept, f"__{x}") for x in ("domain", "language", "source", "tokens", "last", "bucket"))
    full, room, edge, start = (fresh(kept, f"__{x}") for x in ("full", "room", "edge", "start"))
    path = [d, lang, src]
    placed = kept.withColumns(
        {n: F.coalesce(c.cast("string"), F.lit(MISSING)) for n, c in zip(path, (domain, language, source), strict=True)}
    ).withColumn(tok, F.coalesce(tokens.cast("long"), F.lit(0)))
    leaves = placed.groupBy(*path).agg(F.sum(tok)).limit(max_leaves + 1).collect()
    if len(leaves) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    supply = {(r[0], r[1], r[2]): r[3] for r in leaves}
    total = sum(supply.values()) * share_percent // 100
    plan = [
        (*leaf, budget // supply[leaf], budget % supply[leaf])
        for leaf, budget in budgets(supply, weights, total, max_epochs).items()
        if supply[leaf]
    ]
    schema = ", ".join(f"`{c}` string" for c in path) + f", `{full}` int, `{room}` long"
    # At most max_leaves rows.
    planned = placed.join(F.broadcast(local_table(docs.sparkSession, plan, schema)), path)
    keyed = planned.withColumn(epoch, order_key(seed, F.col(full), key))
    keyed = keyed.withColumn(bucket, F.shiftright(F.col(epoch), _KEY_BITS - _BUCKET_BITS).cast("int"))
    held = keyed.groupBy(*path, room, bucket).agg(F.sum(tok).alias("held"))
    running = F.sum("held").over(Window.partitionBy(*path).orderBy(bucket))
    # The first bucket that the budget does not fill: one row per leaf.
    ends = (
        held.withColumn("reached", running)
        .where(F.col("reached") > F.col(room))
        .groupBy(*path)
        .agg(F.min(F.struct(F.col(bucket).alias("b"), (F.col("reached") - F.col("held")).alias("s"))).alias("e"))
        .select(*path, F.col("e.b").alias(edge), F.col("e.s").alias(start))
    )
    cut = keyed.join(F.broadcast(ends), path, "left")
    chosen = [F.col(f"`{c}`") for c in kept.columns]
    # Full epochs, and where there is room for more, the last one up to its edge.
    whole = F.col(full) + F.when((F.col(room) > 0) & (F.col(bucket) < F.col(edge)), 1).otherwise(0)
    first = cut.withColumn("mix_epoch", F.explode(_upto(whole)))
    first = first.select(
        *chosen,
        F.col(d).alias("mix_domain"),
        "mix_epoch",
        F.col(tok).alias("mix_tokens"),
        order_key(seed, F.col("mix_epoch"), key).alias("mix_order"),
    )
    inside = Window.partitionBy(*path).orderBy(epoch, key.cast("string")).rowsBetween(Window.unboundedPreceding, 0)
    last = cut.where(F.col(bucket) == F.col(edge)).withColumn("reached", F.sum(tok).over(inside) + F.col(start))
    last = last.where((F.col(room) > 0) & (F.col("reached") <= F.col(room))).select(
        *chosen,
        F.col(d).alias("mix_domain"),
        F.col(full).alias("mix_epoch"),
        F.col(tok).alias("mix_tokens"),
        F.col(epoch).alias("mix_order"),
    )
    return first.unionByName(last)


def _upto(count: Column) -> Column:
    """0 ... count-1; nothing for 0."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
