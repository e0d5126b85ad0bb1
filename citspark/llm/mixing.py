"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks.  With weight w, its j-th block is released at slot
floor((j-1)/w) and due at ceil(j/w); the released block with the earliest
deadline takes each slot.  As the weights sum to one this order misses no
deadline, so after any number of slots t each source has had more than w*t - 1
and fewer than w*t + 1 blocks.

Weights are exact: whole numbers in the ratio of the given ones.  One period of
the order, or the whole phase where it is shorter, is laid out on the driver:
work and memory follow the number of blocks, eight bytes or so a block, and a
row's slot is a look-up by its block's number.  When a source runs out a phase
ends and the others share its weight in a new one, so all rows are placed.  The
rows go through DataFrame functions only.
"""

from __future__ import annotations

import heapq
import json
import math
from array import array
from bisect import bisect_left
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_columns, dense_rank_in


@dataclass(frozen=True)
class Mix:
    """block_rows: rows a block; max_sources: bound of sources.

    shares: slots a row of the broadcast table of slots holds; the order does
        not depend on it.
    temper: without target weights a source weighs its rows to this power.
    """

    block_rows: int = 32
    shares: int = 1024
    max_sources: int = 512
    temper: float = 0.5


def whole_shares(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratio of the weights, without a common divisor."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    common = math.gcd(*whole)
    return [q // common for q in whole]


def layout(shares: list[int], left: list[int]) -> tuple[int, list[array]]:
    """Slots of each source, EDF over released blocks, and their number.

    Ends behind the last block of the first source to run out, or after a whole
    period of sum(shares) slots.  A source's next block is looked at once the one
    before has its slot: it is due later, so it never goes first.
    """
    size = sum(shares)
    slots = [array("q") for _ in shares]
    soon = [(0, i) for i in range(len(shares))]  # release and source of the next blocks
    due: list[tuple[int, int]] = []
    for t in range(size):
        while soon and soon[0][0] <= t:
            _, i = heapq.heappop(soon)
            heapq.heappush(due, (-(-(len(slots[i]) + 1) * size // shares[i]), i))
        _, i = heapq.heappop(due)
        slots[i].append(t)
        done = len(slots[i])
        if done == left[i]:
            return t + 1, slots
        heapq.heappush(soon, (done * size // shares[i], i))
    return size, slots


@dataclass(frozen=True)
class Phase:
    """A stretch of slots with one set of weights; ``slots`` repeat every sum(shares) slots."""

    start: int
    length: int
    sources: list[int]
    shares: list[int]
    slots: list[array]
    first: list[int]
    last: list[int]


def phases(blocks: list[int], weights: list[float], shares: int = 1024) -> list[Phase]:
    """Phases that place all ``blocks``; sources of weight 0 come when the others are done.

    ``shares`` has no effect: weights are not rounded to it any more.
    """
    left, at, out = list(blocks), 0, []
    while any(left):
        live = [i for i, n in enumerate(left) if n and weights[i] > 0] or [i for i, n in enumerate(left) if n]
        own = [weights[i] if weights[live[0]] > 0 else float(left[i]) for i in live]
        q = whole_shares(own)
        size = sum(q)
        end, slots = layout(q, [left[i] for i in live])
        if end == size:
            # A source runs out behind the slot of its last block; the first to do so ends the phase.
            end = min((left[i] - 1) // q[k] * size + slots[k][(left[i] - 1) % q[k]] + 1 for k, i in enumerate(live))
        used = [end // size * q[k] + bisect_left(slots[k], end % size) for k in range(len(live))]
        first = [blocks[i] - left[i] for i in live]
        out.append(Phase(at, end, live, q, slots, first, [f + u for f, u in zip(first, used)]))
        for i, u in zip(live, used):
            left[i] -= u
        at += end
    return out


#: The largest number that tables of the plan hold for shares.
_LONG = 1 << 62


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from values in the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(':'.join(c.split()) for c in schema.split(', '))}>>")))


def mix_sources(rows: DataFrame, weights: Mapping[str | None, float] | None = None, mix: Mix = Mix(), source: str = "source", order: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``rows`` with phase, slot, mix_order and share.

    mix_order sorts the mixture: slots in order, rows of a block by their place.
    Within a source rows are shuffled by a hash of the ``order`` columns, so equal
    rows are neighbours.  ``weights`` maps sources to target weights, of any
    scale; sources without one get weight 0 and come last.  A null source is a
    source of its own.  Columns that are already named like the new ones are
    replaced.  No row is dropped or repeated, an empty table stays
    empty, and more than ``max_sources`` sources are an error.  share is the
    target weight of the row's source among the sources of its phase.
    """
    check_columns(rows, source, *order)
    spark = rows.sparkSession
    counted = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).limit(mix.max_sources + 1).collect()
    if len(counted) > mix.max_sources:
        raise ValueError(f"more than {mix.max_sources} sources")
    counted = sorted(counted, key=lambda r: (r[0] is not None, r[0]))
    names, sizes = [r[0] for r in counted], [r.n for r in counted]
    goals = [float(weights.get(x, 0.0)) for x in names] if weights is not None else [n**mix.temper for n in sizes]
    plan = phases([-(-n // mix.block_rows) for n in sizes], goals, mix.shares)
    ids = _table(spark, [(i, x) for i, x in enumerate(names)], "__source int, __name string")
    # Shares beyond a long belong to periods that do not repeat: any number above the phase's blocks serves.
    spans = _table(
        spark,
        [(i, e, p.first[k], p.last[k], min(p.shares[k], _LONG), min(sum(p.shares), _LONG), p.start, p.shares[k] / sum(p.shares)) for e, p in enumerate(plan) for k, i in enumerate(p.sources)],
        "__source int, __phase int, __first long, __last long, __q long, __size long, __start long, __share double",
    )
    slots = _table(
        spark,
        [(i, e, j // mix.shares, p.slots[k][j : j + mix.shares].tolist()) for e, p in enumerate(plan) for k, i in enumerate(p.sources) for j in range(0, min(len(p.slots[k]), p.last[k] - p.first[k]), mix.shares)],
        "__source int, __phase int, __part long, __slots array<bigint>",
    )
    cells = min(1 << 14, max(16, math.ceil(max(sizes, default=0) / 50_000)))
    placed = rows.join(F.broadcast(ids), rows[source].cast("string").eqNullSafe(F.col("__name"))).drop("__name")
    placed = dense_rank_in(placed, "__source", list(order), "__place", cells, broadcast_offsets=True)
    block = F.floor(F.col("__place") / mix.block_rows)
    placed = placed.withColumn("__block", block).join(F.broadcast(spans), "__source").filter((F.col("__block") >= F.col("__first")) & (F.col("__block") < F.col("__last")))
    local = F.col("__block") - F.col("__first")
    turn = F.floor(local / F.col("__q"))
    placed = placed.withColumn("__j", (local % F.col("__q")).cast("long")).withColumn("__part", F.floor(F.col("__j") / mix.shares)).join(F.broadcast(slots), ["__source", "__phase", "__part"])
    at = F.get("__slots", (F.col("__j") % mix.shares).cast("int"))
    slot = F.col("__start") + turn * F.col("__size") + at
    placed = placed.withColumn("__slot", slot.cast("long")).withColumn("__order", (F.col("__slot") * mix.block_rows + F.col("__place") % mix.block_rows).cast("long"))
    made = {"phase": "__phase", "slot": "__slot", "mix_order": "__order", "share": "__share"}
    return placed.select(*(F.col(c) for c in rows.columns if c not in made), *(F.col(c).alias(n) for n, c in made.items()))


def mixed_order(rows: DataFrame, weights: Mapping[str | None, float] | None = None, mix: Mix = Mix(), source: str = "source", order: tuple[str, ...] = ("doc_id", "text"), place: str | None = None) -> DataFrame:
    """``rows`` sorted by mix_order, so that files written from it hold the mixture in order.

    Within a source rows are shuffled by a hash of the ``order`` columns.  All
    columns stay, whatever their names.  With ``place`` the order stays as a column of that name, for consumers that
    would deal the rows anew.
    """
    check_columns(rows, source, *order)
    own = [c for c in rows.columns if c != place]
    # The columns travel under private names: mix_sources replaces some.
    keyed = rows.select(F.xxhash64(*order).alias("__key"), F.col(source).alias("__by"), *(F.col(c).alias(f"__own_{i}") for i, c in enumerate(own)))
    placed = mix_sources(keyed, weights, mix, "__by", ("__key",))
    back = [F.col(f"__own_{i}").alias(c) for i, c in enumerate(own)]
    return placed.repartitionByRange(F.col("mix_order")).sortWithinPartitions("mix_order").select(*back, *([F.col("mix_order").alias(place)] if place else []))
