"""Balanced label propagation: linked documents move to shared shards under quotas.

Links are memberships (node, group): the members of a group are linked with each
other, so a clique of any size is as many rows as members, and a single link is
a group of two.  Each round joins nodes with their groups' counts a shard, lets
every node want the shard that holds most of its neighbours, and admits movers
by gain up to each shard's free room.  Linked nodes never fill a shard beyond
its quota; at the end the nodes without links fill all shards up, so that the
numbers of rows differ by at most one.  Fewer groups are cut each round, as a
move only happens when it gains.

All state is tables: counts for quotas are grouped first, so neither a large
group nor a shard's movers meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import check_columns, dense_rank_in, rank_by_cells, stage_table

#: Gains count in so many steps and ties in so many hash cells when quotas admit movers.
_STEPS, _CELLS = 64, 256


def _quotas(n: int, shards: int) -> list[int]:
    """Rows of each shard: sizes at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def _array(values: list[int]):
    return F.array(*(F.lit(int(v)) for v in values))


def _loads(labels: DataFrame, shards: int) -> list[int]:
    held = {r.shard: r.n for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [held.get(s, 0) for s in range(shards)]


def cut_links(links: DataFrame, labels: DataFrame) -> int:
    """Linked pairs whose ends are in different shards, by counts of each group."""
    per = links.join(labels, "node").groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return per.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.lit(0)).cast("long")).first()[0]


def propagate(links: DataFrame, total: int, shards: int, rounds: int = 4) -> DataFrame:
    """node, shard of all linked nodes; ``total`` counts the nodes without links too.

    links: node, grp, distinct.  Starts from a hash of the node, within quotas.
    """
    quotas = _quotas(total, shards)
    nodes = links.groupBy("node").agg(F.count(F.lit(1)).alias("groups"))
    start = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    labels = stage_table(_fit(nodes.select("node", start.alias("shard")), quotas), "shard-labels")
    for step in range(rounds):
        loads = _loads(labels, shards)
        room = [q - n for q, n in zip(quotas, loads)]
        moved = _moves(links, labels, room, shards, step)
        admitted = stage_table(_admit(moved, room), "shard-moves")
        if admitted.isEmpty():
            break
        to = admitted.select(F.col("node"), F.col("to"))
        labels = stage_table(labels.join(to, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "shard-labels")
    return labels


def _fit(labels: DataFrame, quotas: list[int]) -> DataFrame:
    """Labels within quotas: what is too much in a shard goes to the others' room, in order."""
    ranked = stage_table(dense_rank_in(labels, "shard", ["node"], "place"), "shard-start")
    loads = _loads(ranked, len(quotas))
    over = [max(0, n - q) for n, q in zip(loads, quotas)]
    if not any(over):
        return ranked.select("node", "shard")
    before, ends, so_far = [], [], 0
    for extra in over:
        before.append(so_far)
        so_far += extra
    so_far = 0
    for n, q in zip(loads, quotas):
        so_far += max(0, q - n)
        ends.append(so_far)
    late = F.col("place") >= F.get(_array(quotas), F.col("shard"))
    turn = F.get(_array(before), F.col("shard")) + F.col("place") - F.get(_array(quotas), F.col("shard"))
    free = F.size(F.filter(_array(ends), lambda e: e <= turn))
    return ranked.select("node", F.when(late, free).otherwise(F.col("shard")).cast("int").alias("shard"))


def _moves(links: DataFrame, labels: DataFrame, room: list[int], shards: int, step: int) -> DataFrame:
    """node, to, gain: where nodes want to be, among shards with room."""
    placed = links.join(labels, "node")
    counts = placed.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    # A group's counts: one array of ``shards`` numbers.
    votes = counts.groupBy("grp").agg(*(F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(shards)))
    per = placed.join(votes, "grp").groupBy("node", "shard").agg(*(F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)), F.count(F.lit(1)).alias("own"))
    here = F.get(F.array(*(f"n{s}" for s in range(shards))), F.col("shard")) - F.col("own")
    best = F.greatest(*(F.struct(F.col(f"n{s}").alias("n"), F.lit(-s).alias("s")) for s in range(shards) if room[s] > 0)) if sum(r > 0 for r in room) > 1 else None
    if best is None:
        open_ = [s for s in range(shards) if room[s] > 0]
        best = F.struct(F.col(f"n{open_[0]}").alias("n"), F.lit(-open_[0]).alias("s")) if open_ else F.struct(F.lit(-1).cast("long").alias("n"), F.lit(0).alias("s"))
    wish = per.select("node", "shard", (-best["s"]).alias("to"), (best["n"] - here).alias("gain"))
    return wish.filter((F.col("gain") > 0) & (F.col("to") != F.col("shard")))


def _admit(moves: DataFrame, room: list[int]) -> DataFrame:
    """The movers of largest gain that each shard has room for.

    Cells of (gain step, hash) are counted and admitted whole in order while
    they fit; the first that does not fit is admitted in part, by rank within
    that one small cell.
    """
    bucket = F.lit(_STEPS) - F.least(F.lit(_STEPS), F.ceil(F.log2(F.col("gain") + 1) * 4)).cast("int")
    celled = moves.withColumn("cell", (bucket * _CELLS + F.pmod(F.xxhash64("node"), F.lit(_CELLS))).cast("int"))
    counts = celled.groupBy("to", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("to").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("first") < F.get(_array([max(0, r) for r in room]), F.col("to")))
    joined = celled.join(offsets, ["to", "cell"])
    local = joined.withColumn("place", F.row_number().over(Window.partitionBy("to", "cell").orderBy("node")) - 1 + F.col("first"))
    return local.filter(F.col("place") < F.get(_array([max(0, r) for r in room]), F.col("to"))).select("node", "to")


def _in_order(placed: DataFrame, order: str, total: int, cells: int) -> DataFrame:
    """``placed`` with slot: gapless from 0 in each shard, by ``order`` and then node.

    Cells are ranges of equal width of the order, so no task sorts a whole shard.
    """
    low, high = placed.agg(F.min(order), F.max(order)).first() if total else (0, 0)
    width = (high - low) // cells + 1
    celled = placed.withColumn("__cell", F.floor((F.col(order) - low) / width).cast("int"))
    return rank_by_cells(celled, "shard", "__cell", [order, "node"], "slot", "__slot_offset")


def assign_shards(rows: DataFrame, links: DataFrame, shards: int = 8, rounds: int = 4, order: str | None = None) -> DataFrame:
    """``rows`` (with a unique ``node``) with shard and slot; sizes at most one apart.

    links: node, grp.  Groups of one node link nothing.  slot is gapless from 0
    in each shard: by a hash of the node, or by the long column ``order`` where
    one is named.  Empty tables give empty results.
    """
    check_columns(rows, "node")
    check_columns(links, "node", "grp")
    links = links.filter(F.col("grp").isNotNull()).select("node", "grp").distinct()
    shared = links.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp")
    links = stage_table(links.join(shared, "grp", "left_semi"), "shard-links")
    total = rows.count()
    labels = propagate(links, total, shards, rounds)
    quotas, loads = _quotas(total, shards), _loads(labels, shards)
    ends, so_far = [], 0
    for q, n in zip(quotas, loads):
        so_far += q - n
        ends.append(so_far)
    cells = max(16, math.ceil(total / 50_000))
    alone = rows.select("node").join(labels, "node", "left_anti").withColumn("__all", F.lit(0))
    filled = dense_rank_in(alone, "__all", ["node"], "place", cells).select("node", F.size(F.filter(_array(ends), lambda e: e <= F.col("place"))).cast("int").alias("shard"))
    placed = stage_table(labels.select("node", "shard").unionByName(filled), "shard-placed")
    if order is None:
        slotted = dense_rank_in(placed, "shard", ["node"], "slot", cells)
    else:
        slotted = _in_order(placed.join(rows.select("node", order), "node"), order, total, cells)
    return rows.join(slotted.select("node", "shard", "slot"), "node")


def _keyed(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__id`` and ``__grp``: equal texts have equal groups."""
    text = F.col("text")
    group = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("n"))
    return documents.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__grp", group)


def _numbered(keyed: DataFrame, repeats: bool, order: str | None = None, name: str = "node") -> DataFrame:
    """``name``: unique for each row; rows equal in id and text are numbered, by ``order`` where it is named."""
    copy = F.row_number().over(Window.partitionBy("__id", "__grp").orderBy(order or "__id")) if repeats else F.lit(1)
    return keyed.withColumn("__copy", copy).withColumn(name, F.struct("__id", "__grp", "__copy")).drop("__copy")


def _repeats(keyed: DataFrame) -> bool:
    return not keyed.groupBy("__id", "__grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def shard_documents(documents: DataFrame, shards: int = 8, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document.

    Documents with equal texts are linked (null texts with each other), so
    copies share a shard while it has room.  The law is ``rows``: numbers of
    rows differ by at most one, whatever the sizes.  Equal rows are told apart
    by a number; rows with null ids are placed like others.
    """
    check_columns(documents, "doc_id", "text")
    text = F.col("text")
    rows = _keyed(documents).select(
        "__id",
        "__grp",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text.cast("binary"), F.lit("").cast("binary"))).alias("text_crc32"),
    )
    rows = stage_table(_numbered(rows, _repeats(rows)), "shard-rows")
    placed = assign_shards(rows, rows.select("node", F.col("__grp").alias("grp")), shards, rounds)
    return placed.select(F.col("__id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(documents: DataFrame, shards: int = 8, rounds: int = 4, order: str | None = None) -> DataFrame:
    """``documents`` with shard and slot, by the same rules; all columns stay.

    With ``order``, a column of longs, the slots of each shard follow it.  Columns
    that are already named shard or slot are replaced.
    """
    check_columns(documents, "doc_id", "text", *([order] if order else []))
    keyed = _keyed(documents)
    orders = [F.col(order).alias("__order")] if order else []
    slim = stage_table(keyed.select("__id", "__grp", *orders), "shard-keys")
    repeats = _repeats(slim)
    nodes = _numbered(slim, repeats, order and "__order")
    placed = assign_shards(nodes.select("node", *(["__order"] if order else [])), nodes.select("node", F.col("__grp").alias("grp")), shards, rounds, order and "__order")
    whole = _numbered(keyed, repeats, order, "__node")
    found = placed.select(F.col("node").alias("__node"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    kept = [c for c in documents.columns if c not in ("shard", "slot")]
    return whole.join(found, "__node").select(*kept, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
