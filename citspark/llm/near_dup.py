"""MinHash near-dedup: SuperMinHash, banding, verification, components.

1. One pass over the texts gives each row its shingle set's size and hash, a
   SuperMinHash signature in eight bits a component, and band keys.  Rows of
   equal sets collapse to the one with the smallest id, so groups of exact
   copies of any size cost one grouped count.
2. Within a band key every member is paired with the smallest one.  A group of
   n near copies gives n pairs, not n squared.  Pairs are verified on full sets.
   The same then happens with each key's most central member.
3. What these links leave unconnected under one band key goes by shingles.  A
   shingle counts for a member only if a member of another component holds it
   too.  Two members that share a *rare* one (fewer than ``rare`` holders) meet
   there, if it is early enough in both sets' order of frequency; the others can
   share frequent ones only, so both need enough of these, and the few that have
   them are compared across components, in blocks of bounded size.  Both rules
   are exact bounds of the overlap: no candidate pair that could be similar
   enough is skipped, and members that can reach nobody make no pairs at all.
4. Components by contraction: labels, links and joins stay distributed.

Two sets of similarity 0.8 share no key of ``bands`` x ``rows`` = 40 x 5 with a
probability of about 1e-7; estimates reject a true pair of step 3 with 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, stage_table
from .shingles import band_keys, jaccard_at_least, shingle_set, super_minhash


@dataclass(frozen=True)
class NearDup:
    """Parameters: shingle length, percent of similarity, signature shape.

    estimate: signature similarity below which a residual pair is not verified.
    block: members of one key that meet in one task, at most twice that.
    rare: holders from which on a shingle is frequent; bounds the pairs that a
        member gets from one shingle.
    salt_rows: members of one leader that are verified in one group.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    estimate: float = 0.65
    block: int = 256
    rare: int = 64
    salt_rows: int = 2000


def signatures(documents: DataFrame, p: NearDup) -> DataFrame:
    """doc_id, text_key, n_shingles, set_hash, sig, keys of each row with an id."""

    def of(ids: list, keys: list, texts: list) -> pd.DataFrame:
        sets = [shingle_set(t, p.shingle) for t in texts]
        sig = super_minhash(sets, p.bands * p.rows)
        bands, low = band_keys(sig, p.rows), sig.astype(np.uint8)
        some = [len(s) > 0 for s in sets]
        return pd.DataFrame(
            {
                "doc_id": ids,
                "text_key": keys,
                "n_shingles": [len(s) for s in sets],
                "set_hash": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if x else None for s, x in zip(sets, some)],
                "sig": [r.tobytes() if x else None for r, x in zip(low, some)],
                "keys": [r if x else None for r, x in zip(bands, some)],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys, texts, size = [], [], [], 0
            for i, k, t in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                ids.append(int(i))
                keys.append(int(k))
                texts.append(t)
                size += len(t or "")
                if size > 1_000_000 or len(ids) >= 1000:
                    yield of(ids, keys, texts)
                    ids, keys, texts, size = [], [], [], 0
            if ids:
                yield of(ids, keys, texts)

    rows = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInPandas(run, "doc_id long, text_key long, n_shingles long, set_hash binary, sig binary, keys array<long>")


def _streams(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that follow each other, over batch borders."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        change = (batch[by] != batch[by].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(change)
        if held and (batch[by].iloc[0] == held[-1][by].iloc[-1]).all():
            starts = starts[1:]
            cuts = [0, *starts, len(batch)]
        else:
            if held:
                yield pd.concat(held, ignore_index=True)
                held = []
            cuts = [*starts, len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.iloc[a:b])
            if b < len(batch):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)


#: Longs of the bitmap that is sent to all tasks: 2 MB, however many nodes it marks.
_WORDS = 1 << 18


def _bitmap(nodes: DataFrame) -> DataFrame:
    """One row: ``bits``, an array of longs with a bit set for each node's hash."""
    h = F.xxhash64("id", "key")
    marked = nodes.select(F.pmod(F.shiftright(h, 6), F.lit(_WORDS)).cast("int").alias("word"), F.expr("shiftleft(1L, cast(xxhash64(id, key) & 63 as int))").alias("bit"))
    words = marked.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = nodes.sparkSession.range(_WORDS).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda x: x["bits"]).alias("bits"))


def _in_bitmap(bits: Column, h: Column) -> Column:
    word = F.get(bits, F.pmod(F.shiftright(h, 6), F.lit(_WORDS)).cast("int"))
    place = h.bitwiseAND(F.lit(63)).cast("int")
    return F.pmod(F.call_function("shiftright", word, place), F.lit(2)) == 1


def _texts_of(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """id, key, text of the documents named by ``nodes`` (id, key), once each.

    Most documents are in no pair: a bitmap of fixed size drops nearly all of
    them before their texts move; the join then decides.
    """
    nodes = stage_table(nodes, "neardup-nodes")
    bits = stage_table(_bitmap(nodes), "neardup-bitmap")
    texts = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
    texts = texts.withColumn("__bits", bits.scalar()).filter(_in_bitmap(F.col("__bits"), F.xxhash64("id", "key"))).drop("__bits")
    return texts.join(nodes, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])


def verify(pairs: DataFrame, documents: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, a_key, b, b_key) whose full shingle sets are similar enough.

    The text of ``a`` meets those of its partners in groups of about
    ``salt_rows``; a task holds one set of ``a`` and one partner at a time.
    """
    per = pairs.groupBy("a", "a_key").agg(F.ceil(F.count(F.lit(1)) / p.salt_rows).cast("int").alias("salts"))
    nodes = pairs.select(F.col("a").alias("id"), F.col("a_key").alias("key")).union(pairs.select("b", "b_key")).distinct()
    texts = stage_table(_texts_of(nodes, documents), "neardup-texts")
    members = pairs.join(per, ["a", "a_key"]).withColumn("salt", F.pmod(F.xxhash64("b", "b_key"), F.col("salts")).cast("int"))
    members = members.join(texts, (F.col("b") == F.col("id")) & (F.col("b_key") == F.col("key")))
    leaders = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(texts, (F.col("a") == F.col("id")) & (F.col("a_key") == F.col("key")))
    columns = lambda role: ("a", "a_key", "salt", F.lit(role).alias("role"), "id", "key", "text")
    rows = leaders.select(*columns(0)).unionByName(members.select(*columns(1)))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, leader = None, None
        for batch in batches:
            out = []
            for a, a_key, role, i, k, text in zip(batch["a"], batch["a_key"], batch["role"], batch["id"], batch["key"], batch["text"]):
                s = shingle_set(text, p.shingle)
                if role == 0:
                    own, leader = s, (a, a_key)
                elif leader == (a, a_key) and jaccard_at_least(own, s, p.percent):
                    out.append((a, i))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    dealt = rows.repartition("a", "a_key", "salt").sortWithinPartitions("a", "a_key", "salt", "role")
    return dealt.mapInPandas(check, "a long, b long")


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """node, label: the smallest node that each node with a link can reach.

    Each round maps nodes to their smallest neighbour, follows that map a few
    steps, and contracts the links; rounds end when no link is left.
    """
    edges = stage_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    total: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
        step = stage_table(step, "cc-step")
        for _ in range(jumps):
            to = step.select(F.col("node").alias("label"), F.col("label").alias("__to"))
            step = step.join(to, "label", "left").select("node", F.coalesce("__to", "label").alias("label"))
        step = stage_table(step, "cc-jumped")
        go = lambda name, s=step: s.select(F.col("node").alias(name), F.col("label").alias(f"{name}_to"))
        edges = stage_table(edges.join(go("a"), "a").join(go("b"), "b").select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).filter("a <> b").distinct(), "cc-edges")
        if total is None:
            total = step
        else:
            total = stage_table(total.join(step.select(F.col("node").alias("label"), F.col("label").alias("__to")), "label", "left").select("node", F.coalesce("__to", "label").alias("label")), "cc-labels")
    return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _medoids(members: DataFrame, p: NearDup, partitions: int) -> DataFrame:
    """Pairs of each member with its key's likeliest centre, across components.

    Near copies of one original may be too far from each other, and from the
    smallest of them, yet near the original.  In blocks of about ``block`` members
    the one whose signature is near most others is found; the best of a key's
    blocks meets all members, so a key of n members gives at most n pairs.
    """
    sizes = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("blocks"))
    rows = members.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("rep", "rep_key"), F.col("blocks")).cast("int"))

    def central(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in _streams(batches, ["band", "own"]):
            sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(len(g), -1)
            near = [int(((sig == s).mean(axis=1) >= p.percent / 100 - 0.05).sum()) for s in sig]
            k = int(np.argmax(near))
            out.append((g["band"].iloc[0], near[k], g["rep"].iloc[k], g["rep_key"].iloc[k], g["comp"].iloc[k]))
        yield pd.DataFrame(out, columns=["band", "near", "a", "a_key", "a_comp"]).astype("int64")

    slim = rows.select("band", "own", "rep", "rep_key", "comp", "sig").repartition(partitions, "band", "own").sortWithinPartitions("band", "own", "rep", "rep_key")
    found = slim.mapInPandas(central, "band long, near long, a long, a_key long, a_comp long")
    best = found.groupBy("band").agg(F.max(F.struct("near", "a", "a_key", "a_comp")).alias("m"))
    pairs = members.select("band", "rep", "rep_key", "comp").join(best, "band").filter(F.col("comp") != F.col("m.a_comp"))
    return pairs.select(F.col("m.a").alias("a"), F.col("m.a_key").alias("a_key"), F.col("rep").alias("b"), F.col("rep_key").alias("b_key")).distinct()


def _crossing(members: DataFrame, labels: DataFrame, own: DataFrame) -> DataFrame:
    """Members of keys that more than one component is under, with component and signature."""
    left = members.select("band", "rep", "rep_key").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("comp", F.coalesce("label", "rep"))
    crossing = left.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band")
    signed = own.select(F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key"), "n_shingles", "sig")
    return left.join(crossing, "band", "left_semi").join(signed, ["rep", "rep_key"])


def _shared_shingles(nodes: DataFrame, documents: DataFrame, p: NearDup) -> DataFrame:
    """rep, rep_key, comp, n, core, rare of each of ``nodes`` (rep, rep_key, comp).

    n: size of the set; core: its shingles with at least ``p.rare`` holders among
    the nodes; rare: (pos, s) of those with fewer.  Only shingles that nodes of
    several components hold count; pos is a shingle's place when the set is
    ordered by holders, the ones that do not count first, so a set shares at
    most n - pos shingles with any set of which s is the first common one.
    """
    texts = _texts_of(nodes.select(F.col("rep").alias("id"), F.col("rep_key").alias("key")), documents)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                b = batch.iloc[lo : lo + 500]
                sets = [shingle_set(t, p.shingle).view(np.int64) for t in b["text"]]
                yield pd.DataFrame({"rep": b["id"].to_numpy(), "rep_key": b["key"].to_numpy(), "n": [len(x) for x in sets], "s": sets})

    sets = texts.mapInPandas(cut, "rep long, rep_key long, n long, s array<long>").join(nodes, ["rep", "rep_key"])
    each = stage_table(sets.select("rep", "rep_key", "comp", "n", F.explode("s").alias("s")), "neardup-shingles")
    held = each.groupBy("s").agg(F.count(F.lit(1)).alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("s", "f")
    tagged = each.join(held, "s")
    rare = F.sort_array(F.collect_list(F.when(F.col("f") < p.rare, F.struct("f", "s"))))
    per = tagged.groupBy("rep", "rep_key", "comp", "n").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("f") >= p.rare).alias("core"), rare.alias("r"))
    placed = F.transform("r", lambda x, i: F.struct((F.col("n") - F.col("m") + i).alias("pos"), x["s"].alias("s")))
    # A similar set shares at least percent of n: later places cannot be the first common one.
    early = F.filter(placed, lambda x: 100 * (F.col("n") - x["pos"]) >= p.percent * F.col("n"))
    return per.select("rep", "rep_key", "comp", "n", "core", early.alias("rare"))


def _enough(shared: Column, n: Column, m: Column, p: NearDup) -> Column:
    """Whether sets of sizes n and m are similar enough if they share ``shared``."""
    return (100 + p.percent) * shared >= p.percent * (n + m)


def _by_rare(shared: DataFrame, p: NearDup) -> DataFrame:
    """Pairs of different components that meet at a rare shingle and may be similar enough."""
    each = shared.select("rep", "rep_key", "comp", "n", F.explode("rare").alias("x")).select("rep", "rep_key", "comp", "n", "x.pos", "x.s")
    a, b = each.alias("a"), each.alias("b")
    order = F.struct("a.rep", "a.rep_key") < F.struct("b.rep", "b.rep_key")
    reach = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    on = (F.col("a.s") == F.col("b.s")) & (F.col("a.comp") != F.col("b.comp")) & order & _enough(reach, F.col("a.n"), F.col("b.n"), p)
    return a.join(b, on).select(F.col("a.rep").alias("a"), F.col("a.rep_key").alias("a_key"), F.col("b.rep").alias("b"), F.col("b.rep_key").alias("b_key")).distinct()


def _by_core(members: DataFrame, shared: DataFrame, p: NearDup, partitions: int) -> DataFrame:
    """Candidate pairs of different components under one key that share no rare shingle.

    Such a pair shares at most the smaller ``core``, which bounds each member and
    each pair; the rest go by signature.  Pairs within a component are known to
    belong together, so a key's largest component only meets the key's other
    members: its rows stay where they are, in blocks of about ``block``, and the
    others come to each block.  The others meet each other in pairs of blocks.
    """
    able = shared.filter(100 * F.col("core") >= p.percent * F.col("n")).select("rep", "rep_key", "n", "core")
    members = members.drop("n_shingles").join(able, ["rep", "rep_key"])
    per = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"))
    keys = per.groupBy("band").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    blocks = lambda n: F.ceil(n / p.block).cast("int")
    keys = keys.select("band", F.col("top.comp").alias("top"), blocks(F.col("top.k")).alias("tops"), blocks(F.col("all") - F.col("top.k")).alias("rests"))
    rows = members.join(keys, "band").withColumn("main", F.col("comp") == F.col("top"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", "rep_key"), F.when(F.col("main"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    cell = lambda first, lo, hi: F.struct(first.alias("first"), lo.alias("lo"), hi.alias("hi"))
    none = F.lit(0)
    at_top = F.transform(F.sequence(none, F.col("tops") - 1), lambda b: cell(F.lit(True), b, none))
    at_rest = F.transform(F.sequence(none, F.col("rests") - 1), lambda b: cell(F.lit(False), F.least("own", b), F.greatest("own", b)))
    cells = F.when(F.col("main"), F.array(cell(F.lit(True), F.col("own"), none))).otherwise(F.concat(at_top, at_rest))
    rows = rows.withColumn("cell", F.explode(cells)).select("band", "cell.*", "main", "own", "rep", "rep_key", "comp", "n", "core", "sig")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for g in _streams(batches, ["band", "first", "lo", "hi"]):
            comp, size, core = (g[c].to_numpy() for c in ("comp", "n", "core"))
            first = bool(g["first"].iloc[0])
            # Sides that meet here: main and others, or two blocks.
            side = (g["main"] if first else g["own"]).to_numpy()
            cross = first or g["lo"].iloc[0] != g["hi"].iloc[0]
            sig = None
            for i in range(len(g) - 1):
                rest = np.arange(i + 1, len(g))
                ok = (comp[rest] != comp[i]) & ((100 + p.percent) * np.minimum(core[rest], core[i]) >= p.percent * (size[rest] + size[i]))
                if cross:
                    ok &= side[rest] != side[i]
                rest = rest[ok]
                if len(rest):
                    sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(len(g), -1) if sig is None else sig
                    rest = rest[(sig[rest] == sig[i]).mean(axis=1) >= p.estimate]
                if len(rest):
                    a = g.iloc[[i] * len(rest)][["rep", "rep_key"]].to_numpy()
                    b = g.iloc[rest][["rep", "rep_key"]].to_numpy()
                    swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
                    a[swap], b[swap] = b[swap], a[swap]
                    out.append(np.hstack([a, b]))
                    held += len(rest)
            if held > 50_000:
                yield pd.DataFrame(np.vstack(out), columns=["a", "a_key", "b", "b_key"])
                out, held = [], 0
        if out:
            yield pd.DataFrame(np.vstack(out), columns=["a", "a_key", "b", "b_key"])

    dealt = rows.repartition(partitions, "band", "first", "lo", "hi").sortWithinPartitions("band", "first", "lo", "hi", "rep", "rep_key")
    return dealt.mapInPandas(compare, "a long, a_key long, b long, b_key long").distinct()


def _residual(members: DataFrame, documents: DataFrame, p: NearDup, partitions: int) -> DataFrame:
    """Pairs of different components under one key that may be similar enough."""
    members = stage_table(members, "neardup-crossing")
    nodes = stage_table(members.select("rep", "rep_key", "comp").distinct(), "neardup-left")
    shared = stage_table(_shared_shingles(nodes, documents, p), "neardup-shared")
    return _by_rare(shared, p).unionByName(_by_core(members, shared, p, partitions)).distinct()


def near_duplicates(documents: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of each row.

    Null and empty texts have an empty set and are linked with nothing.  Rows
    with a null doc_id are linked with nothing and kept, as nothing can name
    them (component_id null).  Rows that share a doc_id are one document, so one
    component; of equal rows each is returned.  Other columns are not read.
    """
    check_columns(documents, "doc_id", "text")
    rows = stage_table(signatures(documents, p), "neardup-rows")
    full = rows.filter(F.col("set_hash").isNotNull())
    first = full.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    reps = stage_table(first.select("set_hash", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("rep_key")), "neardup-reps")
    own = full.join(reps.select(F.col("rep").alias("doc_id"), F.col("rep_key").alias("text_key"), "set_hash"), ["doc_id", "text_key", "set_hash"], "left_semi").dropDuplicates(["set_hash"])
    banded = own.select(F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key"), F.explode("keys").alias("band"))
    leads = banded.groupBy("band").agg(F.min(F.struct("rep", "rep_key")).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage_table(banded.join(leads.select("band", "l"), "band"), "neardup-members")
    star = members.filter((F.col("rep") != F.col("l.rep")) | (F.col("rep_key") != F.col("l.rep_key"))).select(F.col("l.rep").alias("a"), F.col("l.rep_key").alias("a_key"), F.col("rep").alias("b"), F.col("rep_key").alias("b_key")).distinct()
    star = stage_table(star, "neardup-star")
    # Rows of one doc_id with different texts are linked by their id.
    several = full.join(reps, "set_hash").select("doc_id", "rep").distinct()
    lowest = several.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).filter("a < hi")
    same_id = several.join(lowest, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    links = stage_table(verify(star, documents, p).unionByName(same_id), "neardup-links")
    labels = components(links)
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    centres = stage_table(_medoids(_crossing(members, labels, own), p, partitions).join(star, ["a", "a_key", "b", "b_key"], "left_anti"), "neardup-centres")
    links = stage_table(links.unionByName(verify(centres, documents, p)), "neardup-links")
    labels = components(links)
    tested = star.unionByName(centres)
    tested = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("b_key").alias("a_key"), F.col("a").alias("b"), F.col("a_key").alias("b_key")))
    rest = _residual(_crossing(members, labels, own), documents, p, partitions).join(tested, ["a", "a_key", "b", "b_key"], "left_anti")
    more = verify(stage_table(rest, "neardup-rest"), documents, p)
    labels = components(links.unionByName(more))
    found = rows.join(reps.select("set_hash", "rep"), "set_hash", "left").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    out = found.select("doc_id", "text_key", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id"))
    nameless = documents.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """``documents`` with one document of each component, all columns as they were.

    Rows that equal each other in doc_id and text are kept together.
    """
    gone = near_duplicates(documents, p).filter(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return documents.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")
