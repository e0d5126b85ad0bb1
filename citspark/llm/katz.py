"""LM scoring: a Katz bigram model, Good-Turing discounts, exact back-off weights.

``P(w|h) = d(c) c(h,w) / c(h)`` for a seen pair and ``alpha(h) P(w)`` for
another, with ``P(w) = d(c) c(w) / N`` for known words and the rest of the mass
for the one unknown type.  ``alpha(h)`` makes each context sum to exactly one.
Counts up to ``k`` are discounted by Good-Turing, larger ones by ``floor``, so
that every context keeps some mass.

How it runs:

1. Words are counted; the most frequent ``top`` of them, a bounded table, get
   short codes.  Discounts come from counts of counts.
2. One scan deals all (context, word, document) triples to buckets of contexts,
   as compressed columns, a few bytes a token.  A context with very many tokens
   is dealt to several buckets by its next word.
3. A bucket holds all of its pairs' occurrences: it counts them, stores the
   pairs, and returns per document the resolved part of its score, per context
   the sums behind ``alpha``, and what needs other tables: how often it has
   unseen pairs of a context, and words without a code.
4. Joins and sums of these (far fewer rows than tokens) give the scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns, fold, scratch_path, stage_table

_TOP_BIT = np.uint64(1 << 63)
#: Hashes of the two marks, which no word can have by its code's form.
END, START = np.uint64(1), np.uint64(2)
_K = 5


@dataclass(frozen=True)
class Katz:
    """top: words with short codes, a bound of what is broadcast (16 bytes each).

    bucket_tokens: tokens that meet in one task; context_tokens: tokens of one
    context beyond which it is dealt by the next word; batch_tokens: tokens that
    a scanning task sorts at once; floor: discount of counts above k = 5.
    """

    top: int = 1 << 20
    bucket_tokens: int = 1_500_000
    context_tokens: int = 500_000
    batch_tokens: int = 1_500_000
    floor: float = 1e-4


def discounts(n: list[int], floor: float) -> list[float]:
    """Katz's d_1..d_k from counts of counts ``n[1..k+1]``; (r - 0.5) / r where they give none."""
    out = []
    common = (_K + 1) * n[_K + 1] / n[1] if n[1] else 1.0
    for r in range(1, _K + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 - floor else (r - 0.5) / r)
    return out


@dataclass
class WordModel:
    """Unigram counts: N, V, discounts; the coded words' hashes, their codes, and counts by code.

    Codes are places by falling count, so that most tokens have small ones.
    """

    total: int
    types: int
    d: list[float]
    floor: float
    hashes: np.ndarray  # sorted
    codes: np.ndarray
    counts: np.ndarray
    unknown: float = field(default=0.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words by their counts; 0 counts are the unknown type."""
        d = np.full(len(c), 1 - self.floor)
        for r in range(1, _K + 1):
            d[c == r] = self.d[r - 1]
        return np.where(c > 0, d * c / max(self.total, 1), self.unknown)


def word_hash(word: bytes) -> int:
    """A word's 64-bit hash with the top bit set, so never a mark or a short code."""
    return xxhash.xxh64_intdigest(word) | (1 << 63)


class _Codes(dict):
    """Codes of words that the table has, or the hash of any other word."""

    def __init__(self, hashes: np.ndarray, codes: np.ndarray, limit: int = 200_000):
        super().__init__()
        self.hashes, self.codes, self.limit = hashes, codes, limit

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        at = int(np.searchsorted(self.hashes, np.uint64(h)))
        code = int(self.codes[at]) + 16 if at < len(self.hashes) and int(self.hashes[at]) == h else h
        if len(self) < self.limit and len(word) <= 64:
            self[word] = code
        return code


_HELD: dict = {}


def _codes(key: str, hashes: np.ndarray, codes: np.ndarray) -> _Codes:
    """One code table a worker process and model."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = _Codes(hashes, codes)
    return _HELD[key]


def crc_rule(modulus: int, held: int) -> Callable[[object], bool]:
    """True for the ids to learn from: crc32 of the id as text, mod ``modulus``, is not ``held``."""
    return lambda doc_id: zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % modulus != held


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an array by significance: leading zeros become one run."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""


def _unplanes(b: bytes, dtype: str) -> np.ndarray:
    t = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(t.itemsize, -1).T).view(t).ravel() if len(b) else np.zeros(0, dtype=t)


_BLOB = ("<u8", "<u4", "<u8", "<u4", "<i8", "<i8", "<u1", "<u4", "<u4", "<f8")


def pack_triples(arrays: list[np.ndarray]) -> bytes:
    """Compressed columns: contexts, their counts, words, document places, documents and, where they start, their token sums."""
    h, n, w = arrays[:3]
    # Contexts ascend, and so do the words of each: steps are smaller than values.
    steps = np.diff(w, prepend=w[:1] * 0)
    first = np.cumsum(n) - n
    steps[first] = w[first]
    arrays = [np.diff(h, prepend=h[:1] * 0), n, steps, *arrays[3:]]
    parts = [_planes(a.astype(t)) for a, t in zip(arrays, _BLOB)]
    return np.array([len(p) for p in parts], dtype="<u4").tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack_triples(blob: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(blob[: 4 * len(_BLOB)], dtype="<u4")
    data, at, out = zstandard.ZstdDecompressor().decompress(blob[4 * len(_BLOB) :]), 0, []
    for size, t in zip(sizes, _BLOB):
        out.append(_unplanes(data[at : at + int(size)], t))
        at += int(size)
    h, n, steps = out[:3]
    first = np.cumsum(n, dtype=np.int64) - n
    w = np.cumsum(steps)
    return [np.cumsum(h), n, w - np.repeat(w[first] - steps[first], n), *out[3:]]


def word_model(documents: DataFrame, learn: Callable[[object], bool], p: Katz) -> tuple[WordModel, DataFrame]:
    """Counts of the training words, ``end`` included, as a table and a bounded model."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        docs = 0

        def flush() -> pd.DataFrame:
            w = np.fromiter(map(word_hash, held), dtype=np.uint64, count=len(held))
            c = np.fromiter(held.values(), dtype=np.int64, count=len(held))
            return pd.DataFrame({"w": np.append(w, END).view(np.int64), "c": np.append(c, docs)})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if learn(None if pd.isna(doc_id) else int(doc_id)):
                    docs += 1
                    for x in fold(text).split():
                        held[x] = held.get(x, 0) + 1
                    if len(held) > 400_000:
                        yield flush()
                        held.clear()
                        docs = 0
        yield flush()

    counted = documents.select("doc_id", "text").mapInPandas(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).filter("c > 0")
    words = stage_table(counted, "katz-words")
    spread = {int(r.c): int(r.n) for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, types = sum(c * n for c, n in spread.items()), sum(spread.values())
    room, least = p.top, 1 << 62
    for c in sorted(spread, reverse=True):
        if spread[c] > room:
            break
        room, least = room - spread[c], c
    # Columns, not row objects: two numbers a word on the driver.
    top = words.filter(F.col("c") >= least).select("w", "c").toArrow()
    hashes, counts = top["w"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    order = np.lexsort((hashes, -counts))
    hashes, counts = hashes[order], counts[order]
    codes = np.argsort(hashes)
    d = discounts([spread.get(r, 0) for r in range(_K + 2)], p.floor)
    model = WordModel(total, types, d, p.floor, hashes[codes], codes.astype(np.uint32), counts)
    mass = sum((d[c - 1] if c <= _K else 1 - p.floor) * c * n for c, n in spread.items())
    model.unknown = 1 - mass / total if total else 1.0
    return model, words


_OUT = "kind string, bucket int, doc_id long, no_id boolean, text_key long, train boolean, h long, w long, n long, missed long, v double, base double, known long, tokens long, r1 long, r2 long, r3 long, r4 long, r5 long, big long, mass double, c_h long, blob binary"


def _deal(documents: DataFrame, learn: Callable[[object], bool], model: WordModel, p: Katz, buckets: int, key: str) -> DataFrame:
    """(bucket, blob) rows: all triples of all documents."""
    shared = documents.sparkSession.sparkContext.broadcast((model.hashes, model.codes, model.counts))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, code_of, counts = shared.value
        codes = _codes(key, hashes, code_of)
        # Buckets that a coded context is dealt to.
        splits = np.ones(len(counts) + 16, dtype=np.int64)
        splits[16:] = np.maximum(1, counts // p.context_tokens)
        splits[int(START)] = max(1, model_ends // p.context_tokens)
        ids: list[int] = []
        keys: list[int] = []
        flags: list[int] = []
        texts: list[np.ndarray] = []
        by_code = np.zeros(len(counts) + 16, dtype=np.int64)
        by_code[int(END)], by_code[16:] = model_ends, counts

        def flush() -> Iterator[pd.DataFrame]:
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            w = np.concatenate(texts)
            h = np.empty_like(w)
            h[1:] = w[:-1]
            h[np.cumsum(sizes) - sizes] = START
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            small = h < _TOP_BIT
            share = np.ones(len(h), dtype=np.uint64)
            share[small] = splits[h[small].astype(np.int64)].astype(np.uint64)
            spot = _mix(h ^ _mix(_mix(w) % share + np.uint64(77)))
            bucket = (spot % np.uint64(buckets)).astype(np.int64)
            # Sums over each text's coded tokens; they travel once, with the text's first token.
            near = w < _TOP_BIT
            c = by_code[np.where(near, w, 0).astype(np.int64)]
            lone = np.where(near, np.log10((c + 1) / (model.total + model.types + 1)), 0.0)
            own = [np.array(ids, dtype=np.int64), np.array(keys, dtype=np.int64), np.array(flags, dtype=np.uint8)]
            sums = [sizes, np.bincount(doc, weights=near & (c > 0), minlength=len(sizes)), np.bincount(doc, weights=lone, minlength=len(sizes))]
            home = bucket[np.cumsum(sizes) - sizes]
            del near, c, lone, spot, share, small
            order = np.lexsort((w, h, bucket))
            bucket, h, w, doc = bucket[order], h[order], w[order], doc[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out: dict[str, list] = {"bucket": [], "blob": []}
            for a, b in zip(cuts, np.append(cuts[1:], len(h))):
                hh, first = h[a:b], np.flatnonzero(np.append(True, h[a + 1 : b] != h[a : b - 1]))
                docs, place = np.unique(doc[a:b], return_inverse=True)
                arrays = [hh[first], np.diff(np.append(first, b - a)), w[a:b], place, *(x[docs] for x in own), *(np.where(home[docs] == bucket[a], x[docs], 0) for x in sums)]
                out["bucket"].append(int(bucket[a]))
                out["blob"].append(pack_triples(arrays))
            yield pd.DataFrame(out)

        held = 0
        for batch in batches:
            for doc_id, k, text in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                no_id = bool(pd.isna(doc_id))
                words = fold(text).split()
                code = np.empty(len(words) + 1, dtype=np.uint64)
                code[:-1] = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
                code[-1] = END
                ids.append(0 if no_id else int(doc_id))
                keys.append(int(k))
                flags.append(int(learn(None if no_id else int(doc_id))) | 2 * no_id)
                texts.append(code)
                held += len(code)
                if held >= p.batch_tokens:
                    yield from flush()
                    ids, keys, flags, texts, held = [], [], [], [], 0
        if texts:
            yield from flush()

    at = int(np.searchsorted(model.hashes, END))
    model_ends = int(model.counts[model.codes[at]]) if at < len(model.hashes) and model.hashes[at] == END else 0
    # Where no id comes twice, the id alone tells rows apart.
    ids = documents.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("k")).first()
    text_key = F.lit(0).cast("long") if ids.n == ids.k else F.xxhash64("text")
    rows = documents.select("doc_id", text_key.alias("text_key"), "text")
    return rows.mapInPandas(deal, "bucket int, blob binary")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in sorted arrays."""
    change = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    if len(change):
        change[0] = True
    return np.flatnonzero(change)


def _by_document(kind: str, name: str, key: np.ndarray, doc: np.ndarray, missed: np.ndarray | None, ids: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of ``kind``: how often each document has each key, and how many of these ``missed`` marks."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = _runs(doc, key)
    n = np.diff(np.append(first, len(key)))
    marked = np.add.reduceat(missed[order].astype(np.int64), first) if missed is not None and len(first) else n
    for lo in range(0, len(first), 200_000):
        at = slice(lo, lo + 200_000)
        i = first[at]
        d = doc[i]
        yield pd.DataFrame({"kind": kind, "doc_id": ids[d], "no_id": (flags[d] & 2) > 0, "text_key": keys[d], name: key[i].view(np.int64), "n": n[at], "missed": marked[at]})


def _solve_bucket(blobs: list[bytes], bucket: int, counts: np.ndarray, model: WordModel, start_count: int) -> Iterator[pd.DataFrame]:
    """All that a bucket's triples give; see the module's step 3."""
    parts, base_doc = [unpack_triples(b) for b in blobs], 0
    hs, ws, ds = [], [], []
    for uh, nh, w, place, ids, *_ in parts:
        hs.append(np.repeat(uh, nh))
        ws.append(w)
        ds.append((place + np.uint32(base_doc)).astype(np.int32))
        base_doc += len(ids)
    ids, keys, flags, sizes, known, base = (np.concatenate([p[i] for p in parts]) for i in range(4, 10))
    del parts, uh, nh, w, place
    # Each list goes as soon as it is joined, and each array as soon as it is sorted.
    h, w, doc = np.concatenate(hs), np.concatenate(ws), np.concatenate(ds)
    del hs, ws, ds
    order = np.lexsort((w, h)).astype(np.int32)
    h = h[order]
    w = w[order]
    doc = doc[order]
    del order
    train = (flags & 1).astype(np.int32)[doc]
    pair = _runs(h, w)
    pair_of = np.repeat(np.arange(len(pair), dtype=np.int32), np.diff(np.append(pair, len(h))))
    c_pair = np.add.reduceat(train, pair)
    ctx = _runs(h)
    ctx_of = np.repeat(np.arange(len(ctx), dtype=np.int32), np.diff(np.append(ctx, len(h))))
    c_ctx, uh = np.add.reduceat(train, ctx).astype(np.int64), h[ctx]
    del train
    coded = (uh >= 16) & (uh < _TOP_BIT)
    c_ctx[coded] = counts[uh[coded].astype(np.int64) - 16]  # also of contexts dealt to several buckets
    c_ctx[uh == START] = start_count

    def word_count(x: np.ndarray) -> np.ndarray:
        """Counts of coded words and the end; -1 for others."""
        c, known = np.full(len(x), -1, dtype=np.int64), (x >= 16) & (x < _TOP_BIT)
        c[known] = counts[x[known].astype(np.int64) - 16]
        c[x == END] = start_count
        return c

    # Documents: the resolved part.
    c, ch = c_pair[pair_of], c_ctx[ctx_of]
    del pair_of, ctx_of
    seen = c > 0
    value = np.zeros(len(h))
    value[seen] = np.log10(c[seen] / ch[seen])
    cw = word_count(w)
    near = cw >= 0
    back = ~seen & near  # the word's part of a backed-off score; its context's weight follows
    value[back] = np.log10(np.maximum(model.p(cw[back]), 1e-300))
    add = lambda x: np.bincount(doc, weights=x, minlength=len(ids))
    names = pd.DataFrame({"doc_id": ids, "no_id": (flags & 2) > 0, "text_key": keys})
    yield names.assign(kind="document", v=add(value), big=add(seen & (c > _K)), **{f"r{r}": add(c == r) for r in range(1, _K + 1)})
    home = sizes > 0
    yield names[home].assign(kind="text", train=(flags[home] & 1) > 0, tokens=sizes[home], known=known[home], base=base[home])
    del names, value, back, c, ch
    # What needs other tables, counted by document: contexts of unseen pairs, and words without a code.
    missed, away = np.flatnonzero(~seen), np.flatnonzero(~near)
    yield from _by_document("miss", "h", h[missed], doc[missed], None, ids, keys, flags)
    yield from _by_document("rare", "w", w[away], doc[away], ~seen[away], ids, keys, flags)
    del missed, away, seen, near, cw
    # Contexts: what the back-off weight needs.
    first = c_pair > 0
    ph, pw, pc = h[pair][first], w[pair][first], c_pair[first]
    pcw = word_count(pw)
    group = _runs(ph)
    if len(group):
        total = lambda x: np.add.reduceat(x, group)
        near = pcw >= 0
        mass = np.where(near, model.p(np.maximum(pcw, 1)), 0.0)
        cx = c_ctx[np.searchsorted(uh, ph[group])]
        yield pd.DataFrame({"kind": "context", "h": ph[group].view(np.int64), "c_h": cx, "mass": total(mass), "big": total(np.where(pc > _K, pc, 0)), **{f"r{r}": total((pc == r).astype(np.int64)) for r in range(1, _K + 1)}})
        far = np.flatnonzero(~near)
        yield pd.DataFrame({"kind": "link", "h": ph[far].view(np.int64), "w": pw[far].view(np.int64)})
        blob = pack_triples([ph[group], np.diff(np.append(group, len(ph))), pw, pc, *(np.zeros(0, dtype=np.int64),) * 6])
        spread = np.bincount(np.minimum(pc, _K + 1), minlength=_K + 2)
        yield pd.DataFrame({"kind": ["pairs"], "bucket": [bucket], "blob": [blob], **{f"r{r}": [spread[r]] for r in range(1, _K + 1)}, "big": [int((pc == _K + 1).sum())]})


def katz_scores(documents: DataFrame, learn: Callable[[object], bool], p: Katz = Katz()) -> DataFrame:
    """Scores of all ``documents`` by the model of those that ``learn(doc_id)`` takes.

    Returns doc_id, text_key, train, n_tokens, n_known, train_tokens, base_score
    and score, one row for each input row.  A text's tokens are its words and one
    end; null and empty texts are an end alone.  ``learn`` gets None for a null
    id.  Equal rows count each in training and get equal scores.  Without
    training rows every token is unknown and has probability one.
    Columns other than doc_id and text are not read.
    """
    check_columns(documents, "doc_id", "text")
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, words = word_model(documents, learn, p)
    ends = words.filter(F.col("w") == int(END)).select("c").first()
    start = int(ends.c) if ends else 0
    key = scratch_path(spark, "katz")
    # Held-out tokens come on top of the training ones: at most a few times as many.
    buckets = max(4, math.ceil(1.2 * model.total / p.bucket_tokens))
    shared = spark.sparkContext.broadcast(model.counts)
    none = np.zeros(0)
    bare = WordModel(model.total, model.types, model.d, model.floor, none, none, none, model.unknown)
    columns = [c.split()[0] for c in _OUT.split(", ")]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        held: list[bytes] = []
        at = None
        for batch in batches:
            for bucket, blob in zip(batch["bucket"], batch["blob"]):
                if at is not None and bucket != at:
                    yield from (x.reindex(columns=columns) for x in _solve_bucket(held, at, counts, bare, start))
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield from (x.reindex(columns=columns) for x in _solve_bucket(held, at, counts, bare, start))

    dealt = _deal(documents, learn, model, p, buckets, key).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    solved = stage_table(dealt.mapInPandas(solve, _OUT), "katz-solved", ("kind",), "zstd")
    return _finish(solved, words, model, p)


def _finish(solved: DataFrame, words: DataFrame, model: WordModel, p: Katz) -> DataFrame:
    kind = lambda k: solved.filter(F.col("kind") == k)
    rs = [f"r{r}" for r in range(1, _K + 1)]
    n = kind("pairs").agg(*(F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in [*rs, "big"])).first()
    d = discounts([0, *n], p.floor)
    floor, total = F.lit(p.floor), max(model.total, 1)

    def p_word(c):  # P(w) by count; null is unknown
        out = F.when(c > _K, (1 - floor) * c / total)
        for r in range(1, _K + 1):
            out = out.when(c == r, F.lit(model.d[r - 1]) * c / total)
        return out.otherwise(F.lit(max(model.unknown, 1e-300)))

    log_d = sum((F.col(r) * F.lit(math.log10(x)) for r, x in zip(rs, d)), F.col("big") * F.lit(math.log10(1 - p.floor)))
    doc = ["doc_id", "no_id", "text_key"]
    resolved = kind("document").select(*doc, (F.col("v") + log_d).alias("v"))
    # Words that have no short code: their counts come from the table.
    table = words.select("w", F.col("c").alias("c_w"))
    # alpha(h) = left over mass of the seen pairs / left over mass of their words.
    linked = kind("link").join(table, "w").groupBy("h").agg(F.sum(p_word(F.col("c_w"))).alias("mass"))
    seen = kind("context").select("h", "c_h", "mass", "big", *rs).unionByName(linked.select("h", "mass"), allowMissingColumns=True)
    by_h = seen.groupBy("h").agg(F.max("c_h").alias("c"), F.sum("mass").alias("mass"), F.sum("big").alias("big"), *(F.sum(r).alias(r) for r in rs))
    free = sum((F.col(r) * F.lit(k * (1 - x)) for k, (r, x) in enumerate(zip(rs, d), 1)), F.col("big") * floor) / F.col("c")
    alpha = by_h.select("h", F.log10(free / (1 - F.col("mass"))).alias("log_alpha"))
    missed = kind("miss").select(*doc, "h", "n")
    # Contexts with short codes are at most ``top`` and two marks, and most misses are theirs: no miss moves for them.
    coded = F.col("h") >= 0  # a hash has the top bit set
    near = missed.filter(coded).join(F.broadcast(alpha.filter(coded)), "h", "left")
    far = missed.filter(~coded).join(alpha.filter(~coded), "h", "left")
    backed = near.unionByName(far).select(*doc, (F.col("n") * F.coalesce("log_alpha", F.lit(0.0))).alias("v"))
    lone = F.log10((F.coalesce("c_w", F.lit(0)) + 1) / F.lit(model.total + model.types + 1))
    rare = kind("rare").select(*doc, "w", "n", "missed").join(table, "w", "left")
    zero = F.lit(0).cast("long")
    rest = rare.select(*doc, (F.col("missed") * F.log10(p_word(F.col("c_w")))).alias("v"), (F.col("n") * lone).alias("base"), F.when(F.col("c_w") > 0, F.col("n")).otherwise(zero).alias("known"), zero.alias("tokens"), zero.alias("ends"), F.lit(False).alias("train"))
    texts = kind("text").select(*doc, F.lit(0.0).alias("v"), "base", "known", "tokens", F.lit(1).cast("long").alias("ends"), "train").unionByName(rest)
    own = texts.groupBy(*doc).agg(*(F.sum(c).alias(c) for c in ("base", "known", "tokens", "ends")), F.sum("v").alias("__v"), F.max("train").alias("train"))
    # Many rows a text, so nothing but the score moves with them.
    sums = own.join(resolved.unionByName(backed).groupBy(*doc).agg(F.sum("v").alias("v")), doc).withColumn("v", F.col("v") + F.col("__v"))
    each = lambda c: F.col(c) / F.col("ends")
    out = sums.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"),
        "text_key",
        "train",
        each("tokens").cast("long").alias("n_tokens"),
        each("known").cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        each("base").alias("base_score"),
        each("v").alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("ends").cast("int"))).alias("__copy"),
    )
    return out.drop("__copy")
