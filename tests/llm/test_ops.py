"""The ten operators against brute force, on small tables with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citspark.llm import common, decontam, html_extract, katz, line_dedup, mixing, near_dup, quality, sharding, shingles, token_store, unigram_count
from citspark.llm.html_tree import parse

WORDS = [f"w{i}" for i in range(60)]


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    texts = []
    for k in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            words = rng.choice(texts or ["a"])
            words = (words or "").split(" ")
            words[rng.randrange(len(words))] = "new"
            texts.append(" ".join(words))
        else:
            texts.append("\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4))))
    return texts


def odd_rows():
    """Nulls, empty and blank texts, one very long text, repeated rows."""
    rows = [(k, t) for k, t in enumerate(corpus())]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one"), (None, "a null id with several words in it"), (None, None)]
    rows += [(5, rows[5][1]), (105, " ".join(random.Random(3).choice(WORDS) for _ in range(30_000)))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that operators use inside."""
    rows = [(i, t, "src" + str((i or 0) % 3) if i != 7 else None, 1, 2.0, "x") for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, score double, kind string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality_matches_brute_force(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rules = quality.QualityRules(buckets=256, trusted_rows=40)
    found = quality.quality_rules(docs, labels, rules).collect()
    assert len(found) == docs.count()
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = Counter(windows)
        assert r.n_repeat_words == len({i + d for i, w in enumerate(windows) if many[w] > 1 for d in range(5)})
        assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
        assert r.kept == (not r.base_failed and r.llr >= r.threshold)
    assert {r.doc_id for r in quality.quality_rules(docs, labels, rules).filter("kept").collect()} == {r.doc_id for r in found if r.kept}
    assert quality.quality_rules(empty, labels, rules).count() == 0
    assert quality.quality_rules(docs, labels.limit(0), rules).filter("kept = base_failed").count() == 0


def test_long_texts_of_distinct_words_repeat_nothing(spark):
    """At 400,000 windows some twenty pairs share 32 bits of hash; only equal words count."""
    plain = [f"w{i}" for i in range(400_000)]
    rows = [(1, " ".join(plain)), (2, " ".join(plain + plain[1000:1007]))]
    found = quality.with_base(quality.hashed(spark.createDataFrame(rows, "doc_id long, text string")), 5)
    assert {r.doc_id: r.n_repeat_words for r in found.select("doc_id", "n_repeat_words").collect()} == {1: 0, 2: 14}


def test_quality_ratio_is_the_formula(spark):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    texts = {1: "a b c a", 2: "b b d", 3: "x y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int")
    rules = quality.QualityRules(buckets=64)
    trusted = quality.trusted_sample(labels, rules).collect()
    fit_ids = {r["__trusted"] for r in trusted if not r["__held"]}

    def grams(t):
        h = [xxhash.xxh64_intdigest(w, seed=42) for w in t.split()]
        # Spark chains: the hash of one value seeds the next.
        pair = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)) for a, b in zip(h, h[1:])]
        return [x & 63 for x in h + pair]

    got = quality.ratio_table(docs, quality.trusted_sample(labels, rules), rules).first()["ratio"]
    # The last word's pair has no partner: Spark skips the null and hashes the word alone.
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        last = xxhash.xxh64_intdigest(t.split()[-1], seed=42)
        own = grams(t) + [xxhash.xxh64_intdigest(last.to_bytes(8, "little"), seed=42) & 63]
        raw.update(own)
        if i in fit_ids:
            target.update(own)
    for b in range(64):
        want = math.log((target[b] + 1) / (sum(target.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64))
        assert got[b] == pytest.approx(want)
    assert signed(1 << 63) < 0


def test_decontamination_matches_brute_force(spark, docs, empty):
    texts = [t for _, t in odd_rows() if t and len(t.split()) > 15]
    items = [(1, " ".join(texts[0].split()[2:14]).upper()), (2, " ".join(texts[3].split()[:10])), (3, "w1 w2"), (4, "w7"), (5, None), (6, ""), (None, texts[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    wanted = {}
    for i, t in odd_rows():
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            b = split(text)
            n = min(10, len(b))
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= {str(item)} if item is not None else set()
        wanted[i, t] = (len(w), len(hit), sorted(ids))
    for limit in (200_000, 0):
        found = decontam.decontaminate(docs, bench, max_windows=limit).withColumn("k", F.lit(1)).collect()
        assert len(found) == docs.count()
        by_key = {(r.doc_id, r.text_key): (r.n_words, r.n_hit, list(r.item_ids)) for r in found}
        for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect():
            assert by_key[r.doc_id, r.k] == wanted[r.doc_id, r.text], (limit, r.doc_id)
    kept = decontam.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in odd_rows() if not wanted[i, t][1])
    cut = decontam.remove_contaminated(docs, bench, whole=False)
    assert cut.count() == docs.count() and decontam.decontaminate(cut.filter("doc_id < 3"), bench.filter("item_id = 1")).filter("contaminated").count() == 0
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_line_dedup_matches_brute_force(spark, docs, empty):
    lines = ["A line that is long enough to count", "  a LINE that is long enough to count\t", "short", "", "another long line of more than twenty"]
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 5)))) for i in range(40)] + [(None, lines[0]), (50, None), (3, lines[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    wanted = Counter()
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(holders.get(key(x), ())) < 3 or len(key(x)) < 20 or max(holders[key(x)]) == i]
        wanted[i, len(own), len(own) - len(kept), "\n".join(kept)] += 1
    for batches, fanout in ((4, 3), (1, 4), (9, 2)):
        found = line_dedup.dedup_lines(table, batches=batches, fanout=fanout).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found) == wanted
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(docs).count() == docs.count()


def test_line_runs_tell_new_lines_from_known(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda ks: spark.createDataFrame([(k, k, k) for k in ks], "k1 long, k2 long, doc_id long")
    for ks in ([1, 2], [2, 3], [4], [1, 5]):
        store.add(batch(ks))
    assert {r.k1 for r in store.unseen(batch([1, 6, 4, 7])).collect()} == {6, 7}
    assert len(store.runs()) == 1, "four batches of fanout two leave one run"
    assert {r.k1 for r in store.common(2).collect()} == {1, 2}


@pytest.mark.parametrize("k,block", [(4, 256), (5, 3), (2, 2)])
def test_near_duplicates_match_brute_force(spark, docs, empty, k, block):
    p = near_dup.NearDup(shingle=k, block=block, salt_rows=2)
    rows = odd_rows()
    sets = [frozenset(shingles.shingle_set(t, k).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            near = sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if a is not None and b is not None and (near or a == b):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(d, lowest.get(find(i), d))
    found = near_dup.near_duplicates(docs, p).collect()
    assert len(found) == len(rows)
    want = {d: lowest[find(i)] for i, (d, _) in enumerate(rows) if d is not None}
    for r in found:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert near_dup.near_duplicates(empty, p).count() == 0
    kept = near_dup.keep_one(docs, p)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values()) | {None}


def test_large_group_just_under_the_similarity(spark, monkeypatch):
    """Copies of one text with 0 to 9 edits each: half of them reach nobody, and few pairs are made for these."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(400):
        words = list(base)
        for at in rng.sample(range(150), d % 10):
            words[at] = rng.choice(WORDS)
        rows.append((d * 3 + 1, " ".join(words)))
    sets = [shingles.shingle_set(t, 4) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    near = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            near += 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both)
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    made, residual = [], near_dup._residual
    monkeypatch.setattr(near_dup, "_residual", lambda *a: made.append(residual(*a)) or made[0])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dup.near_duplicates(table, near_dup.NearDup(shingle=4, block=32, rare=8)).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}
    alone = sum(find(i) == i and sum(find(j) == i for j in range(len(rows))) == 1 for i in range(len(rows)))
    assert alone > 100 and near > 20_000
    assert made[0].count() < 10 * len(rows)


def test_super_minhash_is_unbiased_and_even():
    rng = np.random.default_rng(1)
    for jaccard in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(60):
            u = np.unique(rng.integers(0, 1 << 63, int(rng.integers(4, 300)), dtype=np.uint64))
            k = max(1, round(jaccard * len(u)))
            a, b = np.concatenate([u[:k], u[k::2]]), np.concatenate([u[:k], u[k + 1 :: 2]])
            s = shingles.super_minhash([a, b], 200)
            errors.append((s[0] == s[1]).mean() - k / len(u))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < math.sqrt(jaccard * (1 - jaccard) / 200) * 1.3
    one = shingles.super_minhash([np.array([5], dtype=np.uint64), np.zeros(0, dtype=np.uint64)], 50)
    assert len(set(one[0].tolist())) == 50 and not one[1].any()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 20)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def test_katz_sums_to_one_and_matches_brute_force(spark, docs, empty):
    rule = katz.crc_rule(7, 2)
    p = katz.Katz(top=20, bucket_tokens=4000, context_tokens=100, batch_tokens=3000)
    rows = odd_rows()
    tokens = lambda t: [*common.fold(t).split(), b"</e>"]
    uni, pair, ctx = Counter(), Counter(), Counter()
    for i, t in rows:
        if rule(i):
            for h, w in zip([b"<s>", *tokens(t)], tokens(t)):
                uni[w] += 1
                pair[h, w] += 1
                ctx[h] += 1
    total, types = sum(uni.values()), len(uni)
    of = lambda c: katz.discounts([list(c.values()).count(r) for r in range(7)], p.floor)
    du, dp = of(uni), of(pair)
    d = lambda x, c: x[c - 1] if c <= 5 else 1 - p.floor
    p1 = {w: d(du, c) * c / total for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    used, mass = Counter(), Counter()
    for (h, w), c in pair.items():
        used[h] += d(dp, c) * c / ctx[h]
        mass[h] += p1[w]

    def prob(h, w):
        if pair[h, w]:
            return d(dp, pair[h, w]) * pair[h, w] / ctx[h]
        return ((1 - used[h]) / (1 - mass[h]) if h in ctx else 1) * p1.get(w, unknown)

    for h in ctx:
        assert sum(prob(h, w) for w in uni) + prob(h, b"\0 never") == pytest.approx(1)
    found = katz.katz_scores(docs, rule, p)
    got = found.collect()
    assert len(got) == len(rows)
    keys = {(r.doc_id, r.k): r.text for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    for r in got:
        w = tokens(keys[r.doc_id, r.text_key])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (len(w), sum(uni[x] > 0 for x in w), total, rule(r.doc_id))
        assert r.score == pytest.approx(sum(math.log10(prob(h, x)) for h, x in zip([b"<s>", *w], w)))
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (total + types + 1)) for x in w))
    assert katz.katz_scores(empty, rule, p).count() == 0


def test_mixing_keeps_within_one_block():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 9)
        blocks, weights = [rng.randint(0, 300) for _ in range(n)], [rng.choice((0, 1, rng.random())) for _ in range(n)]
        done = [[] for _ in blocks]
        for ph in mixing.phases(blocks, weights, 96):
            size, order = sum(ph.shares), {}
            for k, i in enumerate(ph.sources):
                for b in range(ph.first[k], ph.last[k]):
                    local = b - ph.first[k]
                    order[local // ph.shares[k] * size + ph.slots[k][local % ph.shares[k]]] = k
                    done[i].append(b)
            assert sorted(order) == list(range(ph.length))
            count = [0] * len(ph.sources)
            for t in range(ph.length):
                count[order[t]] += 1
                assert all(abs(c - (t + 1) * q / size) < 1 for c, q in zip(count, ph.shares))
        assert done == [list(range(b)) for b in blocks]


def test_mixing_places_every_row(spark, docs, empty):
    mix = mixing.Mix(block_rows=4, shares=32)
    found = mixing.mix_sources(docs, {"src0": 3.0, "src1": 1.0}, mix).collect()
    assert len(found) == docs.count() == len({r.mix_order for r in found})
    for r in found:
        assert r.mix_order // 4 == r.slot
    assert len({(r.slot, r.source) for r in found}) == len({r.slot for r in found}), "a slot has one source"
    first = [s for s, in sorted({(r.slot,) for r in found if r.source in ("src0", "src1")})]
    assert max(first) < min(r.slot for r in found if r.source not in ("src0", "src1"))
    ordered = mixing.mixed_order(docs, mix=mix)
    assert ordered.columns == docs.columns and ordered.count() == docs.count()
    assert mixing.mix_sources(empty, mix=mix).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, mix=mixing.Mix(max_sources=2))


def test_sharding_is_even_and_keeps_copies_together(spark, docs, empty):
    found = sharding.shard_documents(docs, 4).collect()
    texts = {}
    assert len(found) == docs.count()
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sizes[s]))
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in found:
        assert any(zlib.crc32((t or "").encode()) == r.text_crc32 and len((t or "").encode()) + 1 == r.size for t in texts[r.doc_id])
    shards = {}
    for r in found:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) - 1 for s in shards.values()) <= 1
    whole = sharding.sharded(docs, 4)
    assert whole.columns == [*docs.columns, "shard", "slot"] and whole.count() == docs.count()
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_splits_a_group_beyond_a_shard(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(120)], "doc_id long, text string")
    found = sharding.shard_documents(rows, 8).collect()
    assert set(Counter(r.shard for r in found).values()) == {15}
    same = zlib.crc32(b"same")
    assert len({r.shard for r in found if r.text_crc32 == same}) <= 7


def test_elias_fano_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 300, 3000):
        v = np.cumsum(rng.integers(0, 2000, n))
        e = token_store.EliasFano.build(v)
        assert np.array_equal(e.all(), v) and [e.select(i) for i in range(n)] == v.tolist()
        if n > 1:
            bits = 8 * (len(e.low) + len(e.high)) / n
            assert bits <= 2 + math.log2(v[-1] / n + 1) + 17 / n
    with pytest.raises(IndexError):
        token_store.EliasFano.build(np.array([1])).select(1)


def test_cached_encoding_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = token_store.default_tokenizer()
    whole, cached, rng = Tokenizer.from_file(path), token_store.CachedEncoder(path, 2, 50), random.Random(8)
    parts = list("aAbB'’stre.,!?éÉñüß \n\t\r\x0b\x0c\x1c\x85  ̸́İΣς01２中文👍🏽&#<|>") + ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "don't "]
    simple = [c for c in map(chr, range(0x530)) if token_store._SIMPLE.fullmatch(c)]
    assert len(simple) > 900 and all(whole.normalizer.normalize_str(a + b) == (a + b).lower() for a, b in zip(simple, simple[7:] + simple[:7]))
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(cached.encode(text), dtype="<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_files_hold_every_document(spark, docs, empty):
    from tokenizers import Tokenizer

    path = token_store.default_tokenizer()
    out = common.scratch_path(spark, "tokens-test")
    manifest = token_store.write_token_files(docs, out, path, 2, docs_per_file=7)
    found = sorted(token_store.read_token_files(manifest, out, with_ids=True).collect(), key=lambda r: r.start)
    whole, at = Tokenizer.from_file(path), 0
    rows = sorted(((r.doc_id, [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in found] == [i for i, _ in rows]
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) and (r.doc_id, r.ids) in rows
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    assert token_store.encode_and_read(empty, path).count() == 0
    assert found[0].doc_id is None and found[0].start == 0, "rows without an id come first"
    only = token_store.encode_and_read(docs.filter("doc_id is null"), path).collect()
    assert [r.doc_id for r in only] == [None, None]


def test_token_files_have_one_manifest_file(spark, docs):
    """The tasks that encode write no part of it, as each part costs an executor a process of its own."""
    out = common.scratch_path(spark, "tokens-test")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        manifest = token_store.write_token_files(docs, out, token_store.default_tokenizer(), 2, docs_per_file=7)
    finally:
        spark.conf.set(key, before)
    assert len(manifest.inputFiles()) == 1
    rows = manifest.collect()
    assert len({r.part // 100_000 for r in rows}) > 1 and sum(r.n_docs for r in rows) == docs.count()


def test_unigram_counts_equal_the_tokenizer(spark, docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(6)
    for _ in range(25):
        pieces = {"".join(rng.choice("abcd▁.") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 4)) for _ in range(rng.randint(1, 25))}
        vocabulary = list(pieces.items())
        library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = unigram_count.UnigramCounter(vocabulary, limit=5)
        for _ in range(60):
            text = "".join(rng.choice("abcde  \n.é👍") for _ in range(rng.randint(0, 25)))
            assert counter.text(text)[1] == len(library.encode(text, add_special_tokens=False).ids)
    path = token_store.default_tokenizer("piece_bpe_32k.model")
    found = unigram_count.count_tokens(docs, path).collect()
    assert len(found) == docs.count() and all(r.n_tokens == 0 for r in found if r.doc_id in (100, 101))
    assert unigram_count.count_tokens(empty, path).count() == 0


def test_tree_marginals_are_exact():
    """Message passing against the sum over all labellings."""
    rng = random.Random(9)
    for _ in range(20):
        page = parse("".join(f"<{rng.choice(('div', 'p', 'article'))}>x" for _ in range(rng.randint(1, 6))))
        n = len(page.nodes)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [[[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)] for _ in range(4)]
        mass, on = 0.0, [0.0] * n
        for code in range(1 << n):
            s = [(code >> i) & 1 for i in range(n)]
            w = math.exp(sum(u for u, x in zip(unary, s) if x) + sum(edges[html_extract.edge_kind(page.nodes[i])][s[page.nodes[i].parent]][s[i]] for i in range(1, n)))
            mass += w
            for i in range(n):
                on[i] += w * s[i]
        assert html_extract.marginals(page, unary, edges)[0] == pytest.approx([x / mass for x in on])


def test_html_extraction(spark):
    model = html_extract.default_model()
    good = total = 0
    for markup, labels in html_extract.labelled_pages(80, seed=4242):
        page = parse(markup)
        assert len(page.nodes) == len(labels)
        p = html_extract.content_marginals(page, model)
        good += sum((x >= 0.5) == bool(y) for x, y in zip(p, labels))
        total += len(labels)
    assert good / total > 0.98
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One <b>two<br> three</p><p>Four\n five</article><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page + "<scr"), (5, "x", "<" * 1000), (6, "y", "<div>" * 3000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    found = {r.url: r for r in html_extract.extract_pages(table).collect()}
    assert found["u"].text == found["w"].text == "Head & more\nOne two three\nFour five" and found["u"].n_chars == 35
    assert found["w"].page_id is None and found["v"].text == "" and found[None].text == "" and found["y"].text == ""
    assert html_extract.extract_pages(table.limit(0)).count() == 0


def test_formulas_and_drawings_in_an_article_are_its_text():
    page = "<body><nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>Head</h1><p>Area is <math><mi>x</mi><mo>+</mo><mi>y</mi><mspace/><annotation>x+y</annotation></math> in total</p><p>See <svg><title>t</title><path d='M0'/><text>Figure A</text></svg> and <object>more</object></p></article></body>"
    assert html_extract.extract(page, html_extract.default_model()) == "Head\nArea is x+y in total\nSee Figure A and more"


def test_pipeline_matches_its_parts(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in odd_rows()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = next(t for _, t in rows and odd_rows() if t and len(t.split()) > 40)
    spark.createDataFrame([(1, " ".join(long.split()[5:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = quality.quality_rules(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).filter("kept").select("doc_id", "text").collect()
    alive = {r.doc_id: r.text for r in kept if r.doc_id is not None}
    sets = {i: frozenset(shingles.shingle_set(t, 5).tolist()) for i, t in alive.items()}
    comp = {i: i for i in alive}
    for _ in alive:
        for i in alive:
            for j in alive:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    split = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    item = split(" ".join(long.split()[5:20]))
    grams = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    clean = {i for i in alive if comp[i] == i and not any(tuple(split(alive[i])[k : k + 10]) in grams for k in range(len(split(alive[i])) - 9))}
    assert {r.doc_id for r in got if r.doc_id is not None} == clean
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1


def test_pipeline_slots_follow_the_mixture(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(i, f"text {i}", "en", "big" if i % 4 else "small", 6) for i in range(400)] + [(5, "text 5", "en", "big", 6), (None, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path))
    # A mixture in another order must give another order of slots: reversed here.
    for sign in (1, -1):
        given = common.stage_table(mixed.withColumn("mix_order", sign * F.col("mix_order")), "mixed-test")
        out = corpus_pipeline.shard(spark, given, str(tmp_path))
        assert out.columns == [*docs.columns, "shard", "slot"]
        at, found = {}, out.collect()
        for r in given.collect():
            at.setdefault((r.doc_id, r.text), []).append(r.mix_order)
        assert len(found) == len(rows)
        for s in range(8):
            inside = sorted((r.slot, r.doc_id, r.text) for r in found if r.shard == s)
            assert [x[0] for x in inside] == list(range(len(inside)))
            first = [min(at[x[1:]]) for x in inside if len(at[x[1:]]) == 1]
            assert first == sorted(first)


def test_mixing_follows_the_target_weights_themselves():
    cases = [([1000] * 20, [1.0] * 20), ([5000, 5000, 3], [1.0, 1.0, 0.0001]), ([4000, 3000, 2000], [0.1, 0.2, 0.7]), ([2000, 900, 50], [n**0.5 for n in (2000, 900, 50)])]
    for blocks, weights in cases:
        at = 0
        left = list(blocks)
        for ph in mixing.phases(blocks, weights, 1024):
            live = [i for i, n in enumerate(left) if n and weights[i] > 0]
            assert sorted(live) == sorted(ph.sources) and ph.start == at
            whole, order = sum(weights[i] for i in live), {}
            for k, i in enumerate(ph.sources):
                for b in range(ph.last[k] - ph.first[k]):
                    order[b // ph.shares[k] * sum(ph.shares) + ph.slots[k][b % ph.shares[k]]] = i
                left[i] -= ph.last[k] - ph.first[k]
            count = Counter()
            for t in range(ph.length):
                count[order[t]] += 1
                assert all(abs(count[i] - (t + 1) * weights[i] / whole) < 1 + 1e-6 for i in live)
            at += ph.length
        assert at == sum(blocks) and not any(left)


def test_quality_rejects_toxic_documents_by_a_few_words(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.choice((40, 40, 2000)))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(("vile", "nasty"))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    found = quality.quality_rules(docs, labels).collect()
    good = [r for r in found if not r.base_failed]
    assert {r.doc_id for r in good if r.toxic_score >= r.toxic_threshold} == {r.doc_id for r in good if r.doc_id % 5 == 0}
    assert not any(r.kept for r in found if r.doc_id % 5 == 0)
    clean = [r for r in good if r.doc_id % 5]
    assert all(r.kept == (r.llr >= r.threshold) for r in clean) and sum(r.kept for r in clean) >= 0.95 * len(clean)
    for r in found:
        assert (r.toxic_score > 0) == (r.doc_id % 5 == 0)


def test_quality_learns_from_every_labelled_row(spark):
    """More rows of each class than the 20,000 that the models once took; and no plan changes a result."""
    n = 21_000
    docs = spark.range(2 * n).selectExpr("id as doc_id", "concat('w', id % 7, if(id % 2 = 1, ' vile', ' fine')) as text")
    labels = docs.selectExpr("doc_id", "1 as quality", "int(doc_id % 2) as toxic")
    rules = quality.QualityRules(buckets=64)
    trusted, sample = quality.trusted_sample(labels, rules), quality.toxic_sample(labels, rules)
    assert trusted.count() == n and {r["__bad"]: r["count"] for r in sample.groupBy("__bad").count().collect()} == {0: n, 1: n}
    fit = {r["__bad"]: r["count"] for r in sample.filter("not __held").groupBy("__bad").count().collect()}
    weight = math.log((fit[1] + 0.5) / (fit[1] + 1)) - math.log(0.5 / (fit[0] + 1))
    marks = [y for own in quality.toxic_grams(docs, sample, rules).first()["marks"] if own for y in own]
    assert len(marks) == 9 and max(y["weight"] for y in marks) == pytest.approx(weight)
    some = docs.filter("doc_id < 600")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [sorted(map(tuple, quality.quality_rules(some, labels, quality.QualityRules(buckets=64, broadcast_rows=k)).collect())) for k in (0, 1 << 20)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found[0] == found[1]


def test_shards_and_mixture_take_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    names = "node grp shard slot phase share copy place __own".split()
    rows = [(i, f"text {i % 30}", "en", "big" if i % 4 else "small", *(100 * k + i for k in range(len(names)))) for i in range(60)] + [(None,) * (4 + len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    key = lambda t: sorted(t, key=repr)
    mixed = mixing.mixed_order(docs)
    assert mixed.columns == docs.columns and key(map(tuple, mixed.collect())) == key(rows)
    assert mixing.mix_sources(docs).columns[-4:] == ["phase", "slot", "mix_order", "share"]
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    for out in (sharding.sharded(docs, 4), corpus_pipeline.shard(spark, docs, str(tmp_path))):
        assert out.columns == [*kept, "shard", "slot"]
        assert key(map(tuple, out.select(*kept).collect())) == key(map(tuple, docs.select(*kept).collect()))
        assert all(r.shard < 8 and r.slot < 100 for r in out.collect())
