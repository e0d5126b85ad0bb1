"""Categories, classes, preparation, running sums, snapshots: against brute force."""

import hashlib
import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from citspark.functions import columns
from citspark.functions.hashing import hashed_counts
from citspark.operators import callbacks, features, metrics, multiclass, objectives, prepare, running
from citspark.operators.boosting import BoosterModel, BoostParams, fit
from citspark.operators.multiclass import MulticlassModel, fit_multiclass
from citspark.operators.tree import TreeParams

STUMP = TreeParams(max_depth=1, alpha=1.0)


@pytest.fixture(scope="module")
def shops(spark):
    rng = random.Random(4)
    lift = {"a": 3.0, "b": -2.0, "c": 3.0, "d": -2.0, None: 0.5}
    rows = [(i, k := rng.choice(list(lift)), rng.random(), lift[k] + rng.random() / 10, ["a", "b", "c", "d", None].index(k) % 3) for i in range(400)]
    return spark.createDataFrame(rows, "row_id long, shop string, x double, y double, k int").cache()


def test_categories_split_together(spark, shops):
    model = fit(shops, ["shop", "x"], "y", BoostParams(iterations=3, learning_rate=0.9, max_bins=16, tree=TreeParams(max_depth=2)), categorical=["shop"])
    root = model.trees[0].nodes[0]
    keys = model.bins[0].keys
    assert model.features[root.feature] == "shop" and root.left_bins
    sides = {k: i in root.left_bins for i, k in enumerate(keys)}
    assert sides["a"] == sides["c"] != sides["b"] and sides["b"] == sides["d"]
    assert model.history["train"][-1] < 0.5
    again = BoosterModel.from_json(model.to_json())
    want = [r.prediction for r in model.transform(shops).orderBy("row_id").collect()]
    assert [r.prediction for r in again.transform(shops).orderBy("row_id").collect()] == want
    by_sql = shops.select("row_id", F.expr(model.sql()).alias("s")).orderBy("row_id").collect()
    assert [r.s for r in by_sql] == pytest.approx(want)
    new = spark.createDataFrame([("never seen", 0.5)], "shop string, x double")
    assert math.isfinite(model.transform(new).first().prediction)


def test_rare_categories_share_a_bin(spark, shops):
    model = fit(shops, ["shop"], "y", BoostParams(iterations=1, max_bins=3, tree=STUMP), categorical=["shop"])
    assert len(model.bins[0].keys) == 3 and "__other__" in model.bins[0].keys
    want = [r.prediction for r in model.transform(shops).orderBy("row_id").collect()]
    assert [r.s for r in shops.select("row_id", F.expr(model.sql()).alias("s")).orderBy("row_id").collect()] == pytest.approx(want)


def test_multiclass_shares_structures(spark, shops):
    p = BoostParams(objective="multiclass", iterations=4, learning_rate=0.8, tree=TreeParams(max_depth=2))
    model = fit_multiclass(shops, ["shop", "x"], "k", 3, p, categorical=["shop"], valid=shops)
    for trees in model.trees:
        shape = [[(n.feature, n.bin, n.left_bins, n.left, n.right) for n in t.nodes] for t in trees]
        assert len(trees) == 3 and shape[0] == shape[1] == shape[2]
    assert model.history["train"] == sorted(model.history["train"], reverse=True) == model.history["valid"]
    right = model.predict_class(shops).filter("class = k").count()
    assert right > 0.95 * shops.count()
    r = model.predict_proba(shops).first()
    assert sum(r.probability) == pytest.approx(1) and len(r.probability) == 3
    again = MulticlassModel.from_json(model.to_json())
    both = [[tuple(r.prediction) for r in m.transform(shops).orderBy("row_id").collect()] for m in (model, again)]
    assert both[0] == both[1]
    with pytest.raises(ValueError):
        fit_multiclass(shops, ["x"], "k", 2, p)


def test_multiclass_class_weights(spark):
    rows = [(i, float(i % 7), 0 if i % 10 else 1) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, x double, k int")
    p = BoostParams(objective="multiclass", iterations=1, learning_rate=1.0, tree=TreeParams(max_depth=0))
    plain, even = (fit_multiclass(df, ["x"], "k", 2, p, class_weight=w) for w in (None, "balanced"))
    assert [t.nodes[0].weight for t in even.trees[0]] == pytest.approx([0.0, 0.0], abs=1e-9)
    assert plain.trees[0][0].nodes[0].weight > 0 > plain.trees[0][1].nodes[0].weight


def test_concordance_and_running_sums_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.randint(0, 9)) / 3, float(rng.choice((-1, 1)) * rng.randint(1, 40)), rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, p double, y double, k string")
    good = total = 0.0
    for _, p1, y1, _ in rows:
        for _, p2, y2, _ in rows if y1 > 0 else ():
            if abs(y2) > y1:
                total += 1
                good += 1.0 if p1 > p2 else 0.5 if p1 == p2 else 0.0
    assert metrics.concordance(df).first().value == pytest.approx(good / total)
    assert metrics.concordance(df.limit(0)).first().value == 0
    for down in (False, True):
        got = {r.i: r.s for r in running.running_sums(df, "i", {"s": F.col("p")}, keys=("k",), descending=down, ranges=7).collect()}
        for i, _, _, k in rows:
            assert got[i] == pytest.approx(sum(q for j, q, _, m in rows if m == k and (j >= i if down else j <= i)))
    freq = {r.i: r.freq for r in features.ordered_frequency(df, "k", "i").collect()}
    share = {k: sum(r[3] == k for r in rows) / len(rows) for k in "ab"}
    for i, _, _, k in rows:
        assert freq[i] == pytest.approx((sum(r[3] == k for r in rows[:i]) + share[k]) / (i + 1))
    assert objectives.cox_gradients(df).count() == len(rows)


def test_class_statistics_and_lookups(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, "a", 1), (5, None, 0), (6, None, 0)], "i long, k string, y int")
    got = {r.i: (r.ctr_0, r.ctr_1) for r in features.ordered_class_means(df, "k", "y", "i", 2).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.75, 0.25), 3: (0.5, 0.5), 4: (0.5, 0.5), 5: (0.5, 0.5), 6: (0.75, 0.25)}
    table = features.full_mean(df.filter("k = 'a'"), "k", "y", F.lit(0.5))
    assert {r.i: r.ctr for r in features.ctr_lookup(df, table, "k", F.lit(0.5)).collect()} == {1: 0.625, 2: 0.625, 3: 0.5, 4: 0.625, 5: 0.5, 6: 0.5}


def test_preparation(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, 4.0, "x"), (3, 8.0, "y"), (4, 6.0, None)], "i long, v double, k string")
    assert [r.v for r in prepare.fill_median(df, "v").orderBy("i").collect()] == [6.0, 4.0, 8.0, 6.0]
    assert [r.k for r in prepare.fill_constant(df, {"k": "z"}).orderBy("i").collect()] == ["x", "x", "y", "z"]
    assert [r.k for r in prepare.collapse_rare(df, "k", 2).orderBy("i").collect()] == ["x", "x", "rare", None]
    assert [r.c for r in df.orderBy("i").select(prepare.clip(F.col("v"), 5.0, 7.0).alias("c")).collect()] == [None, 5.0, 7.0, 6.0]
    prepare.write_submission(df, f"{tmp_path}/out", "i", "k")
    assert sorted(map(tuple, prepare.read_csv(spark, f"{tmp_path}/out", "i long, k string").collect()), key=repr) == [(1, "x"), (2, "x"), (3, "y"), (4, None)]
    split = prepare.stratified_split(spark.range(1000).withColumn("c", (F.col("id") % 10 == 0).cast("int")), "c", "id", 0.3)
    assert {(r.c, r.n) for r in split.filter("held_out").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 270), (1, 30)}
    top = prepare.top_importances(spark, {"a": 1.0, "b": 3.0, "c": 1.0}, 2)
    assert [r.feature for r in top.collect()] == ["b", "a"]


def test_hashed_counts(spark):
    texts = ["A b_c b_c, d9", "", None]
    got = [list(r.c) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hashed_counts(F.col("t"), 8).alias("c")).collect()]
    want = [0.0] * 8
    for t in ("a", "b_c", "b_c", "d9"):
        want[int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") % 8] += 1
    assert got == [want, [0.0] * 8, [0.0] * 8]


def test_snapshots_resume(spark, shops, tmp_path):
    p, path = BoostParams(iterations=4, learning_rate=0.5, max_bins=8, tree=TreeParams(max_depth=1)), f"{tmp_path}/snap.json"
    lines = []
    callbacks.fit_with_snapshots(shops, ["x"], "y", replace(p, iterations=2), path, callbacks=(callbacks.log_evaluation(1, lines.append),))
    assert len(lines) == 2 and "train:" in lines[0]
    assert len(json.load(open(path))["model"]["trees"]) == 2
    whole, resumed = fit(shops, ["x"], "y", p), callbacks.fit_with_snapshots(shops, ["x"], "y", p, path)
    both = [[r.prediction for r in m.transform(shops).orderBy("row_id").collect()] for m in (whole, resumed)]
    assert both[0] == pytest.approx(both[1])
    with pytest.raises(ValueError):
        callbacks.fit_with_snapshots(shops, ["x"], "y", replace(p, learning_rate=0.1), path)


def test_weighted_rank_and_survival_metrics_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, i % 9, rng.random(), float(rng.randint(0, 2)), rng.choice((0.0, 0.5, 2.0)), float(i % 9 % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, group_id long, p double, y double, w double, gw double")
    sums = {k: [0.0, 0.0] for k in ("ndcg", "map", "mrr")}
    pairs = [0.0, 0.0]
    for g in range(9):
        own = [r for r in rows if r[1] == g]
        ranked, ideal = sorted(own, key=lambda r: (-r[2], r[0])), sorted(own, key=lambda r: (-r[3], r[0]))
        dcg = [sum(r[4] * (2 ** r[3] - 1) / math.log2(k + 2) for k, r in enumerate(x)) for x in (ranked, ideal)]
        hits = [k for k, r in enumerate(ranked, 1) if r[3] > 0]
        gw = own[0][5]
        values = {"ndcg": dcg[0] / dcg[1] if dcg[1] else None, "map": sum(n / k for n, k in enumerate(hits, 1)) / len(hits) if hits and any(r[4] > 0 for r in own if r[3] > 0) else None, "mrr": 1 / hits[0] if hits else None}
        for k, v in values.items():
            if v is not None:
                sums[k] = [sums[k][0] + gw * v, sums[k][1] + gw]
        for a in own:
            for b in own:
                if a[3] > b[3]:
                    pairs = [pairs[0] + a[4] * b[4] * math.log1p(math.exp(b[2] - a[2])), pairs[1] + a[4] * b[4]]
    for k, (a, b) in sums.items():
        takes = {} if k == "mrr" else {"w": "w"}
        assert metrics.evaluate(df, k, group_weight="gw", **takes).first().value == pytest.approx(a / b)
    assert metrics.evaluate_rows(df, "pairlogit", w="w", grouped=True).first().value == pytest.approx(pairs[0] / pairs[1])
    times = [(r[0], r[2], float(rng.choice((-1, 1)) * rng.randint(1, 12)), r[4]) for r in rows]
    survival = spark.createDataFrame(times, "row_id long, p double, y double, w double")
    events = [r for r in times if r[2] > 0]
    loss = sum(r[3] * (math.log(sum(math.exp(x[1]) for x in times if abs(x[2]) >= r[2])) - r[1]) for r in events)
    assert metrics.evaluate(survival, "cox", w="w").first().value == pytest.approx(loss / sum(r[3] for r in events))
    met = [(a[3] * b[3], 1.0 if a[1] > b[1] else 0.5 if a[1] == b[1] else 0.0) for a in events for b in times if abs(b[2]) > a[2]]
    assert metrics.evaluate(survival, "cindex", w="w").first().value == pytest.approx(sum(x * v for x, v in met) / sum(x for x, _ in met))
    assert metrics.evaluate(survival.filter("y < 0"), "cox").first().value == 0


def test_multiclass_trains_on_kinds_of_rows(spark, shops, monkeypatch):
    """Rows of one label and equal bins are one row to a level, with the trees that all rows give."""
    seen, grow = [], multiclass.grow
    monkeypatch.setattr(multiclass, "grow", lambda rows, *a, **k: (seen.append(rows.count()), grow(rows, *a, **k))[1])
    rows = shops.withColumn("v", F.col("x") + 0.5)
    p = BoostParams(objective="multiclass", iterations=2, learning_rate=0.8, max_bins=4, tree=TreeParams(max_depth=2, alpha=1.0, min_samples_split=150))
    fitted = lambda q=p: fit_multiclass(rows, ["shop", "x"], "k", 3, q, weight="v", categorical=["shop"], valid=rows.filter("row_id % 2 = 0"))
    merged = fitted()
    assert max(seen) <= 5 * 4 < rows.count()
    seen.clear()
    monkeypatch.setattr(multiclass, "KINDS", 0)
    apart = fitted()
    assert seen == [rows.count()] * 2
    for one, other in zip(merged.trees, apart.trees):
        for t, u in zip(one, other):
            assert [(n.feature, n.bin, n.left_bins, n.left, n.right) for n in t.nodes] == [(n.feature, n.bin, n.left_bins, n.left, n.right) for n in u.nodes]
            assert [n.weight for n in t.nodes] == pytest.approx([n.weight for n in u.nodes])
    assert len(merged.trees[0][0].nodes) > 1
    assert merged.history["train"] == pytest.approx(apart.history["train"]) and merged.history["valid"] == pytest.approx(apart.history["valid"])
    monkeypatch.undo()
    monkeypatch.setattr(multiclass, "grow", lambda rows, *a, **k: (seen.append(rows.count()), grow(rows, *a, **k))[1])
    seen.clear()
    fitted(replace(p, subsample=0.5))
    assert seen == [rows.count()] * 2  # sampled rows stay apart


def test_softmax_takes_each_step_once(spark):
    rng = random.Random(2)
    rows = [[rng.uniform(-30, 30) for _ in range(5)] for _ in range(50)] + [[], None, [800.0, 0.0]]
    df = spark.createDataFrame([(r,) for r in rows], "p array<double>").select("p", columns.softmax(F.col("p")).alias("s"))
    for r in df.collect():
        top = max(r.p or [0.0])
        total = sum(math.exp(v - top) for v in r.p or ())
        assert r.s == (None if r.p is None else pytest.approx([math.exp(v - top) / total for v in r.p]))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("exp(") == plan.count("array_max(") == 1


def test_rounding_without_decimals_is_round(spark):
    rng = random.Random(6)
    values = [(k + 0.5) / 10.0**d for d in (4, 6, 9) for k in range(-200, 200)] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 20) for _ in range(2000)]
    values += [0.0, -0.0, -1e-9, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for d in (0, 4, 6, 9):
        for r in df.select("x", F.round("x", d).alias("a"), columns.rounded(F.col("x"), d).alias("b")).collect():
            assert repr(r.a) == repr(r.b), (r.x, d)
