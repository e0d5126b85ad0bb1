"""Objectives, metrics, quantization, trees and boosting against closed forms."""

import functools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citspark.functions import columns as C
from citspark.operators import features as X
from citspark.operators import metrics as M
from citspark.operators import objectives as O
from citspark.operators import quantize as Q
from citspark.operators.boosting import BoosterModel, BoostParams, fit
from citspark.operators import stats as S
from citspark.operators.stats import chi2_sf
from citspark.operators.tree import Node, TreeParams, _allowed, _groups_below, best_split, feature_test


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "name,g,h",
    [
        ("rmse", lambda p, y: p - y, lambda p, y: 1),
        ("mae", lambda p, y: float(np.sign(p - y)), lambda p, y: 1),
        ("huber", lambda p, y: max(-1, min(1, p - y)), lambda p, y: float(abs(p - y) <= 1)),
        ("poisson", lambda p, y: math.exp(p) - y, lambda p, y: math.exp(p)),
        ("logloss", lambda p, y: 1 / (1 + math.exp(-p)) - y, lambda p, y: math.exp(-p) / (1 + math.exp(-p)) ** 2),
    ],
)
def test_gradients(spark, name, g, h):
    rows = [(p, y) for p in (-2.0, 0.0, 0.5, 3.0) for y in (0.0, 1.0)]
    for r in O.with_gradients(frame(spark, rows, "p double, y double"), name).collect():
        assert r.g == pytest.approx(g(r.p, r.y)) and r.h == pytest.approx(h(r.p, r.y))
    with pytest.raises(ValueError):
        O.with_gradients(frame(spark, rows, "p double, y double"), "unheard-of")


def test_cox_and_pairs(spark):
    rows = [(0, 0.1, 1.0), (1, 0.5, -2.0), (2, -0.3, 2.0), (3, 0.0, 3.0)]
    got = {r.row_id: r for r in O.cox_gradients(frame(spark, rows, "row_id long, p double, y double")).collect()}
    assert sum(r.g for r in got.values()) == pytest.approx(0) and all(r.h > 0 for r in got.values())
    ranked = frame(spark, [(1, 7, 2.0, 0.3), (2, 7, 1.0, 0.9), (3, 8, 1.0, 0.0)], "row_id long, group_id long, y double, p double")
    pairs = O.group_pairs(ranked)
    assert [(r.winner, r.loser) for r in pairs.collect()] == [(1, 2)]
    assert sum(r.g for r in O.pairlogit_gradients(pairs).collect()) == pytest.approx(0)


def test_metrics(spark):
    rows = [(0.9, 1.0), (0.1, 0.0), (-0.4, 1.0), (0.1, 1.0), (-2.0, 0.0)]
    df = frame(spark, rows, "p double, y double")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert M.evaluate(df, "auc").first().value == pytest.approx(auc)
    assert M.evaluate(df, "rmse").first().value == pytest.approx(np.sqrt(np.mean([(p - y) ** 2 for p, y in rows])))
    assert M.higher_is_better("auc") and not M.higher_is_better("rmse")
    assert M.evaluate(df.filter("y = 1"), "auc").first().value == 0
    with pytest.raises(ValueError):
        M.evaluate(df, "unheard-of")


def test_quantile_cuts(spark):
    nine = frame(spark, [(float(v),) for v in (7, 1, 3, 9, 5, 2, 8, 4, 6)], "v double")
    assert Q.quantile_cuts(nine, "v", 4) == [3, 5, 7]
    many = list(range(1, 4097))
    random.Random(7).shuffle(many)
    assert Q.quantile_cuts(frame(spark, [(float(v),) for v in many], "v double"), "v", 8) == [513, 1025, 1537, 2049, 2561, 3073, 3585]


def test_quantile_cuts_are_exact_beyond_a_million_values(spark):
    n = 1_200_000
    # Half of the rows share the least value, which is never a cut.
    df = spark.range(2 * n).select(F.when(F.col("id") < n, 0).otherwise(F.col("id") - n).cast("double").alias("v"))
    want = sorted({max(0, b * 2 * n // 7 - n) for b in range(1, 7)} - {0})
    assert Q.quantile_cuts(df, "v", 7) == want


def test_missing_bins(spark):
    df = frame(spark, [(1.0,), (None,), (float("nan"),), (2.0,), (3.0,)], "v double")
    for mode, want in (("min", [1, 0, 0, 2, 3]), ("max", [0, 3, 3, 1, 2])):
        assert [r.b for r in Q.with_bins(df, Q.fit_bins(df, ["v"], 8, mode)).select(F.get("bins", F.lit(0)).alias("b")).collect()] == want
    with pytest.raises(ValueError):
        Q.fit_bins(df, ["v"], 8, "forbidden")


def test_statistic():
    aligned = {b: (64.0, 64.0 * (b - 1.5), 64.0, 64.0 * (b - 1.5) ** 2) for b in range(4)}
    chi, df, p = feature_test(aligned)
    assert df == 3 and chi > 100 and p < 1e-10
    for x, k, want in ((3.841458820694124, 1, 0.05), (11.070497693516351, 5, 0.05), (2.0, 2, math.exp(-1))):
        assert chi2_sf(x, k) == pytest.approx(want, rel=1e-9)
    assert best_split(aligned, TreeParams())[1] == 1


def test_columns(spark):
    df = frame(spark, [("A b_c-D9 é", [3.0, 4.0])], "t string, e array<float>")
    r = df.select(C.ascii_tokens(F.col("t")).alias("t"), *(c.alias(k) for k, c in C.embedding_stats(F.col("e")).items())).first()
    assert r.t == ["a", "b_c", "d9"] and (r["mean"], r.l2, r.dim) == (3.5, 5.0, 2.0)
    assert C.sanitize_name("a b!") == "a_b" and C.sanitize_name("!!") == "value"


def test_features(spark):
    df = frame(spark, [(1, "a", 1.0), (2, "b", 0.0), (3, "a", 0.0), (4, None, 1.0)], "i long, k string, y double")
    codes = X.dictionary(df, "k")
    assert {r.i: r.code for r in X.encode(df, codes, "k").collect()} == {1: 1, 2: 2, 3: 1, 4: 0}
    ctr = {r.i: r.ctr for r in X.ordered_mean(df, "k", "y", "i", F.lit(0.5)).collect()}
    assert ctr == {1: 0.5, 2: 0.5, 3: 0.75, 4: 0.5}
    assert [r.weight for r in X.class_weights(df, "y").collect()] == [1.0, 1.0]
    assert {r.fold for r in X.folds(df, 2, "i", stratify="y").collect()} == {0, 1}


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + 0.5 * x[:, 1]
    return frame(spark, [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, y double").cache()


def test_boosting_learns_explains_and_round_trips(spark, regression, tmp_path):
    p = BoostParams(iterations=4, learning_rate=0.5, max_bins=16, tree=TreeParams(max_depth=2))
    model = fit(regression, ["a", "b", "c"], "y", p)
    assert model.history["train"] == sorted(model.history["train"], reverse=True)
    assert model.feature_importances()["a"] > 50
    scored = model.contributions(model.staged(model.transform(regression)))
    rows = scored.collect()
    for r in rows:
        assert sum(r.contributions) == pytest.approx(r.prediction) and r.staged[-1] == pytest.approx(r.prediction)
    model.save(f"{tmp_path}/m.json")
    again = BoosterModel.load(f"{tmp_path}/m.json")
    assert [r.prediction for r in again.transform(regression).orderBy("row_id").collect()] == pytest.approx([r.prediction for r in sorted(rows, key=lambda r: r.row_id)])
    by_sql = regression.select("row_id", F.expr(model.sql()).alias("s")).orderBy("row_id").collect()
    assert [r.s for r in by_sql] == pytest.approx([r.prediction for r in sorted(rows, key=lambda r: r.row_id)])


def test_constraints_and_budgets(spark, regression):
    one = lambda **k: fit(regression, ["a", "b", "c"], "y", BoostParams(iterations=1, max_bins=16, tree=TreeParams(**k))).trees[0]
    assert all(n.is_leaf for n in one(max_depth=3, alpha=-1.0).nodes)
    assert sum(n.is_leaf for n in one(max_depth=4, max_leaves=3).nodes) == 3
    assert all(n.feature != 0 for n in one(max_depth=2, feature_weights=(0.0, 1.0, 1.0)).nodes)
    rising = fit(regression, ["a", "b", "c"], "y", BoostParams(iterations=2, max_bins=16, tree=TreeParams(max_depth=2, monotone=(1, 0, 0))))
    grid = frame(spark, [(float(v), 0.0, 0.0) for v in np.linspace(-2, 2, 21)], "a double, b double, c double")
    scores = [r.prediction for r in rising.transform(grid).collect()]
    assert scores == sorted(scores)


def test_early_stopping_and_warm_start(spark, regression):
    p = lambda n, **k: BoostParams(iterations=n, learning_rate=0.5, max_bins=8, tree=TreeParams(max_depth=1), **k)
    stopped = fit(regression, ["c"], "y", p(6, early_stopping_rounds=1), valid=regression.withColumn("y", -F.col("y")))
    assert len(stopped.trees) == stopped.best_iteration + 1 < 6
    whole = fit(regression, ["a"], "y", p(3))
    more = fit(regression, ["a"], "y", p(1), init=fit(regression, ["a"], "y", p(2)))
    a, b = (m.transform(regression).orderBy("row_id").collect() for m in (whole, more))
    assert [r.prediction for r in a] == pytest.approx([r.prediction for r in b])


def test_entry_without_the_training_data_folders():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cox_training_orders_the_risks(spark):
    rng = random.Random(4)
    rows = []
    for i in range(220):
        x = [rng.gauss(0, 1) for _ in range(4)]
        time = rng.expovariate(math.exp(x[0] - 0.5 * x[1]))
        rows.append((i, *x, time if rng.random() < 0.7 else -time))
    df = frame(spark, rows, "row_id long, a double, b double, c double, d double, y double")
    p = BoostParams(objective="survival:cox", iterations=6, learning_rate=0.15, tree=TreeParams(max_depth=2, alpha=1.0))
    model = fit(df, ["a", "b", "c", "d"], "y", p)
    scored = model.transform(df, "p")
    assert M.evaluate(scored, "concordance_index").first().value > 0.6
    assert model.history["train"][-1] < model.history["train"][0]


def test_pairwise_training_orders_groups(spark):
    rng = random.Random(5)
    rows = [(g * 5 + k, g, rng.gauss(0, 0.3) + k, rng.gauss(0, 1), float(k)) for g in range(24) for k in range(5)]
    df = frame(spark, rows, "row_id long, q long, a double, b double, y double")
    p = BoostParams(objective="ranknet", iterations=5, learning_rate=0.2, tree=TreeParams(max_depth=2, alpha=1.0))
    model = fit(df.filter("q < 18"), ["a", "b"], "y", p, group="q")
    scored = {r.row_id: r for r in model.transform(df.filter("q >= 18")).collect()}
    pairs = [(x, z) for x in scored.values() for z in scored.values() if x.q == z.q and x.y > z.y]
    assert sum(x.prediction > z.prediction for x, z in pairs) / len(pairs) > 0.9
    with pytest.raises(ValueError, match="group"):
        fit(df, ["a", "b"], "y", p)


def test_dart_drops_trees_and_keeps_its_margins(spark):
    rng = random.Random(6)
    rows = [(i, x := rng.random(), 3 * x + rng.gauss(0, 0.1)) for i in range(300)]
    df = frame(spark, rows, "row_id long, a double, y double")
    common = {"iterations": 4, "learning_rate": 0.5, "max_bins": 16, "tree": TreeParams(max_depth=2)}
    plain = fit(df, ["a"], "y", BoostParams(**common))
    dart = fit(df, ["a"], "y", BoostParams(**common, boosting_type="dart", drop_rate=0.5, skip_drop=0.0))
    assert dart.rates != plain.rates and len(set(dart.rates)) > 1
    assert M.evaluate(dart.transform(df, "p"), "rmse").first().value == pytest.approx(dart.history["train"][-1])
    assert fit(df, ["a"], "y", BoostParams(**common, boosting_type="dart", drop_rate=0.0)).rates == plain.rates
    with pytest.raises(ValueError, match="boosting type"):
        fit(df, ["a"], "y", BoostParams(boosting_type="unheard-of"))


def test_aliases_of_objectives_train_and_probabilities_need_a_logistic_one(spark):
    df = frame(spark, [(i, float(i % 7), float(i % 7 > 3)) for i in range(60)], "row_id long, a double, y double")
    one = BoostParams(objective="binary:logistic", iterations=1, tree=TreeParams(max_depth=1))
    assert all(0 < r.probability < 1 for r in fit(df, ["a"], "y", one).predict_proba(df).collect())
    more = fit(df, ["a"], "y", BoostParams(objective="squarederror", iterations=1, tree=TreeParams(max_depth=1)), init=fit(df, ["a"], "y", one), valid=df)
    assert more.best_iteration == 1
    with pytest.raises(ValueError, match="probabilities"):
        more.predict_proba(df)


def test_interaction_groups_meet_along_a_path():
    p = TreeParams(interactions=((0, 1), (0, 2)))
    root = Node(0)
    after = lambda *fs: functools.reduce(lambda node, f: Node(node.depth + 1, groups=_groups_below(f, node, p)), fs, root)
    assert all(_allowed(f, root, p) for f in range(4))
    assert [_allowed(f, after(0), p) for f in range(4)] == [True, True, True, True]
    assert [_allowed(f, after(0, 1), p) for f in range(4)] == [True, True, False, True]
    assert [_allowed(f, after(1, 3), p) for f in range(4)] == [True, True, False, True]


def test_running_best_over_ranges(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, rng.random()])) for i in range(500)]
    for higher, best in ((False, min), (True, max)):
        found = {r.t: r.best for r in S.running_best(frame(spark, rows, "t long, v double"), "t", "v", higher, ranges=7).collect()}
        so_far = []
        for t, v in rows:
            so_far += [v] if v is not None else []
            assert found[t] == (best(so_far) if so_far else None)
    assert S.running_best(frame(spark, [], "t long, v double"), "t", "v").count() == 0
