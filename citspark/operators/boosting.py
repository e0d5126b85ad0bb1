"""The boosting loop and the model it returns."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citspark.functions.columns import sigmoid
from citspark.sources.storage import cut_lineage, read_text, write_text

from . import metrics
from .objectives import COX, PAIRWISE, POINTWISE, cox_gradients, group_pairs, pairlogit_gradients, with_gradients
from .quantize import FeatureBins, fit_bins, with_bins
from .tree import Node, Tree, TreeParams, grow, number


#: What each name of a boosting type means.
BOOSTING_TYPES = {"gbdt": "gbdt", "gradientboosting": "gbdt", "rf": "rf", "randomforest": "rf", "dart": "dart"}
#: Objectives whose margin is a log-odds.
_LOGISTIC = ("logloss", "binary_logloss", "binary:logistic")


@dataclass(frozen=True)
class BoostParams:
    """Parameters of training; unknown objectives and boosting types are errors.

    bagging_temperature: power of the Bayesian weights; at 0 they are all one.
    drop_rate, skip_drop, max_drop: of DART; each earlier tree sits out an
    iteration with drop_rate, at least one and at most max_drop of them (0: no
    bound), and none with a chance of skip_drop.
    """

    objective: str = "rmse"
    iterations: int = 100
    learning_rate: float | Sequence[float] = 0.1
    tree: TreeParams = TreeParams()
    max_bins: int = 256
    nan_mode: str = "min"
    subsample: float = 1.0
    bootstrap: str = "no"
    bagging_temperature: float = 0.0
    colsample_bytree: float = 1.0
    boosting_type: str = "gbdt"
    drop_rate: float = 0.1
    skip_drop: float = 0.5
    max_drop: int = 50
    seed: int = 0
    early_stopping_rounds: int = 0
    eval_metric: str | None = None
    checkpoint_every: int = 5


@dataclass
class BoosterModel:
    """Trees over binned features; scores as column expressions."""

    features: list[str]
    bins: list[FeatureBins]
    trees: list[Tree] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)
    objective: str = "rmse"
    history: dict[str, list[float]] = field(default_factory=dict)
    best_iteration: int = -1

    def binned(self, df: DataFrame) -> DataFrame:
        return with_bins(df, self.bins, "__bins")

    def margin(self, n: int | None = None) -> Column:
        total = F.lit(0.0)
        for tree, rate in list(zip(self.trees, self.rates))[:n]:
            total = total + F.lit(rate) * tree.value("__bins")
        return total

    def transform(self, df: DataFrame, out: str = "prediction", n: int | None = None) -> DataFrame:
        """``df`` with its raw margin; works on streaming frames too."""
        return self.binned(df).withColumn(out, self.margin(n)).drop("__bins")

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """Probability of the class 1; only a logistic objective has one."""
        if self.objective.lower() not in _LOGISTIC:
            raise ValueError(f"{self.objective} gives no probabilities")
        return self.binned(df).withColumn(out, sigmoid(self.margin())).drop("__bins")

    def staged(self, df: DataFrame, out: str = "staged") -> DataFrame:
        """Margins after each iteration, as an array."""
        each = F.array(*(F.lit(r) * t.value("__bins") for t, r in zip(self.trees, self.rates)))
        start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("a"))
        run = F.aggregate(each, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")), lambda acc: acc["a"])
        return self.binned(df).withColumn(out, run).drop("__bins")

    def leaf_indices(self, df: DataFrame, out: str = "leaves") -> DataFrame:
        return self.binned(df).withColumn(out, F.array(*(t.value("__bins", "index") for t in self.trees))).drop("__bins")

    def contributions(self, df: DataFrame, out: str = "contributions") -> DataFrame:
        """Each leaf's value split equally over its path's splits; the last slot is the bias."""
        width = len(self.features) + 1

        def of(tree: Tree, rate: float, at: int, path: list[int]) -> Column:
            node = tree.nodes[at]
            if node.is_leaf:
                share = [0.0] * width
                for f in path or [width - 1]:
                    share[f] += rate * node.weight / len(path or [0])
                return F.array(*(F.lit(v) for v in share))
            return F.when(tree.goes_left(node, "__bins"), of(tree, rate, node.left, [*path, node.feature])).otherwise(of(tree, rate, node.right, [*path, node.feature]))

        total = F.array(*(F.lit(0.0) for _ in range(width)))
        for tree, rate in zip(self.trees, self.rates):
            total = F.zip_with(total, of(tree, rate, 0, []), lambda a, b: a + b)
        return self.binned(df).withColumn(out, total).drop("__bins")

    def feature_importances(self) -> dict[str, float]:
        """Gains of the chosen splits, as percent."""
        sums = [sum(x) for x in zip(*(t.importances(len(self.features)) for t in self.trees))] or [0.0] * len(self.features)
        total = sum(sums)
        return {f: 100 * s / total if total else 0.0 for f, s in zip(self.features, sums)}

    def sql(self) -> str:
        """The margin as one SQL expression over the raw columns, without missing values."""
        terms = [f"{number(r)} * ({t.sql(self.bins)})" for t, r in zip(self.trees, self.rates)]
        return " + ".join(terms) or "0e0"

    def to_json(self) -> str:
        return json.dumps(
            {
                "format": 1,
                "kind": "citspark.booster",
                "objective": self.objective,
                "features": self.features,
                "bins": [asdict(b) for b in self.bins],
                "rates": self.rates,
                "history": self.history,
                "best_iteration": self.best_iteration,
                "trees": [[[n.depth, n.weight, n.feature, n.bin, list(n.left_bins), n.gain, n.left, n.right] for n in t.nodes] for t in self.trees],
            }
        )

    @classmethod
    def from_json(cls, text: str) -> BoosterModel:
        d = json.loads(text)
        if d.get("kind") != "citspark.booster" or d.get("format") != 1:
            raise ValueError("not a booster document")
        bins = [FeatureBins.from_dict(b) for b in d["bins"]]
        trees = [Tree([Node(n[0], n[1], feature=n[2], bin=n[3], left_bins=tuple(n[4]), gain=n[5], left=n[6], right=n[7]) for n in t]) for t in d["trees"]]
        return cls(d["features"], bins, trees, d["rates"], d["objective"], d["history"], d["best_iteration"])

    def save(self, path: str) -> None:
        """Write the document to any file system that the session knows."""
        write_text(SparkSession.active(), path, self.to_json())

    @classmethod
    def load(cls, path: str) -> BoosterModel:
        return cls.from_json(read_text(SparkSession.active(), path))


def sample_weight(p: BoostParams, iteration: int, row_id: str) -> Column:
    """A row's weight in one iteration, from a hash of its id: the same on every run."""
    u = (F.pmod(F.xxhash64(F.lit(p.seed), F.lit(iteration), F.col(row_id)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    kind = p.bootstrap.lower()
    if kind == "bayesian":
        return F.pow(-F.log(u), F.lit(float(p.bagging_temperature))) if p.bagging_temperature > 0 else F.lit(1.0)
    if kind == "poisson" or (BOOSTING_TYPES[p.boosting_type.lower()] == "rf" and p.subsample >= 1 and kind == "no"):
        # Inverse of the Poisson distribution function, to eight.
        out, cumulative, term = F.lit(9.0), 0.0, math.exp(-p.subsample)
        steps = []
        for k in range(9):
            cumulative += term
            steps.append((cumulative, float(k)))
            term *= p.subsample / (k + 1)
        for c, k in reversed(steps):
            out = F.when(u < c, F.lit(k)).otherwise(out)
        return out
    return F.when(u < p.subsample, 1.0).otherwise(0.0) if p.subsample < 1 else F.lit(1.0)


def samples_rows(p: BoostParams) -> bool:
    """Whether ``sample_weight`` may differ between rows."""
    kind = p.bootstrap.lower()
    if kind == "bayesian":
        return p.bagging_temperature > 0
    return kind == "poisson" or p.subsample < 1 or BOOSTING_TYPES[p.boosting_type.lower()] == "rf"


def sample_features(p: BoostParams, iteration: int, eligible: list[int]) -> list[int]:
    k = max(1, math.ceil(p.colsample_bytree * len(eligible)))
    return eligible if k >= len(eligible) else sorted(random.Random(p.seed * 1_000_003 + iteration).sample(eligible, k))


def dropped_trees(p: BoostParams, iteration: int, trees: int) -> list[int]:
    """Places of the earlier trees that sit out one DART iteration; the same on every run."""
    rng = random.Random(p.seed * 1_000_003 + iteration)
    if not trees or p.drop_rate <= 0 or (p.skip_drop > 0 and rng.random() < p.skip_drop):
        return []
    out = [i for i in range(trees) if rng.random() < p.drop_rate] or [rng.randrange(trees)]
    return sorted(rng.sample(out, p.max_drop)) if 0 < p.max_drop < len(out) else out


def graded(rows: DataFrame, objective: str, p: str, grouped: bool = False) -> DataFrame:
    """``rows`` (row_id, y, p, and group_id for pairs) with g and h of any objective of one margin.

    Rows that are in no pair have gradient 0.
    """
    name = objective.lower()
    if name in COX:
        return cox_gradients(rows, p=p, y="y")
    if name in PAIRWISE:
        if not grouped:
            raise ValueError(f"{objective} needs a group column")
        sums = pairlogit_gradients(group_pairs(rows, p=p)).withColumnRenamed("row_id", "__row")
        joined = rows.join(sums, F.col("row_id") == F.col("__row"), "left").drop("__row")
        return joined.withColumn("g", F.coalesce("g", F.lit(0.0))).withColumn("h", F.coalesce("h", F.lit(0.0)))
    return with_gradients(rows, objective, p)


def fit(
    df: DataFrame,
    features: list[str],
    label: str,
    p: BoostParams = BoostParams(),
    weight: str | None = None,
    row_id: str = "row_id",
    valid: DataFrame | None = None,
    init: BoosterModel | None = None,
    callbacks: Sequence[Callable[[dict], bool]] = (),
    group: str | None = None,
    categorical: Sequence[str] = (),
) -> BoosterModel:
    """Train; ``valid`` turns on evaluation, ``init`` continues an earlier model.

    ``group`` names the column whose rows a pairwise objective compares.  Cox
    takes signed times: positive for events, negative for censored rows.
    ``categorical`` names the features whose values are keys.  Histories are weighted by ``weight`` where the metric takes weights.
    """
    kind = BOOSTING_TYPES.get(p.boosting_type.lower())
    if kind is None:
        raise ValueError(f"unknown boosting type {p.boosting_type!r}; known: {sorted(BOOSTING_TYPES)}")
    if p.objective.lower() not in {*POINTWISE, *COX, *PAIRWISE}:
        raise ValueError(f"unknown objective {p.objective!r}; known: {sorted({*POINTWISE, *COX, *PAIRWISE})}")
    joined = p.objective.lower() in {*COX, *PAIRWISE}
    bins = init.bins if init else fit_bins(df, features, p.max_bins, p.nan_mode, categorical=categorical)
    model = BoosterModel(features, bins, list(init.trees) if init else [], list(init.rates) if init else [], p.objective, {"train": [], "valid": []})
    name = p.eval_metric or p.objective
    earlier = len(model.trees)

    def prepared(frame: DataFrame) -> DataFrame:
        rows = model.binned(frame).withColumn("p", model.margin())
        own = F.col(row_id) if row_id in frame.columns else F.xxhash64(*features, label)
        base = F.col(weight).cast("double") if weight else F.lit(1.0)
        columns = [own.alias("row_id"), F.col(label).cast("double").alias("y"), base.alias("base_w"), "__bins", "p"]
        return rows.select(*columns, *([F.col(group).alias("group_id")] if group else [])).persist()

    def score(r: DataFrame) -> float:
        return float(metrics.evaluate_rows(r, name, "base_w" if weight else None, bool(group)).first()[0])

    rows, held = prepared(df), prepared(valid) if valid is not None else None
    kept = [rows] + ([held] if held is not None else [])
    if kind == "rf":
        rows = rows.withColumn("p0", F.col("p"))
    eligible = [i for i in range(len(features)) if not p.tree.feature_weights or p.tree.feature_weights[i] > 0]
    sign = 1 if metrics.higher_is_better(name) else -1
    best, best_at = -math.inf, -1
    for it in range(p.iterations):
        rate = float(p.learning_rate if isinstance(p.learning_rate, (int, float)) else p.learning_rate[it])
        out = dropped_trees(p, it, len(model.trees)) if kind == "dart" else []
        absent = sum((F.lit(model.rates[i]) * model.trees[i].value("__bins") for i in out), F.lit(0.0))
        seen = rows.withColumn("__p", F.col("p0") if kind == "rf" else F.col("p") - absent if out else F.col("p"))
        own = graded(seen, p.objective, "__p", bool(group)).withColumn("w", F.col("base_w") * sample_weight(p, it, "row_id"))
        own = own.withColumnRenamed("__bins", "bins")
        if joined:  # these gradients take joins, which no level should repeat
            own = own.persist()
        tree = grow(own, p.tree, sample_features(p, it, eligible), frozenset(i for i, b in enumerate(bins) if b.categorical))
        if joined:
            own.unpersist()
        # Dropped trees shrink to make room for the new one.
        share = 1 / (len(out) + 1)
        model.trees.append(tree)
        model.rates.append(rate * share)
        for i in out:
            model.rates[i] *= 1 - share
        moved = F.lit(rate * share) * tree.value("__bins") - (F.lit(share) * absent if out else F.lit(0.0))
        step = lambda r, m=moved: r.withColumn("p", F.col("p") + m)
        rows, held = step(rows), step(held) if held is not None else None
        if (it + 1) % p.checkpoint_every == 0:
            rows, held = cut_lineage(rows), cut_lineage(held) if held is not None else None
        model.history["train"].append(score(rows))
        if held is not None:
            value = score(held)
            model.history["valid"].append(value)
            if sign * value > best:
                best, best_at = sign * value, it
            if p.early_stopping_rounds and it - best_at >= p.early_stopping_rounds:
                if kind != "dart":  # later iterations have rescaled what DART would go back to
                    keep = earlier + best_at + 1
                    model.trees, model.rates = model.trees[:keep], model.rates[:keep]
                break
        if any(c({"model": model, "iteration": it, "history": model.history}) for c in callbacks):
            break
    for r in kept:
        r.unpersist()
    model.best_iteration = earlier + best_at if held is not None else len(model.trees) - 1
    return model
