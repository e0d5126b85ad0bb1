"""Multiclass boosting: one tree structure an iteration, refitted for every class."""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citspark.functions.columns import argmax, leaf_weight, softmax
from citspark.sources.storage import cut_lineage

from . import metrics
from .boosting import BoostParams, sample_features, sample_weight, samples_rows
from .features import class_weights
from .objectives import softmax_gradients
from .quantize import FeatureBins, fit_bins, with_bins
from .tree import Node, Tree, grow

#: Rows of one label and equal bins train as one row where so few kinds of them can occur.
KINDS = 1 << 16


@dataclass
class MulticlassModel:
    """``classes`` trees an iteration, all of one structure; scores as an array column."""

    features: list[str]
    bins: list[FeatureBins]
    classes: int
    trees: list[list[Tree]] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)
    history: dict[str, list[float]] = field(default_factory=dict)
    best_iteration: int = -1

    def margins(self, n: int | None = None) -> Column:
        """Margins of all classes after ``n`` iterations (None: all)."""
        rounds = list(zip(self.trees, self.rates))[:n]
        return F.array(*(sum((F.lit(r) * t[k].value("__bins") for t, r in rounds), F.lit(0.0)) for k in range(self.classes)))

    def _with(self, df: DataFrame, out: str, value: Callable[[Column], Column], n: int | None = None) -> DataFrame:
        return with_bins(df, self.bins, "__bins").withColumn("__m", self.margins(n)).withColumn(out, value(F.col("__m"))).drop("__bins", "__m")

    def transform(self, df: DataFrame, out: str = "prediction", n: int | None = None) -> DataFrame:
        """``df`` with its array of margins."""
        return self._with(df, out, lambda m: m, n)

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        return self._with(df, out, softmax)

    def predict_class(self, df: DataFrame, out: str = "class") -> DataFrame:
        """The class of the largest margin; the first of equal ones."""
        return self._with(df, out, argmax)

    def to_json(self) -> str:
        trees = [[[[n.depth, n.weight, n.feature, n.bin, list(n.left_bins), n.gain, n.left, n.right] for n in t.nodes] for t in ts] for ts in self.trees]
        return json.dumps({"format": 1, "kind": "citspark.multiclass", "features": self.features, "classes": self.classes, "bins": [asdict(b) for b in self.bins], "rates": self.rates, "history": self.history, "best_iteration": self.best_iteration, "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> MulticlassModel:
        d = json.loads(text)
        if d.get("kind") != "citspark.multiclass" or d.get("format") != 1:
            raise ValueError("not a multiclass document")
        node = lambda n: Node(n[0], n[1], feature=n[2], bin=n[3], left_bins=tuple(n[4]), gain=n[5], left=n[6], right=n[7])
        return cls(d["features"], [FeatureBins.from_dict(b) for b in d["bins"]], d["classes"], [[Tree([node(n) for n in t]) for t in ts] for ts in d["trees"]], d["rates"], d["history"], d["best_iteration"])


def structure_class(rows: DataFrame, classes: int, g: str = "g", w: str = "w") -> int:
    """The class whose weighted gradients vary most; the first of equal ones."""
    of = lambda k: F.get(F.col(g), F.lit(k))
    sums = rows.agg(F.sum(w).alias("w"), *(F.sum(of(k) * F.col(w)).alias(f"a{k}") for k in range(classes)), *(F.sum(of(k) * of(k) * F.col(w)).alias(f"b{k}") for k in range(classes))).first()
    if not sums.w:
        return 0
    spread = [sums[f"b{k}"] / sums.w - (sums[f"a{k}"] / sums.w) ** 2 for k in range(classes)]
    return max(range(classes), key=lambda k: (spread[k], -k))


def refit(tree: Tree, rows: DataFrame, classes: int, l2: float, bins: str = "bins") -> list[Tree]:
    """``tree`` for every class: leaf weights from that class's gradients, by one aggregation."""
    sums = {}
    for k in range(classes):
        sums[k] = leaf_weight(F.sum(F.get("g", F.lit(k)) * F.col("w")), F.sum(F.get("h", F.lit(k)) * F.col("w")), l2).alias(f"w{k}")
    found = {r.leaf: r for r in rows.groupBy(tree.value(bins, "index").alias("leaf")).agg(*sums.values()).collect()}
    out = []
    for k in range(classes):
        own = copy.deepcopy(tree)
        for i, node in enumerate(own.nodes):
            if node.is_leaf:
                node.weight = float(found[i][f"w{k}"] or 0.0) if i in found else 0.0
        out.append(own)
    return out


def fit_multiclass(
    df: DataFrame,
    features: list[str],
    label: str,
    classes: int,
    p: BoostParams = BoostParams(objective="multiclass"),
    weight: str | None = None,
    row_id: str = "row_id",
    valid: DataFrame | None = None,
    categorical: Sequence[str] = (),
    class_weight: str | Mapping[int, float] | None = None,
) -> MulticlassModel:
    """Train on whole labels 0..classes - 1; others are errors.

    Each iteration grows one tree on the gradients of the class whose gradients
    vary most and refits its leaves for every class.  ``class_weight`` is
    "balanced" or weights by class, and multiplies ``weight``.

    Rows of one label and equal bins have the same margins, and all sums are linear
    in the weights: with few bins each kind of row is one row of its summed weight,
    so an iteration costs the kinds, not the rows.  Rows sampled one by one stay apart.
    """
    if classes < 2:
        raise ValueError("at least two classes are needed")
    odd = df.filter(F.col(label).isNull() | (F.col(label) != F.rint(F.col(label).cast("double"))) | (F.col(label) < 0) | (F.col(label) >= classes))
    if not odd.isEmpty():
        raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}")
    if class_weight == "balanced":
        by_class = {int(r[0]): float(r[1]) for r in class_weights(df, label).collect()}  # one row a class
    else:
        by_class = {int(k): float(v) for k, v in (class_weight or {}).items()}
    model = MulticlassModel(features, fit_bins(df, features, p.max_bins, p.nan_mode, categorical=categorical), classes, history={"train": [], "valid": []})
    name = p.eval_metric or "multiclass"

    def prepared(frame: DataFrame) -> DataFrame:
        own = F.col(row_id) if row_id in frame.columns else F.xxhash64(*features, label)
        base = F.col(weight).cast("double") if weight else F.lit(1.0)
        y = F.col(label).cast("int")
        for k, v in by_class.items():
            base = F.when(y == k, base * v).otherwise(base) if v != 1 else base
        each = with_bins(frame, model.bins, "__bins").select(own.alias("row_id"), y.alias("y"), base.alias("base_w"), "__bins", F.lit(1).cast("long").alias("n"))
        if few:
            each = each.groupBy("y", "__bins").agg(F.lit(0).alias("row_id"), F.sum("base_w").alias("base_w"), F.sum("n").alias("n"))
        return each.persist()

    few = not samples_rows(p) and classes * math.prod(b.bins + 1 for b in model.bins) <= KINDS
    kept = [prepared(df)] + ([prepared(valid)] if valid is not None else [])
    start = F.array(*(F.lit(0.0) for _ in range(classes)))
    rows, held = (kept[i].withColumn("p", start) if i < len(kept) else None for i in range(2))
    eligible = [i for i in range(len(features)) if not p.tree.feature_weights or p.tree.feature_weights[i] > 0]
    cats = frozenset(i for i, b in enumerate(model.bins) if b.categorical)
    sign = 1 if metrics.higher_is_better(name) else -1
    score = lambda r: float(metrics.evaluate_rows(r, name, "base_w").first()[0])
    best, best_at = float("-inf"), -1
    for it in range(p.iterations):
        rate = float(p.learning_rate if isinstance(p.learning_rate, (int, float)) else p.learning_rate[it])
        own = softmax_gradients(rows, classes).withColumn("w", F.col("base_w") * sample_weight(p, it, "row_id")).withColumnRenamed("__bins", "bins")
        k = structure_class(own, classes)
        one = own.withColumn("g", F.get("g", F.lit(k))).withColumn("h", F.get("h", F.lit(k)))
        trees = refit(grow(one, p.tree, sample_features(p, it, eligible), cats, n="n"), own, classes, p.tree.lambda_l2)
        model.trees.append(trees)
        model.rates.append(rate)
        moved = F.array(*(F.lit(rate) * t.value("__bins") for t in trees))
        step = lambda r, m=moved: r.withColumn("p", F.zip_with("p", m, lambda a, b: a + b))
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
                model.trees, model.rates = model.trees[: best_at + 1], model.rates[: best_at + 1]
                break
    for r in kept:
        r.unpersist()
    model.best_iteration = best_at if held is not None else len(model.trees) - 1
    return model
