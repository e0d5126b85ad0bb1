"""Weighted metrics: each takes a DataFrame and returns one row, ``value``.

Pointwise metrics are one aggregation.  Rank metrics group by score or by group
before any window, so windows see distinct scores rather than rows.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citspark.functions.columns import argmax, sigmoid, softmax

from .objectives import group_pairs
from .running import running_sums

_EPS = 1e-12


def _mean(df: DataFrame, loss: Column, w: str | None) -> DataFrame:
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    return df.agg(F.sum(loss * weight).alias("__a"), F.sum(weight).alias("__b")).select(F.when(F.col("__b") > 0, F.col("__a") / F.col("__b")).otherwise(0.0).alias("value"))


def rmse(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    r = F.col(p) - F.col(y)
    return _mean(df, r * r, w).select(F.sqrt("value").alias("value"))


def mae(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    return _mean(df, F.abs(F.col(p) - F.col(y)), w)


def huber(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None, delta: float = 1.0) -> DataFrame:
    r = F.abs(F.col(p) - F.col(y))
    return _mean(df, F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta)), w)


def quantile(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None, alpha: float = 0.5) -> DataFrame:
    r = F.col(y) - F.col(p)
    return _mean(df, F.when(r > 0, alpha * r).otherwise((alpha - 1) * r), w)


def poisson(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    """Whole-number labels: log(y!) is a sum of logarithms."""
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(y).cast("int"))), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    return _mean(df, F.exp(F.col(p)) - F.col(y) * F.col(p) + log_factorial, w)


def tweedie(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None, rho: float = 1.5) -> DataFrame:
    return _mean(df, -F.col(y) * F.exp((1 - rho) * F.col(p)) / (1 - rho) + F.exp((2 - rho) * F.col(p)) / (2 - rho), w)


def logloss(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    s = F.greatest(F.lit(_EPS), F.least(F.lit(1 - _EPS), sigmoid(F.col(p))))
    return _mean(df, -(F.col(y) * F.log(s) + (1 - F.col(y)) * F.log(1 - s)), w)


def multi_logloss(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    s = F.greatest(F.lit(_EPS), F.get(softmax(F.col(p)), F.col(y).cast("int")))
    return _mean(df, -F.log(s), w)


def accuracy(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    guess = argmax(F.col(p)) if dict(df.dtypes)[p].startswith("array") else (F.col(p) >= 0).cast("int")
    return _mean(df, (guess == F.rint(F.col(y).cast("double")).cast("int")).cast("double"), w)


def balanced_accuracy(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    """Mean recall of the classes that occur."""
    guess = argmax(F.col(p)) if dict(df.dtypes)[p].startswith("array") else (F.col(p) >= 0).cast("int")
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    per = df.groupBy(F.rint(F.col(y).cast("double")).cast("int").alias("k")).agg(F.sum(F.when(guess == F.rint(F.col(y).cast("double")).cast("int"), weight).otherwise(0.0)).alias("a"), F.sum(weight).alias("b"))
    return per.filter("b > 0").agg(F.coalesce(F.avg(F.col("a") / F.col("b")), F.lit(0.0)).alias("value"))


def _confusion(df: DataFrame, p: str, y: str, w: str | None) -> DataFrame:
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    said, true = F.col(p) >= 0, F.rint(F.col(y).cast("double")) == 1
    count = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0))
    return df.agg(count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & true).alias("fn"))


def precision(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    return _confusion(df, p, y, w).select(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("value"))


def recall(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    return _confusion(df, p, y, w).select(F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("value"))


def f1(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    return _confusion(df, p, y, w).select(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("value"))


def auc(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    """Tie-aware; 0 when a class is missing."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    per = df.groupBy(F.col(p).alias("s")).agg(F.sum(F.when(F.col(y) > 0.5, weight).otherwise(0.0)).alias("a"), F.sum(F.when(F.col(y) > 0.5, 0.0).otherwise(weight)).alias("b"))
    upto = running_sums(per, "s", {"upto": F.col("b")})
    area = upto.select("a", "b", (F.col("a") * (F.col("upto") - 0.5 * F.col("b"))).alias("c")).agg(F.sum("c").alias("c"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return area.select(F.coalesce(F.try_divide("c", F.col("a") * F.col("b")), F.lit(0.0)).alias("value"))


def _ranked(df: DataFrame, p: str, y: str, group: str, row_id: str) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(F.col(p).desc(), F.col(row_id))))


def _weight(w: str | None) -> Column:
    return F.col(w).cast("double") if w else F.lit(1.0)


def _group_mean(per: DataFrame, value: Column) -> DataFrame:
    """Mean of the groups' values by their weights ``gw``; groups without weight are left out, 0 without groups."""
    return per.filter("gw > 0").agg(F.coalesce(F.try_divide(F.sum(value * F.col("gw")), F.sum("gw")), F.lit(0.0)).alias("value"))


def ndcg(df: DataFrame, p: str = "p", y: str = "y", group: str = "group_id", row_id: str = "row_id", w: str | None = None, group_weight: str | None = None) -> DataFrame:
    """Mean over groups of two rows or more with an ideal above 0; row weights scale gains, group weights the mean."""
    ideal = F.row_number().over(Window.partitionBy(group).orderBy(F.col(y).desc(), F.col(row_id)))
    value = lambda k: _weight(w) * (F.pow(F.lit(2.0), F.col(y)) - 1) / F.log2(F.col(k) + 1)
    per = _ranked(df, p, y, group, row_id).withColumn("__i", ideal).groupBy(group).agg(F.sum(value("__k")).alias("a"), F.sum(value("__i")).alias("b"), F.count(F.lit(1)).alias("n"), F.max(_weight(group_weight)).alias("gw"))
    return _group_mean(per.filter("n > 1 AND b > 0"), F.col("a") / F.col("b"))


def mean_average_precision(df: DataFrame, p: str = "p", y: str = "y", group: str = "group_id", row_id: str = "row_id", w: str | None = None, group_weight: str | None = None) -> DataFrame:
    """Row weights only tell which groups have a relevant row."""
    hit = (F.col(y) > 0).cast("int")
    hits = F.sum(hit).over(Window.partitionBy(group).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
    per = _ranked(df, p, y, group, row_id).withColumn("__h", hits).groupBy(group).agg(F.sum(hit * F.col("__h") / F.col("__k")).alias("a"), F.sum(hit).alias("b"), F.sum(hit * _weight(w)).alias("c"), F.max(_weight(group_weight)).alias("gw"))
    return _group_mean(per.filter("b > 0 AND c > 0"), F.col("a") / F.col("b"))


def mrr(df: DataFrame, p: str = "p", y: str = "y", group: str = "group_id", row_id: str = "row_id", group_weight: str | None = None) -> DataFrame:
    per = _ranked(df, p, y, group, row_id).filter(F.col(y) > 0).groupBy(group).agg(F.min("__k").alias("k"), F.max(_weight(group_weight)).alias("gw"))
    return _group_mean(per, 1 / F.col("k"))


def pairlogit(pairs: DataFrame, w: str | None = None) -> DataFrame:
    """Mean of log(1 + e^-margin) over pairs, by their weights."""
    m = F.col("margin")
    loss = F.log1p(F.exp(-F.abs(m))) + F.greatest(-m, F.lit(0.0))
    kept = pairs.filter(_weight(w) > 0)
    return kept.agg(F.coalesce(F.try_divide(F.sum(loss * _weight(w)), F.sum(_weight(w))), F.lit(0.0)).alias("value"))


def cox(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    """Negative partial log likelihood, as the mean over events by their weights; 0 without events."""
    event = lambda x: F.sum(F.when(F.col(y) > 0, x).otherwise(0.0))
    times = df.groupBy(F.abs(F.col(y)).alias("t")).agg(F.sum(F.exp(F.col(p))).alias("s"), event(_weight(w)).alias("d"), event(_weight(w) * F.col(p)).alias("e"))
    risk = running_sums(times, "t", {"risk": F.col("s")}, descending=True)
    loss = F.col("d") * F.log(F.greatest("risk", F.lit(_EPS))) - F.col("e")
    return risk.filter("d > 0").agg(F.coalesce(F.try_divide(F.sum(loss), F.sum("d")), F.lit(0.0)).alias("value"))


def survival_exponential(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    return _mean(df, F.exp(F.col(p)) * F.abs(F.col(y)) - F.when(F.col(y) > 0, F.col(p)).otherwise(0.0), w)


def concordance(df: DataFrame, p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    """C-index over pairs of an event and a later time, by distinct (time, score); a pair weighs the product of its rows.

    Times are ranked; two ranks first differ at one of their bits, so each pair
    is met once: among the rows whose ranks agree above that bit, the earlier has
    0 there and the later 1.  Within such a cell running sums over the scores count the
    pairs: n log n rows in all, and no join of pairs.
    """
    g = df.groupBy(F.abs(F.col(y)).alias("t"), F.col(p).alias("s")).agg(F.sum(F.when(F.col(y) > 0, _weight(w)).otherwise(0.0)).alias("e"), F.sum(_weight(w)).alias("n"))
    times = g.select(F.col("t").alias("__t")).filter("__t IS NOT NULL").distinct()
    ranks = running_sums(times, "__t", {"rank": F.lit(1).cast("long")})
    bits = max(1, times.count().bit_length())
    cells = g.join(ranks, F.col("t") == F.col("__t")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    late = F.expr("shiftright(rank, level) & 1") == 1
    sides = cells.groupBy("level", F.expr("shiftright(rank, level + 1)").alias("prefix"), "s").agg(F.sum(F.when(~late, F.col("e")).otherwise(0.0)).alias("e"), F.sum(F.when(late, F.col("n")).otherwise(0.0)).alias("n"))
    upto = running_sums(sides, "s", {"upto": F.col("n")}, keys=("level", "prefix"))
    met = upto.groupBy("level", "prefix").agg(F.sum(F.col("e") * (F.col("upto") - 0.5 * F.col("n"))).alias("good"), (F.sum("e") * F.sum("n")).alias("all"))
    return met.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("all")), F.lit(0.0)).alias("value"))


#: name -> (function, higher is better)
METRICS: dict[str, tuple[Callable[..., DataFrame], bool]] = {
    "rmse": (rmse, False), "mae": (mae, False), "huber": (huber, False), "quantile": (quantile, False), "poisson": (poisson, False), "tweedie": (tweedie, False),
    "logloss": (logloss, False), "multiclass": (multi_logloss, False), "accuracy": (accuracy, True), "balanced_accuracy": (balanced_accuracy, True),
    "precision": (precision, True), "recall": (recall, True), "f1": (f1, True), "auc": (auc, True), "pairlogit": (pairlogit, False),
    "ndcg": (ndcg, True), "map": (mean_average_precision, True), "mrr": (mrr, True), "cox": (cox, False), "survivalexponential": (survival_exponential, False), "cindex": (concordance, True),
}
#: Other names of the metrics; an objective's name stands for its own metric.
ALIASES = {
    "squarederror": "rmse", "squared_error": "rmse", "l1": "mae", "absoluteerror": "mae", "absolute_error": "mae", "huberloss": "huber", "quantileloss": "quantile",
    "poissonregression": "poisson", "tweedieloss": "tweedie", "reg:tweedie": "tweedie", "binary_logloss": "logloss", "binary:logistic": "logloss", "softmax": "multiclass",
    "balancedaccuracy": "balanced_accuracy", "balanced-accuracy": "balanced_accuracy", "roc_auc": "auc", "map@all": "map", "mrr@all": "mrr", "pairwise": "pairlogit", "ranknet": "pairlogit",
    "coxph": "cox", "survival:cox": "cox", "survival_exp": "survivalexponential", "survival:exponential": "survivalexponential", "concordance_index": "cindex",
}


def evaluate(df: DataFrame, name: str, **columns: str) -> DataFrame:
    """Any metric by its name."""
    key = ALIASES.get(name.lower(), name.lower())
    if key not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[key][0](df, **columns)


def evaluate_rows(df: DataFrame, name: str, w: str | None = None, grouped: bool = False) -> DataFrame:
    """Any metric over rows with row_id, y, p (and group_id, and a weight column).

    The weight counts where the metric takes one; rank metrics need groups.
    """
    key = ALIASES.get(name.lower(), name.lower())
    if key == "pairlogit":
        return pairlogit(group_pairs(df, w=w), "weight" if w else None)
    takes = inspect.signature(METRICS[key][0]).parameters if key in METRICS else {}
    if "group" in takes and not grouped:
        raise ValueError(f"{name} needs a group column")
    return evaluate(df, name, **({"w": w} if w and "w" in takes else {}))


def higher_is_better(name: str) -> bool:
    return METRICS[ALIASES.get(name.lower(), name.lower())][1]
