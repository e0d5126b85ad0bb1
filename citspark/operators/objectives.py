"""Objectives: gradient ``g`` and hessian ``h`` of each row's margin ``p``.

Pointwise objectives are column expressions.  Cox uses two running sums over the
distinct times; the pairwise one joins the rows of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citspark.functions.columns import sigmoid, softmax

from .running import running_sums

Pair = tuple[Column, Column]
_TINY = 1e-12


def rmse(p: Column, y: Column) -> Pair:
    return p - y, F.lit(1.0)


def mae(p: Column, y: Column) -> Pair:
    return F.signum(p - y).cast("double"), F.lit(1.0)


def huber(p: Column, y: Column, delta: float = 1.0) -> Pair:
    r = p - y
    inside = F.abs(r) <= delta
    return F.when(inside, r).otherwise(delta * F.signum(r)), F.when(inside, 1.0).otherwise(0.0)


def quantile(p: Column, y: Column, alpha: float = 0.5) -> Pair:
    return F.when(y - p > 0, -alpha).otherwise(1 - alpha), F.lit(1.0)


def poisson(p: Column, y: Column) -> Pair:
    return F.exp(p) - y, F.exp(p)


def tweedie(p: Column, y: Column, rho: float = 1.5) -> Pair:
    a, b = F.exp((1 - rho) * p), F.exp((2 - rho) * p)
    return -y * a + b, F.greatest(y * (rho - 1) * a + (2 - rho) * b, F.lit(_TINY))


def logloss(p: Column, y: Column) -> Pair:
    s = sigmoid(p)
    return s - y, s * (1 - s)


def survival_exponential(p: Column, y: Column) -> Pair:
    """``y`` is a signed time: positive for events, negative for censored rows."""
    scaled = F.exp(p) * F.abs(y)
    return scaled - F.when(y > 0, 1.0).otherwise(0.0), F.greatest(scaled, F.lit(_TINY))


POINTWISE: dict[str, Callable[..., Pair]] = {
    "rmse": rmse, "squarederror": rmse, "squared_error": rmse,
    "mae": mae, "l1": mae, "absoluteerror": mae, "absolute_error": mae,
    "huber": huber, "huberloss": huber,
    "quantile": quantile, "quantileloss": quantile,
    "poisson": poisson, "poissonregression": poisson,
    "tweedie": tweedie, "tweedieloss": tweedie, "reg:tweedie": tweedie,
    "logloss": logloss, "binary_logloss": logloss, "binary:logistic": logloss,
    "survivalexponential": survival_exponential, "survival_exp": survival_exponential, "survival:exponential": survival_exponential,
}


COX = ("cox", "coxph", "survival:cox")
PAIRWISE = ("pairlogit", "pairwise", "ranknet")


def with_gradients(df: DataFrame, objective: str, p: str = "p", y: str = "y", **params: float) -> DataFrame:
    """``df`` with columns g and h of a pointwise objective."""
    if objective.lower() not in POINTWISE:
        raise ValueError(f"unknown pointwise objective {objective!r}; known: {sorted(POINTWISE)}")
    g, h = POINTWISE[objective.lower()](F.col(p), F.col(y), **params)
    return df.withColumn("g", g.cast("double")).withColumn("h", h.cast("double"))


def softmax_gradients(df: DataFrame, classes: int, p: str = "p", y: str = "y") -> DataFrame:
    """Arrays g and h over classes from an array of margins and an integer label."""
    s = df.withColumn("__s", softmax(F.col(p)))
    g = F.transform("__s", lambda v, k: v - F.when(k == F.col(y), 1.0).otherwise(0.0))
    return s.withColumn("g", g).withColumn("h", F.transform("__s", lambda v: v * (1 - v))).drop("__s")


def cox_gradients(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Breslow partial likelihood over signed times, summed by distinct time first."""
    rows = df.withColumn("__t", F.abs(F.col(y))).withColumn("__e", F.exp(F.col(p)))
    times = rows.groupBy("__t").agg(F.sum("__e").alias("s"), F.sum(F.when(F.col(y) > 0, 1.0).otherwise(0.0)).alias("d"))
    risk = running_sums(times, "__t", {"r": F.col("s")}, descending=True)
    sums = running_sums(risk, "__t", {"a": F.col("d") / F.col("r"), "b": F.col("d") / (F.col("r") * F.col("r"))}).select("__t", "a", "b")
    found = rows.join(sums, "__t")
    event = F.when(F.col(y) > 0, 1.0).otherwise(0.0)
    g = F.col("__e") * F.col("a") - event
    h = F.greatest(F.col("__e") * F.col("a") - F.col("__e") * F.col("__e") * F.col("b"), F.lit(_TINY))
    return found.withColumn("g", g).withColumn("h", h).drop("__t", "__e", "a", "b")


def group_pairs(df: DataFrame, row_id: str = "row_id", group: str = "group_id", y: str = "y", p: str = "p", subgroup: str | None = None, w: str | None = None) -> DataFrame:
    """Pairs of a group with different labels and subgroups: winner, loser, margin, and with ``w`` the product of their weights."""
    side = lambda s: df.select(F.col(group).alias("grp"), *(F.col(c).alias(f"{s}_{n}") for c, n in ((row_id, "id"), (y, "y"), (p, "p"), *(((subgroup, "sub"),) if subgroup else ()), *(((w, "wt"),) if w else ()))))
    joined = side("w").join(side("l"), "grp").filter(F.col("w_y") > F.col("l_y"))
    if subgroup:
        joined = joined.filter(F.col("w_sub") != F.col("l_sub"))
    return joined.select("grp", F.col("w_id").alias("winner"), F.col("l_id").alias("loser"), (F.col("w_p") - F.col("l_p")).alias("margin"), *([(F.col("w_wt") * F.col("l_wt")).alias("weight")] if w else []))


def pairlogit_gradients(pairs: DataFrame, weight: Column | None = None) -> DataFrame:
    """row_id, g, h summed over the pairs that a row is in."""
    w = F.coalesce(weight, F.lit(1.0)) if weight is not None else F.lit(1.0)
    s = sigmoid(F.col("margin"))
    each = pairs.filter(w > 0).select("winner", "loser", ((1 - s) * w).alias("a"), (s * (1 - s) * w).alias("b"))
    both = each.select(F.explode(F.array(F.struct(F.col("winner").alias("row_id"), (-F.col("a")).alias("g"), F.col("b").alias("h")), F.struct(F.col("loser").alias("row_id"), F.col("a").alias("g"), F.col("b").alias("h")))).alias("x")).select("x.*")
    return both.groupBy("row_id").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
