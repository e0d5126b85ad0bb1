"""Permutation test of a feature's bins against the gradients."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citspark.functions.columns import bin_of


def chi2_sf(x: float, df: int) -> float:
    """P(X > x) of a chi-square variable: the regularised upper gamma function."""
    if df <= 0 or x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    # Backward evaluation of the continued fraction by Lentz's scheme.
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * h)


def statistic_table(hist: DataFrame, keys: list[str]) -> DataFrame:
    """chi_square and df of each key of a histogram (sum_w, sum_g, sum_gg by bin).

    (n-1) / (n var) * sum over bins of d^2 / W with d = G - W mean: the K-sample
    permutation statistic; df counts the bins with weight, less one.
    """
    t = hist.filter("sum_w > 0").groupBy(*keys).agg(F.sum("sum_w").alias("n"), F.sum("sum_g").alias("G"), F.sum("sum_gg").alias("Q"), F.count(F.lit(1)).alias("k"), F.collect_list(F.struct("sum_w", "sum_g")).alias("b"))
    mean = F.col("G") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("Q") / F.col("n") - mean * mean)
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + (x["sum_g"] - x["sum_w"] * mean) * (x["sum_g"] - x["sum_w"] * mean) / x["sum_w"])
    chi = F.when((F.col("n") > 1) & (F.col("k") > 1) & (var > 2.220446049250313e-16), (F.col("n") - 1) / (F.col("n") * var) * total).otherwise(0.0)
    return t.select(*keys, chi.alias("chi_square"), F.when((F.col("n") > 1) & (F.col("k") > 1), F.col("k") - 1).otherwise(0).cast("long").alias("df"))


def histogram(rows: DataFrame, keys: list[str], bins: str = "bins", w: str = "w", n: str | None = None) -> DataFrame:
    """sum_w, sum_g, sum_h, sum_gg by (keys, feature, bin): one exchange of partial sums.

    ``n`` is how many rows a row stands for, with the sum of their weights.
    """
    each = rows.select(*keys, F.col(w).alias("__w"), (F.col("g") * F.col(w)).alias("__g"), (F.col("h") * F.col(w)).alias("__h"), (F.col("g") * F.col("g") * F.col(w)).alias("__gg"), F.col(n).alias("__n") if n else F.lit(1).alias("__n"), F.posexplode(bins).alias("feature", "bin"))
    return each.groupBy(*keys, "feature", "bin").agg(F.sum("__w").alias("sum_w"), F.sum("__g").alias("sum_g"), F.sum("__h").alias("sum_h"), F.sum("__gg").alias("sum_gg"), F.sum("__n").alias("n"))


def running_best(df: DataFrame, order: str, value: str, higher: bool = False, out: str = "best", ranges: int = 64) -> DataFrame:
    """``df`` with the best ``value`` up to each row in ``order``; null values count for nothing.

    Rows are dealt to ranges of ``order``, each with the best of the ranges before
    it (one row a range), so no task holds all rows.
    """
    best = F.max if higher else F.min
    goals = [k / ranges for k in range(1, ranges)]
    bounds = df.agg(F.percentile_approx(F.col(order).cast("double"), goals, 20 * ranges)).first()[0] or []
    dealt = df.withColumn("__range", F.coalesce(bin_of(F.col(order).cast("double"), sorted(set(bounds))), F.lit(-1)))
    tops = dealt.groupBy("__range").agg(best(value).alias("__top"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__range", best("__top").over(before).alias("__before"))
    local = best(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    either = (F.greatest if higher else F.least)("__local", "__before")
    return dealt.withColumn("__local", local).join(F.broadcast(tops), "__range").withColumn(out, either).drop("__range", "__local", "__before")
