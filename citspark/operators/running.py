"""Running sums over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citspark.functions.columns import bin_of

#: Ranges of the order that rows are dealt to.
RANGES = 64


def deal(df: DataFrame, order: str, out: str = "__range", ranges: int = RANGES) -> DataFrame:
    """``df`` with the range of each row's ``order``; ranges grow with it, nulls come first.

    Bounds are approximate quantiles: they only deal rows out, so any bounds give the same sums.
    """
    goals = [k / ranges for k in range(1, ranges)]
    bounds = df.agg(F.percentile_approx(F.col(order).cast("double"), goals, 20 * ranges)).first()[0] or []
    placed = bin_of(F.col(order).cast("double"), sorted(set(bounds)))
    return df.withColumn(out, F.when(F.col(order).isNull(), F.lit(-1)).otherwise(placed))


def running_sums(df: DataFrame, order: str, sums: dict[str, Column], keys: tuple[str, ...] = (), descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """``df`` with the sum of each value over the rows up to this one, itself included.

    Rows are in ``order``, a number or a timestamp that is distinct within ``keys``,
    and each of ``keys`` has sums of its own.  A range's rows are summed in one task and the ranges' totals,
    one row a range and key, give each its offset.
    """
    dealt = deal(df, order, ranges=ranges).withColumns({f"__v_{n}": c for n, c in sums.items()})
    by = (lambda c: F.col(c).desc()) if descending else F.col
    totals = dealt.groupBy(*keys, "__range").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy(by("__range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__range").alias("__r"), *(F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in sums))
    local = Window.partitionBy(*keys, "__range").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({f"__l_{n}": F.sum(f"__v_{n}").over(local) for n in sums})
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = placed.join(offsets if keys else F.broadcast(offsets), same)
    return joined.select(*(c for c in df.columns if c not in sums), *((F.col(f"__l_{n}") + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n) for n in sums))
