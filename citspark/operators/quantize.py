"""Cuts of numeric features and bins of values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citspark.functions.columns import OTHER_KEY, bin_of, normalize_key

from .features import dictionary

#: Ranges of values that running sums are split into.
RANGES = 64


def quantile_cut_table(df: DataFrame, feature: str, max_bins: int) -> DataFrame:
    """Exact cuts as rows: values at sorted places floor(b n / B), strictly increasing.

    Values are counted first, so the running sums see distinct values only.  These
    are dealt to ranges; the ranges' totals, one row each, give each its offset.
    """
    v = F.col(feature).cast("float").cast("double")
    counts = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # Bounds of ranges only deal rows out: any bounds give the same cuts.
    goals = [k / RANGES for k in range(1, RANGES)]
    bounds = counts.agg(F.percentile_approx("v", goals, 20 * RANGES)).first()[0] or []
    dealt = counts.withColumn("range", bin_of(F.col("v"), sorted(set(bounds))))
    totals = dealt.groupBy("range").agg(F.sum("n").alias("t"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    local = F.sum("n").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    upto = dealt.withColumn("local", local).join(F.broadcast(offsets), "range").select("v", "n", (F.col("local") + F.col("offset")).alias("hi"))
    total = totals.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"))
    wanted = total.select(F.col("t"), F.least(F.lit(max_bins).cast("long"), F.col("t")).alias("b")).filter("b > 1").select(F.explode(F.transform(F.sequence(F.lit(1), (F.col("b") - 1).cast("int")), lambda k: F.floor(k * F.col("t") / F.col("b")))).alias("at"))
    joined = upto.join(F.broadcast(wanted), (F.col("at") < F.col("hi")) & (F.col("at") >= F.col("hi") - F.col("n")))
    first = counts.agg(F.min("v").alias("lo"))
    return joined.select("v").distinct().join(F.broadcast(first)).filter("v > lo").select(F.col("v").alias("cut"))


def quantile_cuts(df: DataFrame, feature: str, max_bins: int = 256) -> list[float]:
    """Exact cuts at any size, at most max_bins - 1."""
    return sorted(r.cut for r in quantile_cut_table(df, feature, max_bins).collect())


def uniform_cuts(df: DataFrame, feature: str, max_bins: int = 256) -> list[float]:
    """min + k (max - min) / B for k = 1..B-1, strictly increasing."""
    v = F.col(feature).cast("double")
    lo, hi = df.filter(v.isNotNull() & ~F.isnan(v)).agg(F.min(v), F.max(v)).first()
    return [] if lo is None or lo == hi else sorted({lo + k * (hi - lo) / max_bins for k in range(1, max_bins)})


def custom_borders(borders: Sequence[float]) -> list[float]:
    if any(math.isnan(b) for b in borders):
        raise ValueError("borders must not be NaN")
    return sorted(set(float(b) for b in borders))


@dataclass(frozen=True)
class FeatureBins:
    """Cuts of one feature; missing: None, "min", "max" or "forbidden"."""

    name: str
    cuts: tuple[float, ...]
    missing: str | None = None
    categorical: bool = False
    #: Of a categorical feature: its keys, in the order of their bins.
    keys: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, d: dict) -> FeatureBins:
        return cls(d["name"], tuple(d["cuts"]), d["missing"], d["categorical"], tuple(d.get("keys", ())))

    @property
    def bins(self) -> int:
        if self.categorical:
            return len(self.keys)
        return len(self.cuts) + 1 + (self.missing in ("min", "max"))

    def column(self) -> Column:
        if self.categorical:
            # Unknown keys take the bin of the others, or -1, which goes right at every split.
            place = F.array_position(F.array(*(F.lit(k) for k in self.keys)), normalize_key(F.col(self.name))) - 1
            return (F.when(place >= 0, place).otherwise(self.keys.index(OTHER_KEY)) if OTHER_KEY in self.keys else place).cast("int")
        value = F.col(self.name).cast("float").cast("double")
        gone = value.isNull() | F.isnan(value)
        if self.missing == "forbidden":
            checked = F.when(gone, F.raise_error(F.lit(f"missing value in {self.name}"))).otherwise(value)
            return bin_of(checked.cast("double"), list(self.cuts))
        if self.missing is None:
            return F.when(gone, 0).otherwise(bin_of(value, list(self.cuts))).cast("int")
        return bin_of(value, list(self.cuts), gone, self.missing)


def fit_bins(df: DataFrame, features: Sequence[str], max_bins: int = 256, nan_mode: str = "min", borders: dict[str, Sequence[float]] | None = None, method: str = "quantile", categorical: Sequence[str] = ()) -> list[FeatureBins]:
    """Bins of all features; a missing bin only where the data has missing values.

    A categorical feature has a bin for each key, missing values being a key; of
    more than ``max_bins`` keys the most frequent keep theirs and the others share one.
    """
    gone = df.agg(*(F.max((F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).cast("int")).alias(f) for f in features if f not in categorical), F.lit(0).alias("__none")).first()
    cut = quantile_cuts if method.lower() == "quantile" else uniform_cuts
    out = []
    for f in features:
        if f in categorical:
            codes = dictionary(df, f, max_keys=max_bins).orderBy("code").collect()  # at most max_bins rows
            out.append(FeatureBins(f, (), None, True, tuple(r.key for r in codes)))
            continue
        cuts = custom_borders(borders[f]) if borders and f in borders else cut(df, f, max_bins)
        mode = nan_mode.lower() if gone[f] else ("forbidden" if nan_mode.lower() == "forbidden" else None)
        if gone[f] and mode == "forbidden":
            raise ValueError(f"missing values in {f} are forbidden")
        out.append(FeatureBins(f, tuple(cuts), mode))
    return out


def with_bins(df: DataFrame, bins: Sequence[FeatureBins], out: str = "bins") -> DataFrame:
    return df.withColumn(out, F.array(*(b.column() for b in bins)))
