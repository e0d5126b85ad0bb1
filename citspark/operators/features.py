"""Feature pipeline operators: dictionaries, one-hot, crossed categories, ordered statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citspark.functions.columns import MISSING_KEY, OTHER_KEY, normalize_key, sanitize_name

from .running import running_sums


def category_counts(df: DataFrame, *cols: str) -> DataFrame:
    """key, n: rows of each (crossed) category."""
    key = F.concat_ws("||", *(normalize_key(F.col(c)) for c in cols))
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def dictionary(df: DataFrame, *cols: str, max_keys: int = 0) -> DataFrame:
    """key, code: sorted keys; beyond ``max_keys`` the most frequent and one for the others."""
    counts = category_counts(df, *cols)
    if max_keys > 1:
        many = counts.count() > max_keys
        if many:
            kept = counts.orderBy(F.col("n").desc(), "key").limit(max_keys - 1).select("key")
            coded = kept.withColumn("code", (F.row_number().over(Window.orderBy("key")) - 1).cast("int"))
            return coded.unionByName(coded.sparkSession.range(1).select(F.lit(OTHER_KEY).alias("key"), F.lit(max_keys - 1).alias("code")))
    return counts.select("key", (F.row_number().over(Window.orderBy("key")) - 1).cast("int").alias("code"))


def encode(df: DataFrame, codes: DataFrame, *cols: str, out: str = "code") -> DataFrame:
    """Codes of categories; unknown ones get the code of the others, else null."""
    key = F.concat_ws("||", *(normalize_key(F.col(c)) for c in cols))
    other = codes.filter(F.col("key") == OTHER_KEY).agg(F.max("code").alias("__other"))
    found = df.withColumn("__key", key).join(codes.select(F.col("key").alias("__key"), F.col("code").alias("__code")), "__key", "left")
    return found.join(F.broadcast(other)).withColumn(out, F.coalesce("__code", "__other")).drop("__key", "__code", "__other")


def one_hot(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """One indicator a key; an unknown key has none."""
    key = normalize_key(F.col(col))
    return df.withColumns({f"{col}_is_{sanitize_name(k)}": (key == F.lit(k)).cast("float") for k in keys})


def ordered_mean(df: DataFrame, key: str, y: str, order: str, prior: Column, strength: float = 1.0, out: str = "ctr") -> DataFrame:
    """Leak-free target mean: only rows of the key before this one count.

    A key's values are added one by one in their order, so the rows of a key meet in
    one task; ``ordered_class_means`` counts, and splits a key over many.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total, n = F.coalesce(F.sum(y).over(before), F.lit(0.0)), F.count(F.lit(1)).over(before)
    return df.withColumn(out, (total + strength * prior) / F.greatest(n + strength, F.lit(1.0)))


def ordered_class_means(df: DataFrame, key: str, y: str, order: str, classes: int, strength: float = 1.0, out: str = "ctr") -> DataFrame:
    """``out``_0.. : leak-free share of each class among the key's rows before this one; the prior is 1 / classes."""
    is_k = {f"__c{k}": F.coalesce((F.col(y) == k).cast("double"), F.lit(0.0)) for k in range(classes)}
    upto = running_sums(df, order, {**is_k, "__n": F.lit(1).cast("long")}, keys=(key,))
    below = F.greatest(F.col("__n") - 1 + strength, F.lit(1.0))
    return upto.withColumns({f"{out}_{k}": (F.col(f"__c{k}") - is_k[f"__c{k}"] + strength / classes) / below for k in range(classes)}).drop("__n", *is_k)


def ctr_lookup(df: DataFrame, table: DataFrame, key: str, prior: Column, out: str = "ctr") -> DataFrame:
    """``df`` with the fitted mean of its key (``full_mean``); unknown keys get the prior."""
    found = table.select(F.col(key).alias("__key"), F.col("ctr").alias("__ctr"))
    return df.join(found, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn(out, F.coalesce("__ctr", prior)).drop("__key", "__ctr")


def ordered_frequency(df: DataFrame, key: str, order: str, strength: float = 1.0, out: str = "freq") -> DataFrame:
    """Share of the key among the rows before this one, smoothed by its overall share."""
    share = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    one = F.lit(1).cast("long")
    placed = running_sums(running_sums(df, order, {"__seen": one}), order, {"__before": one}, keys=(key,))
    rows = placed.join(share, F.col(key).eqNullSafe(F.col("__key"))).join(F.broadcast(total))
    value = (F.col("__before") - 1 + strength * F.col("__n") / F.col("__all")) / F.greatest(F.col("__seen") - 1 + F.lit(strength), F.lit(1.0))
    return rows.withColumn(out, value).drop("__key", "__n", "__all", "__seen", "__before")


def full_mean(df: DataFrame, key: str, y: str, prior: Column, strength: float = 1.0) -> DataFrame:
    """key, ctr: what rows outside training get."""
    return df.groupBy(key).agg(F.sum(y).alias("s"), F.count(F.lit(1)).alias("n")).select(key, ((F.col("s") + strength * prior) / F.greatest(F.col("n") + strength, F.lit(1.0))).alias("ctr"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, weight: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    return counts.join(F.broadcast(total)).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))


def folds(df: DataFrame, k: int, by: str, stratify: str | None = None, seed: int = 0) -> DataFrame:
    """A fold for each row: of its group (``by``) or balanced within strata."""
    if stratify:
        order = Window.partitionBy(stratify).orderBy(F.xxhash64(F.lit(seed), F.col(by)), by)
        return df.withColumn("fold", (F.row_number().over(order) % k).cast("int"))
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(by)), F.lit(k)).cast("int"))


__all__ = ["MISSING_KEY", "OTHER_KEY", "category_counts", "class_weights", "ctr_lookup", "dictionary", "encode", "folds", "full_mean", "one_hot", "ordered_class_means", "ordered_frequency", "ordered_mean"]
