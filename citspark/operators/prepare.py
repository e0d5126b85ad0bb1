"""Preparation of raw tables: fills, derived columns, text parts, rare categories, submissions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Nulls of each named column replaced by its value."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def fill_median(df: DataFrame, *cols: str) -> DataFrame:
    """Nulls of numeric columns replaced by the column's exact median; a column of nulls stays."""
    row = df.agg(*(F.median(c).alias(c) for c in cols)).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(row[c]).cast("double")) for c in cols})


def clip(col: Column, lo: float, hi: float) -> Column:
    """Values within [lo, hi]; null stays null."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(lo)), F.lit(hi)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, also where it is null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def first_char(col: Column) -> Column:
    return F.substring(col, 1, 1)


def collapse_rare(df: DataFrame, col: str, min_rows: int, other: str = "rare", out: str | None = None) -> DataFrame:
    """Categories of fewer than ``min_rows`` rows become ``other``; nulls stay.

    Categories are counted first and the counts joined, so no task holds all rows of one.
    """
    rare = df.groupBy(F.col(col).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < min_rows).select("__key")
    joined = df.join(rare, F.col(col) == F.col("__key"), "left")
    return joined.withColumn(out or col, F.when(F.col("__key").isNotNull(), F.lit(other)).otherwise(F.col(col))).drop("__key")


def stratified_split(df: DataFrame, label: str, by: str, share: float, seed: int = 0, cells: int = 64) -> DataFrame:
    """``df`` with held_out: floor(share * rows) rows of each class, by a hash of ``by``.

    Rows are ranked within hash cells of their class, so a class that holds most
    rows is dealt to many tasks.
    """
    mix = F.xxhash64(F.lit(seed), F.col(by))
    celled = df.withColumn("__mix", mix).withColumn("__cell", F.pmod("__mix", F.lit(cells)))
    counts = celled.groupBy(F.col(label).alias("__class"), F.col("__cell").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__class").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__class", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(Window.partitionBy("__class")).alias("__all"))
    local = F.row_number().over(Window.partitionBy(label, "__cell").orderBy("__mix", by))
    joined = celled.withColumn("__place", local).join(offsets, F.col(label).eqNullSafe(F.col("__class")) & (F.col("__cell") == F.col("__c")))
    held = F.col("__first") + F.col("__place") <= F.floor(F.lit(float(share)) * F.col("__all"))
    return joined.withColumn("held_out", held).select(*df.columns, "held_out")


def top_importances(spark: SparkSession, importances: Mapping[str, float], n: int = 20) -> DataFrame:
    """feature, importance of the ``n`` largest; ties by name."""
    rows = sorted(importances.items(), key=lambda x: (-x[1], x[0]))[:n]
    return spark.createDataFrame(rows, "feature string, importance double")


def write_submission(df: DataFrame, path: str, *cols: str) -> None:
    """A folder of CSV files with a header, written by all tasks."""
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header; their columns and types are given, so nothing is scanned for them."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
