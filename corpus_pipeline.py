"""A training corpus from ``documents``: filter, dedup, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  The first three return the columns of ``docs``; ``mix`` adds mix_order,
which ``shard`` turns into the order of each shard's slots and
drops.  Empty tables give empty results; nulls and texts are taken as the
stages' operators take them.  Other columns stay, but columns named mix_order,
shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citspark.llm import decontam, mixing, near_dup, quality, sharding
from citspark.llm.common import stage_table


#: The mixture's order, between the last two stages.
PLACE = "mix_order"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return quality.quality_rules(docs, _table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group."""
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixture of their sources and adds it as ``PLACE``."""
    return mixing.mixed_order(docs, place=PLACE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot to each document; the slots of a shard follow the mixture's order.

    Documents that no mix stage has placed are placed here.
    """
    placed = docs if PLACE in docs.columns else mix(spark, docs, sf_dir)
    return sharding.sharded(placed, order=PLACE).drop(PLACE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: SQL can express neither the hashed ratio nor the groups of near copies.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
