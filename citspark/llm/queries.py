"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, katz, line_dedup, mixing, near_dup, quality, sharding, token_store, unigram_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz.katz_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), katz.crc_rule(7, 2))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_key"))
    return mixing.mix_sources(documents, order=("doc_id", "text_key")).select("doc_id", "source", "phase", "slot", "mix_order", "share")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), token_store.default_tokenizer("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), 8)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = quality.quality_rules(documents.select("doc_id", "text"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "threshold", "toxic_score", "toxic_threshold")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read(_table(spark, sf_dir, "documents").select("doc_id", "text"), token_store.default_tokenizer())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), near_dup.NearDup(shingle=4))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_katz_scores, op2_pfair_mixing, op3_token_counts, op4_sharding, op5_quality_rules, op6_token_files, op7_near_dedup, op8_line_dedup, op9_decontamination, op10_html_extraction)}

ORACLE: dict[str, str] = {
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op9_decontamination": decontam.ORACLE_SQL,
}
