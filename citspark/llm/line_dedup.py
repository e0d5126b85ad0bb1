"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys, bucketed and sorted by key: how many documents
of its batches hold the line, the largest of their ids, and whether the key was
new to the store when its batch came.  A new batch is merge-anti-joined with the
runs: what no run holds is new.  Its own rows become a run of level 0; when a
level has ``fanout`` runs they are merged into one of the next level, so a batch
meets O(log batches) runs.  All runs share one bucketing, whose size follows the number
of keys, so the joins move no stored row.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_columns, lower_ascii, scratch_path, stage_table

_RUN = "k1 long, k2 long, n_docs long, max_doc long, fresh boolean"
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(lower_ascii(bare))


def key_hashes(line: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a line's key."""
    key = line_key(line)
    return F.xxhash64(key), F.xxhash64(F.lit(7), key)


def document_keys(documents: DataFrame, min_chars: int, batches: int = 1) -> DataFrame:
    """k1, k2, doc_id, batch: the distinct long lines of each document.

    Rows of one doc_id are one document and fall into one batch; rows with a
    null doc_id hold no lines here.
    """
    lines = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    k1, k2 = key_hashes(F.col("line"))
    held = lines.filter(F.length(F.btrim("line", F.lit(_BLANK))) >= min_chars)
    return held.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))


@dataclass
class LineRuns:
    """A store of levelled sorted runs; ``levels[i]`` lists the run tables of level i."""

    spark: SparkSession
    fanout: int = 4
    buckets: int = 16
    root: str | None = None
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.root = self.root or scratch_path(self.spark, "line-runs")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"citspark_run_{uuid.uuid4().hex}"
        # One task a bucket, so one file a bucket.
        placed = rows.select("k1", "k2", "n_docs", "max_doc", "fresh").repartition(self.buckets, "k1", "k2").sortWithinPartitions("k1", "k2")
        placed.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (k1, k2, ...) that no run holds: one merge anti-join a run."""
        return reduce(lambda left, run: left.join(run.select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti"), self.runs(), keys)

    def add(self, keys: DataFrame) -> None:
        """Add a batch: k1, k2, doc_id, distinct, of documents that no batch before had."""
        own = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if self.levels:
            own = stage_table(own, "line-batch")
            fresh = self.unseen(own).select("k1", "k2", F.lit(True).alias("new"))
            own = own.join(fresh, ["k1", "k2"], "left").withColumn("fresh", F.coalesce("new", F.lit(False)))
        else:
            own = own.withColumn("fresh", F.lit(True))
        self._put(0, self._write(own))

    def _put(self, level: int, table: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self._merged(old)
            self.levels[level] = []
            self._put(level + 1, self._write(merged))
            for t in old:  # their rows are in the new run
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{t}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _all_rows(self) -> DataFrame:
        return self._union([t for level in self.levels for t in level])

    def _union(self, tables: list[str]) -> DataFrame:
        """All rows of runs, read as plain files.

        A grouping over a union of bucketed tables needs no exchange in Spark 4.1's
        eyes, but took rows of one key in different tables for different groups.
        """
        return self.spark.read.schema(_RUN).parquet(*(f"{self.root}/{t}" for t in tables))

    def _merged(self, tables: list[str]) -> DataFrame:
        rows = self._union(tables)
        return rows.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.max("fresh").alias("fresh"))

    def common(self, min_docs: int) -> DataFrame:
        """k1, k2, n_docs, max_doc of keys that at least ``min_docs`` documents hold.

        Only keys that came again in a later batch, or often enough in one, are
        summed over the runs; most lines are fresh once and never move.
        """
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "k1 long, k2 long, n_docs long, max_doc long")
        if len(runs) == 1:
            return runs[0].filter(F.col("n_docs") >= min_docs).select("k1", "k2", "n_docs", "max_doc")
        every = self._all_rows()
        again = every.filter(~F.col("fresh") | (F.col("n_docs") >= min_docs)).select("k1", "k2").distinct()
        summed = every.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        return summed.filter(F.col("n_docs") >= min_docs)

    def drop(self) -> None:
        for level in self.levels:
            for t in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.levels = []


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, bucket_keys: int = 1_000_000) -> DataFrame:
    """``documents`` with n_lines, n_dropped and kept_text.

    A line whose key has at least ``min_chars`` code points and is held by at
    least ``min_docs`` documents stays only in the largest doc_id that holds it,
    each time it occurs there.  Null texts are one empty line.  Rows with a null
    doc_id keep all lines and count for none; rows of one doc_id are one
    document.  Other columns stay; ones named like the new columns are replaced.
    """
    check_columns(documents, "doc_id", "text")
    spark = documents.sparkSession
    keys = stage_table(document_keys(documents, min_chars, batches), "line-keys", ("batch",))
    # A bucket is one task's: about a million keys, however many keys there are.
    store = LineRuns(spark, fanout=fanout, buckets=max(16, math.ceil(keys.count() / bucket_keys)))
    for b in range(batches):
        store.add(keys.filter(F.col("batch") == b).drop("batch"))
    common = stage_table(store.common(min_docs), "line-common")
    store.drop()
    lost = keys.join(common, ["k1", "k2"]).filter(F.col("doc_id") != F.col("max_doc"))
    per_doc = lost.groupBy("doc_id").agg(F.collect_set("k1").alias("__lost")).withColumnRenamed("doc_id", "__doc")
    rows = documents.join(per_doc, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    long_enough = lambda x: F.length(F.btrim(x, F.lit(_BLANK))) >= min_chars
    kept = F.when(F.col("__lost").isNull(), lines).otherwise(F.filter(lines, lambda x: ~(long_enough(x) & F.array_contains("__lost", key_hashes(x)[0]))))
    rows = rows.withColumn("__kept", kept).withColumn("n_lines", F.size(lines).cast("long"))
    return rows.withColumn("n_dropped", F.col("n_lines") - F.size("__kept")).withColumn("kept_text", F.array_join("__kept", "\n")).drop("__kept", "__lost")


#: DuckDB's form of the digest that the query returns.
ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
t AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM t WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT t.*, c.keeper IS NOT NULL AND c.keeper <> t.doc_id AS lost FROM t LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""
