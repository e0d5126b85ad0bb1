"""Helpers that several operators share: shared folders, text rules, ranks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and \t \n \v \f \r, nothing else.
SPACE = r"[\x20\x09-\x0D]"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None)
    if not path:
        held = context._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="citspark-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/citspark-scratch/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run within delete their shuffle files once they end.

    For writes only: what was written is read again, their shuffles never are.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage_table(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Unlike a local checkpoint the table outlives the executors that wrote it.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.partitionBy(*partition_by).option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this package in the shared folder.

    Call it once the results are consumed: they read those tables lazily.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/citspark-scratch")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none.

    Plain replacements and a split at one character: no regular expression runs.
    """
    flat = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z in lower case; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries.

    A missing column becomes null, so that reduced tables do not crash.
    """
    have = set(df.columns)
    return df.select(*(df[n].alias(n) if n in have else F.lit(None).alias(n) for n in names))


def check_columns(df: DataFrame, *names: str) -> None:
    """Raise a clear error when a column that the operator needs is missing."""
    if gone := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {gone}; the table has {df.columns}")


def dense_rank_in(df: DataFrame, group: str, order: list[str], out: str, cells: int = 256, broadcast_offsets: bool = False) -> DataFrame:
    """``out``: gapless ranks from 0 within each ``group``, in a fixed order.

    The order is by a hash cell of the ``order`` columns, then by these columns.
    Rows are numbered within (group, cell); the cells' counts, at most
    ``cells`` a group, give each cell its offset.  So a group that holds a third
    of all rows is still numbered by ``cells`` tasks.  Rows equal in ``order``
    tie and get neighbouring ranks.  ``broadcast_offsets`` is for callers that
    know a bound of groups times cells; wide rows then move once only.
    """
    cell, offset = f"__{out}_cell", f"__{out}_offset"
    celled = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    return rank_by_cells(celled, group, cell, order, out, offset, broadcast_offsets)


def rank_by_cells(df: DataFrame, group: str, cell: str, order: list[str], out: str, offset: str, broadcast_offsets: bool = False) -> DataFrame:
    """Gapless ranks of ``group`` over rows dealt to ordered cells; drops the cell."""
    counts = df.groupBy(group, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("__g"), F.col(cell).alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(offset))
    local = Window.partitionBy(group, cell).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(local).cast("long") - 1)
    if broadcast_offsets:
        offsets = F.broadcast(offsets)
    joined = ranked.join(offsets, ranked[group].eqNullSafe(offsets["__g"]) & (ranked[cell] == offsets["__c"]), "left")
    return joined.withColumn(out, F.col(out) + F.coalesce(F.col(offset), F.lit(0))).drop("__g", "__c", cell, offset)


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)
