"""Where intermediate results live: the shared folder of the session."""

from __future__ import annotations

import uuid

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset, as in tests."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="citspark-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark, name: str) -> str:
    """A path beside the checkpoints that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_text(spark, path: str, text: str) -> None:
    """One file, in any file system that the session knows; replaced whole, by a rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")


def exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_text(spark, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
