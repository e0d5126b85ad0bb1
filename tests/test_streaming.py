"""Streams and folds."""

from pyspark.sql import functions as F

from citspark.operators.boosting import BoostParams, fit
from citspark.operators.tree import TreeParams
from citspark.operators.validation import cross_validate
from citspark.streaming.scoring import IncrementalTrainer, score_stream

P = BoostParams(iterations=1, max_bins=4, tree=TreeParams(max_depth=1))


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 > 4).cast("double").alias("y"))
    rows.write.parquet(f"{tmp_path}/in")
    model = fit(rows, ["a"], "y", P)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = score_stream(model, stream).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    got = {r.row_id: r.prediction for r in spark.table("scored").collect()}
    assert got == {r.row_id: r.prediction for r in model.transform(rows).collect()}
    trainer = IncrementalTrainer(["a"], "y", P)
    query = trainer.start(stream, f"{tmp_path}/ck")
    query.processAllAvailable()
    query.stop()
    assert len(trainer.model.trees) == 1
    trainer.update(rows)
    assert len(trainer.model.trees) == 2


def test_cross_validation_has_a_figure_for_each_iteration(spark):
    rows = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"))
    found = cross_validate(rows, ["a"], "y", P, k=2)
    assert len(found["valid_mean"]) == 1 and found["train_std"][0] >= 0
