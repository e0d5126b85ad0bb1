"""Scoring streams, and training on micro-batches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from citspark.operators.boosting import BoosterModel, BoostParams, fit


def score_stream(model: BoosterModel, stream: DataFrame, out: str = "prediction") -> DataFrame:
    """Margins of a streaming frame: scoring is row-local, so no state is kept."""
    return model.transform(stream, out)


class IncrementalTrainer:
    """Adds ``rounds`` iterations to its model with each micro-batch."""

    def __init__(self, features: list[str], label: str, params: BoostParams = BoostParams(), rounds: int = 1, row_id: str = "row_id"):
        self.features, self.label, self.row_id = features, label, row_id
        self.params = replace(params, iterations=rounds)
        self.model: BoosterModel | None = None

    def update(self, batch: DataFrame, _epoch: int = 0) -> None:
        if not batch.isEmpty():
            self.model = fit(batch, self.features, self.label, self.params, row_id=self.row_id, init=self.model)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Train on every micro-batch of ``stream``; ``checkpoint`` is a shared folder."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).start()
