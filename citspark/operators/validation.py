"""Cross-validation over a fold column."""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostParams, fit
from .features import folds


def cross_validate(df: DataFrame, features: list[str], label: str, p: BoostParams = BoostParams(), k: int = 3, row_id: str = "row_id", group: str | None = None, stratify: str | None = None) -> dict[str, list[float]]:
    """Mean and standard deviation over folds, by iteration, of the train and held-out metric.

    Rows of one ``group`` stay in one fold.  Folds that stop early leave shorter
    histories; an iteration's figures are those of the folds that reached it.
    """
    dealt = folds(df, k, group or row_id, stratify if group is None else None, p.seed)
    runs = [fit(dealt.filter(F.col("fold") != i), features, label, p, row_id=row_id, valid=dealt.filter(F.col("fold") == i), group=group).history for i in range(k)]
    out: dict[str, list[float]] = {}
    for name in ("train", "valid"):
        columns = [[h[name][t] for h in runs if t < len(h[name])] for t in range(max(len(h[name]) for h in runs))]
        out[f"{name}_mean"] = [statistics.fmean(c) for c in columns]
        out[f"{name}_std"] = [statistics.pstdev(c) for c in columns]
    return out
