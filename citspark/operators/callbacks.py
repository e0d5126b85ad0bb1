"""Callbacks of training, and snapshots to go on from."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame

from citspark.sources.storage import exists, read_text, write_text

from .boosting import BoosterModel, BoostParams, fit

#: Parameters that may differ between a snapshot and the training that goes on from it.
_FREE = ("iterations", "checkpoint_every", "early_stopping_rounds")


def log_evaluation(period: int = 1, write: Callable[[str], None] = print) -> Callable[[dict], bool]:
    """Writes the newest metrics every ``period`` iterations."""

    def call(state: dict) -> bool:
        if period > 0 and (state["iteration"] + 1) % period == 0:
            write(f"[{state['iteration'] + 1}] " + " ".join(f"{k}:{v[-1]:.6g}" for k, v in state["history"].items() if v))
        return False

    return call


def _config(p: BoostParams, features: list[str], label: str) -> dict:
    kept = {k: v for k, v in asdict(p).items() if k not in _FREE}
    return json.loads(json.dumps({"params": kept, "features": features, "label": label}))


def checkpoint(spark, path: str, p: BoostParams, features: list[str], label: str, every: int = 1) -> Callable[[dict], bool]:
    """Saves the model and the settings it was trained with every ``every`` iterations."""

    def call(state: dict) -> bool:
        if (state["iteration"] + 1) % every == 0:
            write_text(spark, path, json.dumps({"config": _config(p, features, label), "model": json.loads(state["model"].to_json())}))
        return False

    return call


def fit_with_snapshots(df: DataFrame, features: list[str], label: str, p: BoostParams, path: str, every: int = 1, callbacks: tuple = (), **more) -> BoosterModel:
    """``fit`` that saves snapshots to ``path`` and goes on from one that is there.

    A snapshot of other settings, features or label is an error.  The remaining
    iterations are those asked for less those in the snapshot; DART, random
    forests and rate sequences only start anew, as their later iterations
    depend on the earlier ones.
    """
    spark = df.sparkSession
    init = None
    if exists(spark, path):
        held = json.loads(read_text(spark, path))
        if held["config"] != _config(p, features, label):
            raise ValueError(f"{path} was trained with other settings")
        if p.boosting_type.lower() not in ("gbdt", "gradientboosting") or not isinstance(p.learning_rate, (int, float)):
            raise ValueError("only plain boosting at one learning rate can be resumed")
        init = BoosterModel.from_json(json.dumps(held["model"]))
    done = len(init.trees) if init else 0
    if init and done >= p.iterations:
        return init
    save = checkpoint(spark, path, p, features, label, every)
    return fit(df, features, label, replace(p, iterations=p.iterations - done), init=init, callbacks=(*callbacks, save), **more)
