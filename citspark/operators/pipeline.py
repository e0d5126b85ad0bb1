"""The feature pipeline as one fitted object: fit, transform, fit_transform, save and load."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citspark.functions.columns import embedding_stats, normalize_key, sanitize_name
from citspark.functions.hashing import hashed_counts
from citspark.sources.storage import read_text, scratch_folder, write_text

from .features import ordered_frequency, ordered_mean

_KEYS = "feature string, key string, n long, s double, code int"


@dataclass(frozen=True)
class PipelineSpec:
    """Which columns become which features.

    numeric: passed on.  categorical: coded by their sorted keys, or indicators
    where they have at most ``one_hot`` keys.  combinations: crossed categories,
    coded.  ctr: categorical columns that also get a target mean and a frequency.
    text: token counts in ``hash_dim`` buckets.  embedding: statistics of arrays.
    max_keys: beyond it the most frequent keys (ties by key) stay and one code
    stands for the others; 0 is no bound.  strength: of the prior.
    """

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    combinations: tuple[tuple[str, ...], ...] = ()
    ctr: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    embedding: tuple[str, ...] = ()
    one_hot: int = 0
    max_keys: int = 0
    hash_dim: int = 16
    strength: float = 1.0

    def __post_init__(self) -> None:
        if self.one_hot > 200:
            raise ValueError("one_hot makes a column a key: at most 200")

    def keys(self) -> dict[str, tuple[str, ...]]:
        """Columns of each coded feature, by its name."""
        named = {c: (c,) for c in (*self.categorical, *self.ctr)}
        return named | {"_x_".join(c): tuple(c) for c in sorted(set(map(tuple, self.combinations)))}


def _key(df: DataFrame, cols: tuple[str, ...]) -> Column:
    kinds = dict(df.dtypes)
    return F.concat_ws("||", *(normalize_key(F.col(c), kinds[c]) for c in cols))


@dataclass
class FeaturePipeline:
    """A fitted pipeline: a table of keys in the shared folder, and small facts on the driver.

    The table has one row a feature and key: its rows, the sum of their labels and its code.
    """

    spec: PipelineSpec
    rows: int
    prior: float
    hot: dict[str, list[str]]
    table: str

    @classmethod
    def fit(cls, df: DataFrame, spec: PipelineSpec, label: str | None = None) -> FeaturePipeline:
        """Counts all keys of all features in one grouping.

        Missing values are a key of their own.  An empty table gives a pipeline
        without keys.  ``ctr`` needs a label; null labels count as 0.
        """
        if spec.ctr and label is None:
            raise ValueError("target means need a label")
        y = F.coalesce(F.col(label).cast("double"), F.lit(0.0)) if label else F.lit(0.0)
        whole = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m")).first()
        spark, path = df.sparkSession, scratch_folder(df.sparkSession, "feature-keys")
        cols = spec.keys()
        pairs = F.array(*(F.struct(F.lit(f).alias("feature"), _key(df, c).alias("key")) for f, c in cols.items())) if cols else F.array().cast("array<struct<feature:string,key:string>>")
        counts = df.select(F.explode(pairs).alias("p"), y.alias("y")).groupBy("p.feature", "p.key").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
        # Distinct keys only: one sort a feature.
        by_count = F.row_number().over(Window.partitionBy("feature").orderBy(F.col("n").desc(), "key"))
        many = F.count(F.lit(1)).over(Window.partitionBy("feature")) > spec.max_keys
        own = ~many | (by_count < spec.max_keys) if spec.max_keys > 1 else F.lit(True)
        code = F.when(F.col("own"), F.row_number().over(Window.partitionBy("feature").orderBy(~F.col("own"), "key")) - 1)
        coded = counts.withColumn("own", own).withColumn("code", F.coalesce(code, F.lit(spec.max_keys - 1)).cast("int"))
        coded.select("feature", "key", "n", "s", "code").write.parquet(path)
        pipeline = cls(spec, int(whole.n), float(whole.m or 0.0), {}, path)
        if spec.one_hot:
            few = pipeline._keys(spark).filter(F.col("feature").isin(list(spec.categorical))).groupBy("feature").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= spec.one_hot)
            kept = pipeline._keys(spark).join(few, "feature").select("feature", "key").orderBy("feature", "key").collect()
            for r in kept:
                pipeline.hot.setdefault(r.feature, []).append(r.key)
        return pipeline

    def _keys(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_KEYS).parquet(self.table)

    def _with_codes(self, df: DataFrame, stats: bool) -> DataFrame:
        """``df`` with codes, indicators and, with ``stats``, the fitted means and frequencies."""
        spec, spark = self.spec, df.sparkSession
        for name, cols in self.spec.keys().items():
            key = f"__key_{name}"
            df = df.withColumn(key, _key(df, cols))
            if name in self.hot:
                df = df.withColumns({f"{name}_is_{sanitize_name(k)}": (F.col(key) == F.lit(k)).cast("float") for k in self.hot[name]})
            coded = name not in self.hot and (name in spec.categorical or name not in spec.ctr)
            lookup = stats and name in spec.ctr
            if coded or lookup:
                found = self._keys(spark).filter(F.col("feature") == name).select(F.col("key").alias("__key"), F.col("n").alias("__n"), F.col("s").alias("__s"), F.col("code").alias("__code"))
                df = df.join(found, F.col(key) == F.col("__key"), "left")
                if coded:
                    df = df.withColumn(f"{name}_code", F.coalesce("__code", self._other(spark, name)))
                if lookup:
                    n, a = F.coalesce("__n", F.lit(0)), F.lit(self.spec.strength)
                    share = n / F.lit(max(self.rows, 1))
                    df = df.withColumns({
                        f"{name}_mean": (F.coalesce("__s", F.lit(0.0)) + a * self.prior) / F.greatest(n + a, F.lit(1.0)),
                        f"{name}_freq": (n + a * share) / F.greatest(F.lit(self.rows) + a, F.lit(1.0)),
                    })
                df = df.drop("__key", "__n", "__s", "__code")
        return df

    def _other(self, spark: SparkSession, name: str) -> Column:
        """Code of unknown keys: that of the others, or null where every key has its own."""
        if self.spec.max_keys > 1 and self._keys(spark).filter(F.col("feature") == name).limit(self.spec.max_keys + 1).count() > self.spec.max_keys:
            return F.lit(self.spec.max_keys - 1)
        return F.lit(None).cast("int")

    def _finish(self, df: DataFrame, keep: list[str]) -> DataFrame:
        spec = self.spec
        for c in spec.text:
            counts = f"__hash_{c}"
            df = df.withColumn(counts, hashed_counts(F.col(c), spec.hash_dim))
            df = df.withColumns({f"{c}_hash_{i}": F.get(counts, F.lit(i)) for i in range(spec.hash_dim)}).drop(counts)
        for c in spec.embedding:
            df = df.withColumns({f"{c}_{k}": v for k, v in embedding_stats(F.col(c)).items()})
        return df.select(*keep, *(c for c in self.feature_names() if c not in keep))

    def feature_names(self) -> list[str]:
        """Output features in order."""
        spec, out = self.spec, list(self.spec.numeric)
        for name in spec.keys():
            if name in self.hot:
                out += [f"{name}_is_{sanitize_name(k)}" for k in self.hot[name]]
            elif name in spec.categorical or name not in spec.ctr:
                out.append(f"{name}_code")
            out += [f"{name}_mean", f"{name}_freq"] if name in spec.ctr else []
        out += [f"{c}_hash_{i}" for c in spec.text for i in range(spec.hash_dim)]
        return out + [f"{c}_{k}" for c in spec.embedding for k in ("mean", "std", "min", "max", "l2", "sum", "dim")]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` and the features of each row by what was fitted; an unknown key has the prior's mean and frequency 0."""
        return self._finish(self._with_codes(df, stats=True), keep or [])

    @classmethod
    def fit_transform(cls, df: DataFrame, spec: PipelineSpec, label: str, order: str, keep: list[str] | None = None) -> tuple[FeaturePipeline, DataFrame]:
        """The pipeline and the training rows' features, whose means and frequencies count only rows before them in ``order``."""
        pipeline = cls.fit(df, spec, label)
        out = pipeline._with_codes(df, stats=False)
        y, prior = F.coalesce(F.col(label).cast("double"), F.lit(0.0)), F.lit(pipeline.prior)
        for name in spec.ctr:
            out = ordered_mean(out.withColumn("__y", y), f"__key_{name}", "__y", order, prior, spec.strength, f"{name}_mean").drop("__y")
            out = ordered_frequency(out, f"__key_{name}", order, spec.strength, f"{name}_freq")
        return pipeline, pipeline._finish(out, keep or [])

    def save(self, spark: SparkSession, path: str) -> None:
        """Keys as Parquet and the rest as JSON, in any file system that the session knows."""
        self._keys(spark).write.mode("overwrite").parquet(f"{path}/keys")
        write_text(spark, f"{path}/pipeline.json", json.dumps({"format": 1, "spec": asdict(self.spec), "rows": self.rows, "prior": self.prior, "hot": self.hot}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeaturePipeline:
        d = json.loads(read_text(spark, f"{path}/pipeline.json"))
        if d.get("format") != 1:
            raise ValueError("not a feature pipeline")
        spec = {k: tuple(map(tuple, v)) if k == "combinations" else tuple(v) if isinstance(v, list) else v for k, v in d["spec"].items()}
        return cls(PipelineSpec(**spec), d["rows"], d["prior"], d["hot"], f"{path}/keys")


__all__ = ["FeaturePipeline", "PipelineSpec"]
