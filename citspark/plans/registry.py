"""Queries over the driver's tables, each with the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citspark.functions import columns as C
from citspark.functions.hashing import hashed_counts
from citspark.operators import features as X
from citspark.operators import metrics as M
from citspark.operators import objectives as O
from citspark.operators import prepare as P
from citspark.operators import quantize as Q
from citspark.operators import stats as S
from citspark.operators.boosting import BoostParams, fit
from citspark.operators.multiclass import fit_multiclass
from citspark.operators.pipeline import FeaturePipeline, PipelineSpec
from citspark.operators.tree import TreeParams
from citspark.sources.storage import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: sums differ in the last bits by order."""
    return df.select(*(C.rounded(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


# --- inputs by role: Spark frames and the same as SQL -------------------------------------------


def _regression(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "lineitem")
    return t.select("l_returnflag", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 25000).alias("p"), (1 - F.col("l_discount")).alias("w"))


REGRESSION = "(SELECT l_returnflag, l_quantity AS y, l_extendedprice / 25000 AS p, 1 - l_discount AS w FROM lineitem)"


def _survival(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "events")
    y = F.when(F.col("event_type") == "error", F.col("value")).otherwise(-F.col("value"))
    return t.select(F.col("event_id").alias("row_id"), y.alias("y"), ((F.col("user_id") % 7) / 10.0).alias("p"))


SURVIVAL = "(SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN value ELSE -value END AS y, (user_id % 7) / 10.0 AS p FROM events)"


def _binary(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return t.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("y"), (F.col("n_chars") % 200 / 100.0 - 1).alias("p"))


BINARY = "(SELECT l.doc_id AS row_id, CAST(l.quality AS DOUBLE) AS y, CAST(d.n_chars % 200 / 100.0 - 1 AS DOUBLE) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "orders")
    return t.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("group_id"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("double").alias("y"), (F.col("o_totalprice") / 100000).alias("p"), F.col("o_orderstatus").alias("sub"))


RANKING = "(SELECT o_orderkey AS row_id, o_custkey AS group_id, CAST(5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS DOUBLE) AS y, o_totalprice / 100000 AS p, o_orderstatus AS sub FROM orders)"


def _multiclass(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "embeddings")
    return t.select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"), F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double")).alias("p"))


MULTICLASS = "(SELECT vec_id AS row_id, label AS y, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS p FROM embeddings)"
SIGMOID = "(1 / (1 + exp(-p)))"

# --- objectives -----------------------------------------------------------------------------------

_POINT = {
    "rmse": ("p - y", "1.0", REGRESSION),
    "mae": ("CASE WHEN p > y THEN 1.0 WHEN p < y THEN -1.0 ELSE 0.0 END", "1.0", REGRESSION),
    "huber": ("CASE WHEN abs(p - y) <= 1 THEN p - y WHEN p > y THEN 1.0 ELSE -1.0 END", "CASE WHEN abs(p - y) <= 1 THEN 1.0 ELSE 0.0 END", REGRESSION),
    "quantile": ("CASE WHEN y - p > 0 THEN -0.5 ELSE 0.5 END", "1.0", REGRESSION),
    "poisson": ("exp(p) - y", "exp(p)", REGRESSION),
    "tweedie": ("-y * exp(-0.5 * p) + exp(0.5 * p)", "greatest(y * 0.5 * exp(-0.5 * p) + 0.5 * exp(0.5 * p), 1e-12)", REGRESSION),
    "logloss": (f"{SIGMOID} - y", f"{SIGMOID} * (1 - {SIGMOID})", BINARY),
    "survivalexponential": ("exp(p) * abs(y) - CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END", "greatest(exp(p) * abs(y), 1e-12)", SURVIVAL),
}
_INPUT = {REGRESSION: _regression, BINARY: _binary, SURVIVAL: _survival}


def _objective(name: str, source: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = O.with_gradients(_INPUT[source](spark, d), name)
        if source == REGRESSION:
            return _round(rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("sum_g"), F.sum("h").alias("sum_h"), F.sum(F.col("g") * F.col("w")).alias("sum_wg")), 4)
        return _round(rows.select("row_id", "g", "h"))

    return query


for _name, (_g, _h, _src) in _POINT.items():
    if _src == REGRESSION:
        _sql = f"SELECT l_returnflag, count(*) AS n, round(sum({_g}), 4) AS sum_g, round(sum(CAST({_h} AS DOUBLE)), 4) AS sum_h, round(sum(({_g}) * w), 4) AS sum_wg FROM {_src} GROUP BY 1"
        _sql = _sql.replace(f"round(sum({_g}), 4)", f"round(sum(CAST({_g} AS DOUBLE)), 4)")
    else:
        _sql = f"SELECT row_id, round(CAST({_g} AS DOUBLE), 6) AS g, round(CAST({_h} AS DOUBLE), 6) AS h FROM {_src}"
    _add(f"obj_{_name}", _objective(_name, _src), _sql)

_add(
    "obj_softmax",
    lambda s, d: _round(O.softmax_gradients(_multiclass(s, d), 10).select("row_id", F.posexplode(F.arrays_zip("g", "h")).alias("k", "x")).select("row_id", "k", F.col("x.g").alias("g"), F.col("x.h").alias("h"))),
    f"""WITH e AS (SELECT row_id, y, unnest(range(0, 10)) AS k, unnest(p) AS v FROM {MULTICLASS}),
    s AS (SELECT row_id, y, k, exp(v) / sum(exp(v)) OVER (PARTITION BY row_id) AS s FROM e)
    SELECT row_id, CAST(k AS INT) AS k, round(s - CASE WHEN k = y THEN 1.0 ELSE 0.0 END, 6) AS g, round(s * (1 - s), 6) AS h FROM s""",
)
_COX = f"""WITH r AS (SELECT *, abs(y) AS t, exp(p) AS e FROM {SURVIVAL}),
t AS (SELECT t, sum(e) AS s, sum(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS d FROM r GROUP BY t),
k AS (SELECT t, d, sum(s) OVER (ORDER BY t DESC) AS r FROM t),
a AS (SELECT t, sum(d / r) OVER (ORDER BY t) AS a, sum(d / (r * r)) OVER (ORDER BY t) AS b FROM k)"""
_add(
    "obj_cox",
    lambda s, d: _round(O.cox_gradients(_survival(s, d)).select("row_id", "g", "h")),
    _COX + " SELECT row_id, round(e * a - CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END, 6) AS g, round(greatest(e * a - e * e * b, 1e-12), 6) AS h FROM r JOIN a USING (t)",
)
_PAIRS = f"(SELECT a.row_id AS winner, b.row_id AS loser, a.p - b.p AS margin FROM {RANKING} a JOIN {RANKING} b ON a.group_id = b.group_id AND a.y > b.y AND a.sub <> b.sub)"
_add(
    "group_pairs",
    lambda s, d: _round(O.group_pairs(_ranking(s, d), subgroup="sub").select("winner", "loser", "margin"), 9),
    f"SELECT winner, loser, round(margin, 9) AS margin FROM {_PAIRS}",
)
_add(
    "obj_pairlogit",
    lambda s, d: _round(O.pairlogit_gradients(O.group_pairs(_ranking(s, d), subgroup="sub"))),
    f"""WITH p AS (SELECT winner, loser, 1 / (1 + exp(-margin)) AS s FROM {_PAIRS}),
    e AS (SELECT winner AS row_id, -(1 - s) AS g, s * (1 - s) AS h FROM p UNION ALL SELECT loser, 1 - s, s * (1 - s) FROM p)
    SELECT row_id, round(sum(g), 6) AS g, round(sum(h), 6) AS h FROM e GROUP BY row_id""",
)

# --- metrics --------------------------------------------------------------------------------------


def _metric(name: str, make: Callable[[SparkSession, str], DataFrame], **columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _round(M.evaluate(make(s, d), name, **columns))


_mean = lambda loss, src: f"SELECT round(sum(w * ({loss})) / sum(w), 6) AS value FROM {src}"
_plain = lambda loss, src: f"SELECT round(avg({loss}), 6) AS value FROM {src}"
_add("m_rmse", _metric("rmse", _regression, w="w"), f"SELECT round(sqrt(sum(w * (p - y) * (p - y)) / sum(w)), 6) AS value FROM {REGRESSION}")
_add("m_mae", _metric("mae", _regression, w="w"), _mean("abs(p - y)", REGRESSION))
_add("m_huber", _metric("huber", _regression, w="w"), _mean("CASE WHEN abs(p - y) <= 1 THEN 0.5 * (p - y) * (p - y) ELSE abs(p - y) - 0.5 END", REGRESSION))
_add("m_quantile", _metric("quantile", _regression, w="w"), _mean("0.5 * abs(y - p)", REGRESSION))
_add("m_poisson", _metric("poisson", _regression, w="w"), _mean("exp(p) - y * p + lgamma(y + 1)", REGRESSION))
_add("m_tweedie", _metric("tweedie", _regression, w="w"), _mean("y * exp(-0.5 * p) / 0.5 + exp(0.5 * p) / 0.5", REGRESSION))
_add("m_logloss", _metric("logloss", _binary), _plain(f"-(y * ln({SIGMOID}) + (1 - y) * ln(1 - {SIGMOID}))", BINARY))
_add("m_accuracy", _metric("accuracy", _binary), _plain("CASE WHEN (p >= 0) = (y > 0.5) THEN 1.0 ELSE 0.0 END", BINARY))
_add("m_balanced_accuracy", _metric("balanced_accuracy", _binary), f"SELECT round(avg(r), 6) AS value FROM (SELECT y, avg(CASE WHEN (p >= 0) = (y > 0.5) THEN 1.0 ELSE 0.0 END) AS r FROM {BINARY} GROUP BY y)")
_CONF = f"(SELECT CAST(sum(CASE WHEN p >= 0 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN p >= 0 AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN p < 0 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM {BINARY})"
_add("m_precision", _metric("precision", _binary), f"SELECT round(tp / (tp + fp), 6) AS value FROM {_CONF}")
_add("m_recall", _metric("recall", _binary), f"SELECT round(tp / (tp + fn), 6) AS value FROM {_CONF}")
_add("m_f1", _metric("f1", _binary), f"SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS value FROM {_CONF}")
_add(
    "m_auc",
    _metric("auc", _binary),
    f"""WITH g AS (SELECT p, sum(y) AS a, sum(1 - y) AS b FROM {BINARY} GROUP BY p),
    c AS (SELECT a, b, a * (coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * b) AS c FROM g)
    SELECT round(sum(c) / (sum(a) * sum(b)), 6) AS value FROM c""",
)
_add(
    "m_multi_logloss",
    _metric("multiclass", _multiclass),
    f"""WITH e AS (SELECT row_id, y, unnest(range(0, 10)) AS k, unnest(p) AS v FROM {MULTICLASS}),
    s AS (SELECT y, k, exp(v) / sum(exp(v)) OVER (PARTITION BY row_id) AS s FROM e) SELECT round(avg(-ln(s)), 6) AS value FROM s WHERE k = y""",
)
_add(
    "m_multi_accuracy",
    _metric("accuracy", _multiclass),
    f"SELECT round(avg(CASE WHEN list_position(p, list_max(p)) - 1 = y THEN 1.0 ELSE 0.0 END), 6) AS value FROM {MULTICLASS}",
)
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY p DESC, row_id) AS k, row_number() OVER (PARTITION BY group_id ORDER BY y DESC, row_id) AS i FROM {RANKING})"
_add(
    "m_ndcg",
    _metric("ndcg", _ranking),
    f"SELECT round(avg(a / b), 6) AS value FROM (SELECT sum((pow(2, y) - 1) / log2(k + 1)) AS a, sum((pow(2, y) - 1) / log2(i + 1)) AS b, count(*) AS n FROM {_RANKED} GROUP BY group_id) WHERE n > 1 AND b > 0",
)
_add(
    "m_map",
    _metric("map", _ranking),
    f"""WITH h AS (SELECT group_id, k, CASE WHEN y > 0 THEN 1 ELSE 0 END AS hit FROM {_RANKED}),
    c AS (SELECT *, sum(hit) OVER (PARTITION BY group_id ORDER BY k) AS hits FROM h)
    SELECT round(avg(a), 6) AS value FROM (SELECT sum(CAST(hit * hits AS DOUBLE) / k) / sum(hit) AS a FROM c GROUP BY group_id HAVING sum(hit) > 0)""",
)
_add("m_mrr", _metric("mrr", _ranking), f"SELECT round(avg(1.0 / k), 6) AS value FROM (SELECT min(k) AS k FROM {_RANKED} WHERE y > 0 GROUP BY group_id)")
_add("m_pairlogit", lambda s, d: _round(M.pairlogit(O.group_pairs(_ranking(s, d), subgroup="sub"))), f"SELECT round(avg(ln(1 + exp(-margin))), 6) AS value FROM {_PAIRS}")
_add("m_cox", _metric("cox", _survival), _COX + " SELECT round(sum(CASE WHEN y > 0 THEN ln(k.r) - p ELSE 0 END) / sum(CASE WHEN y > 0 THEN 1 ELSE 0 END), 6) AS value FROM r JOIN k USING (t)")
_add("m_survivalexponential", _metric("survivalexponential", _survival), _plain("exp(p) * abs(y) - CASE WHEN y > 0 THEN p ELSE 0 END", SURVIVAL))
_add(
    "m_cindex",
    _metric("cindex", _survival),
    f"""WITH r AS (SELECT abs(y) AS t, p, y > 0 AS e FROM {SURVIVAL})
    SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*), 6) AS value FROM r a JOIN r b ON b.t > a.t WHERE a.e""",
)

# --- feature pipeline -----------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "events")
    return t.withColumn("kind", F.when(F.col("event_id") % 9 != 0, F.col("event_type")))


EVENTS = "(SELECT *, CASE WHEN event_id % 9 <> 0 THEN event_type END AS kind FROM events)"
_add("category_counts", lambda s, d: X.category_counts(_events(s, d), "kind"), f"SELECT coalesce(kind, '__missing__') AS key, count(*) AS n FROM {EVENTS} GROUP BY 1")
_add("combo_counts", lambda s, d: X.category_counts(_read(s, d, "part"), "p_brand", "p_type"), "SELECT p_brand || '||' || p_type AS key, count(*) AS n FROM part GROUP BY 1")
_add(
    "cat_lookup",
    lambda s, d: X.encode(_events(s, d), X.dictionary(_events(s, d), "kind"), "kind").select("event_id", "code"),
    f"WITH k AS (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS INT) AS code FROM (SELECT DISTINCT coalesce(kind, '__missing__') AS key FROM {EVENTS})) SELECT event_id, code FROM {EVENTS} JOIN k ON coalesce(kind, '__missing__') = key",
)
_add(
    "bucket_top_k",
    lambda s, d: X.dictionary(_read(s, d, "part"), "p_type", max_keys=5),
    "WITH c AS (SELECT p_type AS key, count(*) AS n FROM part GROUP BY 1), t AS (SELECT key FROM c ORDER BY n DESC, key LIMIT 4) SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS INT) AS code FROM t UNION ALL SELECT '__other__', 4",
)
_add(
    "one_hot",
    lambda s, d: X.one_hot(_events(s, d), "kind", ["click", "error", C.MISSING_KEY]).select("event_id", "kind_is_click", "kind_is_error", "kind_is_missing"),
    f"SELECT event_id, CAST(coalesce(kind = 'click', false) AS FLOAT) AS kind_is_click, CAST(coalesce(kind = 'error', false) AS FLOAT) AS kind_is_error, CAST(kind IS NULL AS FLOAT) AS kind_is_missing FROM {EVENTS}",
)
_add(
    "ordered_mean_ctr",
    lambda s, d: _round(X.ordered_mean(_read(s, d, "events"), "event_type", "value", "event_id", F.lit(0.5)).select("event_id", "ctr"), 8),
    "SELECT event_id, round((coalesce(sum(value) OVER w, 0) + 0.5) / (count(*) OVER w + 1), 8) AS ctr FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
_add(
    "ordered_freq_ctr",
    lambda s, d: _round(X.ordered_frequency(_read(s, d, "events"), "event_type", "event_id").select("event_id", "freq")),
    "WITH f AS (SELECT *, count(*) OVER (PARTITION BY event_type) / CAST(count(*) OVER () AS DOUBLE) AS share FROM events) SELECT event_id, round((count(*) OVER w + share) / (row_number() OVER (ORDER BY event_id) - 1 + 1.0), 6) AS freq FROM f WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
_add("ctr_totals", lambda s, d: _round(X.full_mean(_read(s, d, "events"), "event_type", "value", F.lit(0.5)), 4), "SELECT event_type, round((sum(value) + 0.5) / (count(*) + 1), 4) AS ctr FROM events GROUP BY 1")
_add(
    "hash_text",
    lambda s, d: _read(s, d, "documents").select("doc_id", F.explode(C.ascii_tokens(F.col("text"))).alias("tok")).groupBy("doc_id", C.md5_bucket(F.col("tok"), 16).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) AS tok FROM documents) SELECT doc_id, CAST(CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 16 AS INT) AS bucket, count(*) AS n FROM t GROUP BY 1, 2",
)
_add(
    "embedding_stats",
    lambda s, d: _round(_read(s, d, "embeddings").select("vec_id", *(c.alias(k) for k, c in C.embedding_stats(F.col("embedding")).items()))),
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS std, round(list_min(e), 6) AS min, round(list_max(e), 6) AS max, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS l2, round(list_sum(e), 6) AS sum, CAST(len(e) AS DOUBLE) AS dim FROM e",
)
_add("balanced_class_weight", lambda s, d: _round(X.class_weights(_read(s, d, "labels"), "quality")), "SELECT quality, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY quality")
_add("is_missing", lambda s, d: _events(s, d).select("event_id", C.is_missing(F.col("kind")).alias("missing")), f"SELECT event_id, kind IS NULL AS missing FROM {EVENTS}")
_add("slice_rows", lambda s, d: _read(s, d, "orders").filter(F.col("o_orderkey") % 3 == 1).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 1")
_add("scan_dense", lambda s, d: _read(s, d, "orders").select(F.col("o_totalprice").cast("float").alias("f0"), F.lit(1.0).alias("w"), F.col("o_orderkey").alias("row_id")), "SELECT CAST(o_totalprice AS FLOAT) AS f0, CAST(1.0 AS DOUBLE) AS w, o_orderkey AS row_id FROM orders")

# --- quantization, histogram, statistic, split ----------------------------------------------------


def _small(spark: SparkSession, d: str) -> DataFrame:
    """Three features and a label of scale one, by a key."""
    t = _read(spark, d, "orders")
    return t.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("price"),
        (F.col("o_custkey") % 97).cast("double").alias("cust"),
        F.month("o_orderdate").cast("double").alias("month"),
        (F.col("o_totalprice") / 100000 + F.month("o_orderdate") / 12.0).alias("label"),
    )


SMALL = "(SELECT o_orderkey AS row_id, o_totalprice AS price, CAST(o_custkey % 97 AS DOUBLE) AS cust, CAST(month(o_orderdate) AS DOUBLE) AS month, o_totalprice / 100000 + month(o_orderdate) / 12.0 AS label FROM orders)"
_CUTS = f"""WITH v AS (SELECT CAST(CAST(price AS FLOAT) AS DOUBLE) AS v, row_number() OVER (ORDER BY CAST(price AS FLOAT)) - 1 AS k, count(*) OVER () AS n FROM {SMALL}),
cuts AS (SELECT DISTINCT v AS cut FROM v WHERE k IN (SELECT (b * n) // 8 FROM (SELECT DISTINCT n FROM v), range(1, 8) r(b)) AND v > (SELECT min(v) FROM v))"""
_add("quantile_cuts", lambda s, d: Q.quantile_cut_table(_small(s, d), "price", 8), _CUTS + " SELECT cut FROM cuts")
_add(
    "bin_lookup",
    lambda s, d: Q.with_bins(_small(s, d), Q.fit_bins(_small(s, d), ["price"], 8)).select("row_id", F.get("bins", F.lit(0)).alias("bin")),
    _CUTS + f" SELECT row_id, CAST((SELECT count(*) FROM cuts WHERE cut <= CAST(CAST(price AS FLOAT) AS DOUBLE)) AS INT) AS bin FROM {SMALL}",
)
_add(
    "uniform_cuts",
    lambda s, d: s.range(1).select(F.explode(F.array(*(F.lit(c) for c in Q.uniform_cuts(_small(s, d), "cust", 8)))).alias("cut")),
    f"SELECT lo + k * (hi - lo) / 8 AS cut FROM (SELECT min(cust) AS lo, max(cust) AS hi FROM {SMALL}), range(1, 8) r(k)",
)
_MONTHS = f"(SELECT CAST(month - 1 AS INT) AS bin, -label AS g, 1.0 AS h FROM {SMALL})"


def _month_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = _small(spark, d)
    return rows.select("row_id", (-F.col("label")).alias("g"), F.lit(1.0).alias("h"), F.lit(1.0).alias("w"), F.array((F.col("month") - 1).cast("int")).alias("bins"))


def _histogram(s: SparkSession, d: str) -> DataFrame:
    return S.histogram(_month_bins(s, d), [])


_add("node_histogram", lambda s, d: _round(_histogram(s, d).select("bin", "sum_w", "sum_g", "sum_h", "n"), 5), f"SELECT bin, CAST(count(*) AS DOUBLE) AS sum_w, round(sum(g), 5) AS sum_g, CAST(count(*) AS DOUBLE) AS sum_h, count(*) AS n FROM {_MONTHS} GROUP BY bin")
_add(
    "node_totals",
    lambda s, d: _round(_month_bins(s, d).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sum_w"), F.sum("g").alias("sum_g"), F.sum(F.col("g") * F.col("g")).alias("sum_gg")), 4),
    f"SELECT count(*) AS n, CAST(count(*) AS DOUBLE) AS sum_w, round(sum(g), 4) AS sum_g, round(sum(g * g), 4) AS sum_gg FROM {_MONTHS}",
)
_add(
    "cit_statistic",
    lambda s, d: _round(S.statistic_table(_histogram(s, d), ["feature"]).select("chi_square", "df"), 4),
    f"""WITH b AS (SELECT bin, CAST(count(*) AS DOUBLE) AS w, sum(g) AS g, sum(g * g) AS q FROM {_MONTHS} GROUP BY bin),
    t AS (SELECT sum(w) AS n, sum(g) AS gg, sum(q) AS qq, count(*) AS k FROM b)
    SELECT round((n - 1) / (n * (qq / n - (gg / n) * (gg / n))) * (SELECT sum((b.g - b.w * t.gg / t.n) * (b.g - b.w * t.gg / t.n) / b.w) FROM b), 4) AS chi_square, CAST(k - 1 AS BIGINT) AS df FROM t""",
)


def split_scan(hist: DataFrame, keys: list[str], l2: float = 1.0) -> DataFrame:
    """Gain of each prefix of the bins, by a window over the histogram."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    run = hist.select(*keys, "bin", F.sum("sum_g").over(w).alias("lg"), F.sum("sum_h").over(w).alias("lh"), F.sum("sum_g").over(whole).alias("g"), F.sum("sum_h").over(whole).alias("h"))
    value = C.gain(F.col("lg"), F.col("lh"), l2) + C.gain(F.col("g") - F.col("lg"), F.col("h") - F.col("lh"), l2) - C.gain(F.col("g"), F.col("h"), l2)
    return run.select(*keys, "bin", value.alias("gain"))


_SCAN = f"""WITH b AS (SELECT bin, CAST(count(*) AS DOUBLE) AS h, sum(g) AS g FROM {_MONTHS} GROUP BY bin),
r AS (SELECT bin, sum(g) OVER (ORDER BY bin) AS lg, sum(h) OVER (ORDER BY bin) AS lh, sum(g) OVER () AS g, sum(h) OVER () AS h FROM b),
s AS (SELECT bin, lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1) AS gain FROM r)"""
_add("numeric_split_scan", lambda s, d: _round(split_scan(_histogram(s, d), ["feature"]).select("bin", "gain"), 4), _SCAN + " SELECT bin, round(gain, 4) AS gain FROM s")
_add("best_split", lambda s, d: _round(split_scan(_histogram(s, d), ["feature"]).orderBy(F.col("gain").desc(), "bin").limit(1).select("bin", "gain"), 4), _SCAN + " SELECT bin, round(gain, 4) AS gain FROM s ORDER BY s.gain DESC, bin LIMIT 1")
_add(
    "target_mode",
    lambda s, d: _read(s, d, "embeddings").agg(F.countDistinct("label").alias("classes"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_and(F.col("label") == F.rint(F.col("label").cast("double"))).alias("whole")),
    "SELECT count(DISTINCT label) AS classes, min(label) AS lo, max(label) AS hi, bool_and(label = round(label)) AS whole FROM embeddings",
)


# --- lookups, slices and driver-table aggregates ----------------------------------------------------

_add(
    "scan_pandas",
    lambda s, d: (lambda e: e.join(F.broadcast(X.dictionary(e.filter("kind IS NOT NULL"), "kind")), F.col("kind") == F.col("key"), "left").select("event_id", F.coalesce("code", F.lit(-1)).alias("code")))(_events(s, d)),
    f"WITH k AS (SELECT kind, CAST(row_number() OVER (ORDER BY kind) - 1 AS INT) AS code FROM (SELECT DISTINCT kind FROM {EVENTS} WHERE kind IS NOT NULL)) SELECT event_id, coalesce(code, -1) AS code FROM {EVENTS} e LEFT JOIN k ON e.kind = k.kind",
)
_add(
    "scan_sparse",
    lambda s, d: _read(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "v")).filter("v > 0.1").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v").cast("double")), 5).alias("total")),
    "SELECT CAST(k AS INT) AS feature, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 5) AS total FROM (SELECT unnest(range(0, 64)) AS k, unnest(embedding) AS v FROM embeddings) WHERE v > CAST(0.1 AS DOUBLE) GROUP BY 1",
)


def _csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "demo-csv")
    P.write_submission(_read(spark, d, "part"), path, "p_partkey", "p_name", "p_retailprice")
    return P.read_csv(spark, path, "p_partkey long, p_name string, p_retailprice double")


_add(
    "csv_demo_scan",
    lambda s, d: _csv(s, d).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.count("p_name").alias("n"), F.sum("p_partkey").alias("keys")),
    "SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(p_name) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part",
)
_add(
    "class_weight_lookup",
    lambda s, d: _round(_read(s, d, "labels").join(F.broadcast(X.class_weights(_read(s, d, "labels"), "quality")), "quality").select("doc_id", "weight")),
    "SELECT doc_id, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY quality)), 6) AS weight FROM labels",
)
_add(
    "slice_pairs",
    lambda s, d: (lambda p, k: p.join(k.select(F.col("row_id").alias("winner")), "winner", "left_semi").join(k.select(F.col("row_id").alias("loser")), "loser", "left_semi").select("winner", "loser"))(O.group_pairs(_ranking(s, d), subgroup="sub"), _ranking(s, d).filter("row_id % 2 = 0")),
    f"SELECT winner, loser FROM {_PAIRS} WHERE winner % 2 = 0 AND loser % 2 = 0",
)
_add(
    "pairs_to_rows",
    lambda s, d: _round(O.group_pairs(_ranking(s, d), subgroup="sub").join(_ranking(s, d).select(F.col("row_id").alias("winner"), F.col("p").alias("p_winner")), "winner").join(_ranking(s, d).select(F.col("row_id").alias("loser"), F.col("p").alias("p_loser")), "loser").select("winner", "loser", "p_winner", "p_loser"), 9),
    f"SELECT winner, loser, round(a.p, 9) AS p_winner, round(b.p, 9) AS p_loser FROM {_PAIRS} x JOIN {RANKING} a ON a.row_id = winner JOIN {RANKING} b ON b.row_id = loser",
)
_add("min_max", lambda s, d: _small(s, d).agg(F.min("price").alias("lo"), F.max("price").alias("hi")), f"SELECT min(price) AS lo, max(price) AS hi FROM {SMALL}")
_add("unique_capped", lambda s, d: _small(s, d).agg(F.least(F.countDistinct("cust"), F.lit(1024)).alias("n")), f"SELECT least(count(DISTINCT cust), 1024) AS n FROM {SMALL}")
_add(
    "gradient_variance",
    lambda s, d: _round(_month_bins(s, d).agg((F.sum(F.col("g") * F.col("g")) / F.sum("w")).alias("q"), (F.sum("g") / F.sum("w")).alias("m")).select(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")).alias("variance"))),
    f"SELECT round(greatest(0, avg(g * g) - avg(g) * avg(g)), 6) AS variance FROM {_MONTHS}",
)
_add(
    "histogram_subtract",
    lambda s, d: (lambda r: _round(S.histogram(r, []).join(S.histogram(r.filter("row_id % 3 = 0"), []).select("feature", "bin", F.col("sum_g").alias("child_g"), F.col("n").alias("child_n")), ["feature", "bin"], "left").select("bin", (F.col("sum_g") - F.coalesce("child_g", F.lit(0.0))).alias("sum_g"), F.greatest(F.lit(0), F.col("n") - F.coalesce("child_n", F.lit(0))).alias("n")), 5))(_month_bins(s, d)),
    f"SELECT CAST(month - 1 AS INT) AS bin, round(coalesce(sum(CASE WHEN row_id % 3 <> 0 THEN -label END), 0), 5) AS sum_g, CAST(sum(CASE WHEN row_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM {SMALL} GROUP BY 1",
)
_add(
    "allreduce_histogram",
    lambda s, d: (lambda r: _round(S.histogram(r.withColumn("rank", F.col("row_id") % 4), ["rank"]).groupBy("bin").agg(F.sum("sum_g").alias("sum_g"), F.sum("n").alias("n")), 5))(_month_bins(s, d)),
    f"SELECT bin, round(sum(g), 5) AS sum_g, count(*) AS n FROM {_MONTHS} GROUP BY bin",
)
_add(
    "categorical_split_scan",
    lambda s, d: (lambda h: _round(split_scan(h.select("feature", (F.row_number().over(Window.partitionBy("feature").orderBy(F.col("sum_g") / (F.col("sum_h") + 1), "bin")) - 1).cast("int").alias("bin"), "sum_g", "sum_h"), ["feature"]).select(F.col("bin").alias("place"), "gain"), 4))(_histogram(s, d)),
    f"""WITH b AS (SELECT bin, CAST(count(*) AS DOUBLE) AS h, sum(g) AS g FROM {_MONTHS} GROUP BY bin),
    o AS (SELECT CAST(row_number() OVER (ORDER BY g / (h + 1), bin) - 1 AS INT) AS place, g, h FROM b),
    r AS (SELECT place, sum(g) OVER (ORDER BY place) AS lg, sum(h) OVER (ORDER BY place) AS lh, sum(g) OVER () AS g, sum(h) OVER () AS h FROM o)
    SELECT place, round(lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1), 4) AS gain FROM r""",
)
_add(
    "route_left",
    lambda s, d: _month_bins(s, d).select("row_id", F.when(F.get("bins", F.lit(0)) <= 5, F.lit(1)).otherwise(F.lit(2)).alias("node")),
    f"SELECT row_id, CASE WHEN month - 1 <= 5 THEN 1 ELSE 2 END AS node FROM {SMALL}",
)
_add(
    "leaf_refit",
    lambda s, d: _round(_month_bins(s, d).groupBy((F.get("bins", F.lit(0)) <= 5).cast("int").alias("leaf")).agg(C.leaf_weight(F.sum("g"), F.sum("h"), 1.0).alias("weight"))),
    f"SELECT CAST(bin <= 5 AS INT) AS leaf, round(-sum(g) / (count(*) + 1), 6) AS weight FROM {_MONTHS} GROUP BY 1",
)
_add(
    "leaf_lookup",
    lambda s, d: (lambda r: _round(r.join(F.broadcast(r.groupBy("leaf").agg(C.leaf_weight(F.sum("g"), F.sum("h"), 1.0).alias("weight"))), "leaf").select("row_id", "weight")))(_month_bins(s, d).withColumn("leaf", (F.get("bins", F.lit(0)) <= 5).cast("int"))),
    f"SELECT row_id, round(sum(label) OVER w / (count(*) OVER w + 1), 6) AS weight FROM {SMALL} WINDOW w AS (PARTITION BY month <= 6)",
)
_add(
    "multiclass_structure_class",
    lambda s, d: O.softmax_gradients(_multiclass(s, d), 10).select(F.posexplode("g").alias("k", "g")).groupBy("k").agg(F.var_pop("g").alias("v")).agg(F.max_by("k", "v").alias("k")),
    f"""WITH e AS (SELECT row_id, y, unnest(range(0, 10)) AS k, unnest(p) AS v FROM {MULTICLASS}),
    s AS (SELECT k, exp(v) / sum(exp(v)) OVER (PARTITION BY row_id) - CASE WHEN k = y THEN 1.0 ELSE 0.0 END AS g FROM e)
    SELECT CAST(k AS INT) AS k FROM (SELECT k, var_pop(g) AS v FROM s GROUP BY k) ORDER BY v DESC LIMIT 1""",
)
_add(
    "cv_aggregate",
    lambda s, d: _round(_read(s, d, "orders").groupBy((F.col("o_orderkey") % 3).alias("fold"), F.month("o_orderdate").alias("iteration")).agg(F.avg("o_totalprice").alias("m")).groupBy("iteration").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std")), 4),
    "SELECT iteration, round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std FROM (SELECT o_orderkey % 3 AS fold, CAST(month(o_orderdate) AS INT) AS iteration, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY iteration",
)
_add(
    "best_so_far",
    lambda s, d: S.running_best(_read(s, d, "events").select("event_id", "value"), "event_id", "value").select("event_id", "best"),
    "SELECT event_id, min(value) OVER (ORDER BY event_id) AS best FROM events",
)
_add("predict_proba", lambda s, d: _round(_binary(s, d).select("row_id", C.sigmoid(F.col("p")).alias("proba"), (F.col("p") >= 0).cast("int").alias("label"))), f"SELECT row_id, round({SIGMOID}, 6) AS proba, CAST(p >= 0 AS INT) AS label FROM {BINARY}")
_add(
    "collapse_rare",
    lambda s, d: P.collapse_rare(_read(s, d, "part"), "p_brand", 80, out="brand").select("p_partkey", "brand"),
    "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) < 80 THEN 'rare' ELSE p_brand END AS brand FROM part",
)
_add("log1p_target", lambda s, d: _round(_read(s, d, "part").select("p_partkey", F.log1p("p_retailprice").alias("t"), F.expm1(F.log1p("p_retailprice")).alias("back"))), "SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS t, round(exp(ln(1 + p_retailprice)) - 1, 6) AS back FROM part")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Two boosting rounds and the scores they give."""
    rows = _small(spark, d)
    model = fit(rows, ["price", "cust", "month"], "label", BoostParams(iterations=2, learning_rate=0.5, max_bins=16, tree=TreeParams(max_depth=2)))
    return model.transform(rows).select("row_id", "label", "prediction")


_add("fit_transform", flagship)


def _contributions(spark: SparkSession, d: str) -> DataFrame:
    rows = _small(spark, d)
    model = fit(rows, ["price", "cust", "month"], "label", BoostParams(iterations=2, learning_rate=0.5, max_bins=8, tree=TreeParams(max_depth=2)))
    return model.contributions(model.leaf_indices(model.staged(rows))).select("row_id", "staged", "leaves", "contributions")


_add("predict_contrib", _contributions)


# --- preparation, looked-up and per-class statistics ------------------------------------------------


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "orders")
    return t.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"))


GAPS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders)"
_add("fill_constant", lambda s, d: P.fill_constant(_gaps(s, d), {"price": -1.0, "priority": "none"}), f"SELECT o_orderkey, coalesce(price, -1.0) AS price, coalesce(priority, 'none') AS priority FROM {GAPS}")
_add("fill_median", lambda s, d: _round(P.fill_median(_gaps(s, d), "price").select("o_orderkey", "price"), 4), f"SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM {GAPS})), 4) AS price FROM {GAPS}")
_add(
    "derived_columns",
    lambda s, d: _round(_gaps(s, d).select("o_orderkey", (F.col("price") / 1000 + 1).alias("scaled"), P.clip(F.col("price"), 50000.0, 150000.0).alias("clipped"), P.flag(F.col("price") > 100000).alias("large"))),
    f"SELECT o_orderkey, round(price / 1000 + 1, 6) AS scaled, round(CASE WHEN price IS NOT NULL THEN least(greatest(price, 50000), 150000) END, 6) AS clipped, CAST(coalesce(price > 100000, false) AS INT) AS large FROM {GAPS}",
)
_add(
    "text_parts",
    lambda s, d: _read(s, d, "part").select("p_partkey", P.first_char(F.col("p_type")).alias("first"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("number"), F.regexp_replace("p_name", "[^a-z]+", "_").alias("flat")),
    "SELECT p_partkey, substr(p_type, 1, 1) AS first, regexp_extract(p_brand, '#([0-9]+)', 1) AS number, regexp_replace(p_name, '[^a-z]+', '_', 'g') AS flat FROM part",
)
_add(
    "stratified_split",
    lambda s, d: P.stratified_split(_read(s, d, "events"), "event_type", "event_id", 0.25).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("held_out").cast("long")).alias("held")),
    "SELECT event_type, count(*) AS n, CAST(floor(0.25 * count(*)) AS BIGINT) AS held FROM events GROUP BY event_type",
)
_add(
    "ordered_class_ctr",
    lambda s, d: _round(X.ordered_class_means(_read(s, d, "events").withColumn("y", F.col("event_id") % 3), "event_type", "y", "event_id", 3).select("event_id", "ctr_0", "ctr_1", "ctr_2"), 8),
    "SELECT event_id, " + ", ".join(f"round((coalesce(sum(CASE WHEN event_id % 3 = {k} THEN 1 ELSE 0 END) OVER w, 0) + 1.0 / 3) / (count(*) OVER w + 1), 8) AS ctr_{k}" for k in range(3)) + " FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
_add(
    "ctr_lookup",
    lambda s, d: _round(X.ctr_lookup(_events(s, d), X.full_mean(_events(s, d).filter("event_id % 2 = 0 AND kind <> 'error'"), "kind", "value", F.lit(0.5)), "kind", F.lit(0.5)).select("event_id", "ctr"), 6),
    f"WITH t AS (SELECT kind, (sum(value) + 0.5) / (count(*) + 1) AS ctr FROM {EVENTS} WHERE event_id % 2 = 0 AND kind <> 'error' GROUP BY 1) SELECT event_id, round(coalesce(ctr, 0.5), 6) AS ctr FROM {EVENTS} e LEFT JOIN t ON e.kind = t.kind",
)
_add("hash_text_blake2b", lambda s, d: _read(s, d, "documents").select("doc_id", hashed_counts(F.col("text"), 16).alias("counts")))

# --- training with categories and classes ----------------------------------------------------------

#: One split without a test of significance, so that SQL can follow it.
_STUMP = TreeParams(max_depth=1, alpha=1.0)


def _categorical(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") / 100000).alias("y"))
    model = fit(rows, ["priority"], "y", BoostParams(iterations=1, learning_rate=1.0, tree=_STUMP), categorical=["priority"])
    return _round(model.transform(rows).select("row_id", "prediction"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("string").alias("mode"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("y"))
    model = fit_multiclass(rows, ["mode"], "y", 3, BoostParams(objective="multiclass", iterations=1, learning_rate=1.0, tree=_STUMP), categorical=["mode"])
    scored = model.transform(rows)
    return _round(scored.select("l_orderkey", "l_linenumber", *(F.get("prediction", F.lit(k)).alias(f"m{k}") for k in range(3))))


def _best_subset(groups: str) -> str:
    """SQL: ``side``, the keys of table ``groups`` (k, g, h) left of the best split."""
    return f"""o AS (SELECT k, g, h, row_number() OVER (ORDER BY g / (h + 1), k) AS place FROM {groups}),
    r AS (SELECT place, sum(g) OVER (ORDER BY place) AS lg, sum(h) OVER (ORDER BY place) AS lh, sum(g) OVER () AS g, sum(h) OVER () AS h FROM o),
    best AS (SELECT place FROM r WHERE place < (SELECT max(place) FROM r) ORDER BY lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) DESC, place LIMIT 1),
    side AS (SELECT k, place <= (SELECT place FROM best) AS l FROM o)"""


_add(
    "fit_categorical",
    _categorical,
    f"""WITH t AS (SELECT o_orderkey AS row_id, o_orderpriority AS k, o_totalprice / 100000 AS y FROM orders),
    c AS (SELECT k, -sum(y) AS g, CAST(count(*) AS DOUBLE) AS h FROM t GROUP BY k), {_best_subset("c")}
    SELECT row_id, round(sum(y) OVER w / (count(*) OVER w + 1), 6) AS prediction FROM t JOIN side USING (k) WINDOW w AS (PARTITION BY l)""",
)
_add(
    "multiclass_shared_tree",
    _classes,
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS k, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem),
    v AS (SELECT y FROM t GROUP BY y ORDER BY count(*) * ((SELECT count(*) FROM t) - count(*)) DESC, y LIMIT 1),
    c AS (SELECT k, count(*) / 3.0 - sum(CASE WHEN y = (SELECT y FROM v) THEN 1.0 ELSE 0.0 END) AS g, count(*) * 2 / 9.0 AS h FROM t GROUP BY k), {_best_subset("c")}
    SELECT l_orderkey, l_linenumber, {", ".join(f"round(-(count(*) OVER w / 3.0 - sum(CASE WHEN y = {k} THEN 1.0 ELSE 0.0 END) OVER w) / (count(*) OVER w * 2 / 9.0 + 1), 6) AS m{k}" for k in range(3))}
    FROM t JOIN side USING (k) WINDOW w AS (PARTITION BY l)""",
)


# --- the fitted feature pipeline ------------------------------------------------------------------

_ORDER_SPEC = PipelineSpec(numeric=("o_totalprice",), categorical=("o_orderpriority", "o_orderstatus"), combinations=(("o_orderpriority", "o_orderstatus"),), ctr=("o_orderpriority",), one_hot=3)
_ORDER_ROWS = """WITH o AS (SELECT o_orderkey, o_totalprice, coalesce(o_orderpriority, '__missing__') AS k, coalesce(o_orderstatus, '__missing__') AS m,
  CASE WHEN o_totalprice > 150000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM orders),
a AS (SELECT avg(y) AS prior, count(*) AS rows FROM o),
c AS (SELECT k, count(*) AS n, sum(y) AS s FROM o GROUP BY k)
SELECT o_orderkey, round(o_totalprice, 9) AS o_totalprice, CAST(dense_rank() OVER (ORDER BY k) - 1 AS INTEGER) AS o_orderpriority_code,
  CAST(m = 'F' AS INTEGER)::FLOAT AS "o_orderstatus_is_F", CAST(m = 'O' AS INTEGER)::FLOAT AS "o_orderstatus_is_O", CAST(m = 'P' AS INTEGER)::FLOAT AS "o_orderstatus_is_P",
  CAST(dense_rank() OVER (ORDER BY k || '||' || m) - 1 AS INTEGER) AS o_orderpriority_x_o_orderstatus_code, """


def _labelled_orders(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").withColumn("y", F.coalesce((F.col("o_totalprice") > 150000).cast("double"), F.lit(0.0)))


def _pipeline_lookup(spark: SparkSession, d: str) -> DataFrame:
    orders = _labelled_orders(spark, d)
    return _round(FeaturePipeline.fit(orders, _ORDER_SPEC, "y").transform(orders, keep=["o_orderkey"]), 9)


def _pipeline_training(spark: SparkSession, d: str) -> DataFrame:
    return _round(FeaturePipeline.fit_transform(_labelled_orders(spark, d), _ORDER_SPEC, "y", "o_orderkey", keep=["o_orderkey"])[1], 9)


_add(
    "feature_pipeline_transform",
    _pipeline_lookup,
    _ORDER_ROWS + """round((s + prior) / (n + 1), 9) AS o_orderpriority_mean, round((n + n / rows) / (rows + 1), 9) AS o_orderpriority_freq FROM o JOIN c USING (k) CROSS JOIN a""",
)
_add(
    "feature_pipeline_training",
    _pipeline_training,
    _ORDER_ROWS
    + """round((coalesce(sum(y) OVER b, 0) + prior) / (count(*) OVER b + 1), 9) AS o_orderpriority_mean,
  round((count(*) OVER b + n / rows) / row_number() OVER (ORDER BY o_orderkey), 9) AS o_orderpriority_freq
FROM o JOIN c USING (k) CROSS JOIN a WINDOW b AS (PARTITION BY k ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
