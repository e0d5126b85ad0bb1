"""Quality rules: base rules and a hashed n-gram log-likelihood ratio.

Each document gets the mean, over its hashed word unigrams and bigrams, of
``log(p_target(bucket) / p_raw(bucket))``.  The raw multinomial counts every
document of the corpus; the target multinomial counts trusted documents.  Both
are smoothed.  A document is kept when no base rule fails, its mean is at least
the threshold and its toxic score is below the toxic threshold.

A mean hides a few bad words among many good ones, so toxic documents have a
score of their own: the sum, over the distinct n-grams that mark labelled toxic
documents, of their log ratio to clean ones.  These n-grams are told apart by
their whole hash, so long texts gather no chance hits.  Both thresholds are
functions of the counts alone, so every document is decided the same way
wherever and whenever it is scored.

Every labelled row counts: a quarter of them, fixed by hash, gives the
thresholds, the others the models.

Everything is DataFrame functions: no Python runs on the executors.  At most
``broadcast_rows`` labelled ids are broadcast, and the texts of the corpus are only
scanned; more ids are joined by sorting, which moves the texts once a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import check_columns, let, stage_table, word_array



@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules.

    buckets: size of the hashed feature space, so of the broadcast ratio table.
    trusted_rows: bound of the rows labelled good that are trusted, those with the
        smallest hash of their id; None takes all.
    smoothing: added to each bucket's count.
    keep_trusted: share of the trusted sample that the threshold must keep.
    margin: further slack below that quantile, in nats a feature.
    score_bins: resolution of the histogram from which the quantile is read.
    toxic_rows: bound of the labelled rows of each class that mark toxic n-grams;
        None takes all.
    toxic_grams: size of the model, so of its broadcast table: of the n-grams that
        all these rows mark, those of the largest ratio.
    toxic_least: labelled toxic documents that an n-gram must be in.
    toxic_ratio: log ratio to clean documents that it must have.
    broadcast_rows: most rows of a table of ids or n-grams that is broadcast; a
        larger one is joined as Spark plans it, with the same result.
    clean_cost: how many toxic documents, by share of their class, must be caught
        for each clean one lost; sets the toxic threshold.
    """

    buckets: int = 1 << 16
    trusted_rows: int | None = None
    smoothing: float = 1.0
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    keep_trusted: float = 0.999
    margin: float = 0.02
    score_bins: int = 4096
    score_range: float = 4.0
    toxic_rows: int | None = None
    toxic_grams: int = 4096
    toxic_least: int = 5
    toxic_ratio: float = 3.0
    broadcast_rows: int = 1 << 20
    clean_cost: float = 10.0


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with the words of ``text``, their hashes, and those of word pairs.

    ``__h`` and ``__b`` feed both the n-gram buckets and the repeat windows; the
    last word's pair is the word with the end of the text.
    """
    rows = rows.withColumn("__words", word_array(F.col("text")))
    rows = rows.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    pairs = F.transform("__h", lambda x, i: F.xxhash64(x, F.get("__h", i + 1)))
    return rows.withColumn("__b", pairs)


def with_base(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` of :func:`hashed` with n_words and the base features of whole texts."""
    whole, words = F.coalesce(F.col("text"), F.lit("")), F.col("__words")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    packed = F.when(F.size("__h") > window, F.sort_array(window_keys(window))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("__keys", packed).withColumn("__lines", lines)
    return rows.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeat_words(window),
        }
    ).drop("__keys", "__lines")


#: Low bits of a window's key hold its position, the others its hash.
_PLACE = 32


def window_keys(window: int) -> Column:
    """A long for each window of ``window`` >= 4 words: 32 bits of hash over 32 of place."""

    def key(i: Column) -> Column:
        tail = [F.get("__h", i + d) for d in range(4, window)]
        return F.xxhash64(F.get("__b", i), F.get("__b", i + 2), *tail)

    return F.transform(F.sequence(F.lit(0), F.size("__h") - window), lambda i: F.shiftleft(key(i), _PLACE).bitwiseOR(i.cast("long")))


def repeat_words(window: int) -> Column:
    """Words in windows that occur twice or more in the text, the first included.

    ``__keys`` is sorted, so equal windows are neighbours.  Windows whose hash
    occurs again are candidates; these are sorted by their words, so only equal
    words count.  Their places are sorted again and the union of the windows is
    measured in one pass.
    """
    keys = F.col("__keys")
    mask = F.lit((1 << _PLACE) - 1)

    def same(x: Column, i: Column) -> Column:
        return F.shiftright(x.bitwiseXOR(F.coalesce(F.get(keys, i), F.bitwise_not(x))), _PLACE) == 0

    def spelt(x: Column) -> Column:
        place = x.bitwiseAND(mask).cast("int")
        return F.struct(F.array_join(F.slice(F.col("__words"), place + 1, window), " ").alias("words"), place.alias("place"))

    def repeated(found: Column) -> Column:
        equal = lambda x, i: F.coalesce(x["words"] == F.get(found, i)["words"], F.lit(False))
        return F.filter(found, lambda x, i: equal(x, i - 1) | equal(x, i + 1))

    twice = F.filter(keys, lambda x, i: same(x, i - 1) | same(x, i + 1))
    starts = F.sort_array(F.transform(let(F.sort_array(F.transform(twice, spelt)), repeated), lambda x: x["place"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(window), s - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )


def _near(small: DataFrame, rules: QualityRules) -> DataFrame:
    """``small``, to be broadcast if it has at most ``broadcast_rows`` rows."""
    return F.broadcast(small) if small.count() <= rules.broadcast_rows else small


def _first(ids: DataFrame, key: str, rows: int | None) -> DataFrame:
    """The ``rows`` ids with the smallest hash, or all."""
    return ids if rows is None else ids.orderBy(F.xxhash64(key), key).limit(rows)


def trusted_sample(labels: DataFrame, rules: QualityRules) -> DataFrame:
    """Ids of rows labelled good and not toxic: all, or the first ``trusted_rows`` by hash.

    A quarter of them (``__held``) is kept out of the target multinomial; the
    threshold is read from their scores, as the others' are biased upwards.
    """
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    first = _first(good, "doc_id", rules.trusted_rows)
    return first.select(F.col("doc_id").alias("__trusted"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).alias("__held"))


def ratio_table(documents: DataFrame, trusted: DataFrame, rules: QualityRules) -> DataFrame:
    """One row: ``ratio``, the log ratio of each bucket; ``buckets`` doubles."""
    marked = documents.select("doc_id", "text").join(_near(trusted, rules), F.col("doc_id") == F.col("__trusted"), "left")
    mask = F.lit(rules.buckets - 1)
    grams = hashed(marked).select(F.coalesce(~F.col("__held"), F.lit(False)).cast("int").alias("t"), F.explode(F.concat("__h", "__b")).alias("gram"))
    counts = grams.groupBy(F.col("gram").bitwiseAND(mask).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    # A row for each bucket, so that unseen ones are smoothed alike.
    every = documents.sparkSession.range(rules.buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "raw", "target")))
    one = every.agg(pairs.alias("p"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    a, size = F.lit(rules.smoothing), F.lit(rules.smoothing * rules.buckets)
    return one.select(F.transform("p", lambda x: F.log((x["target"] + a) / (F.col("n_target") + size)) - F.log((x["raw"] + a) / (F.col("n_raw") + size))).alias("ratio"))


def scored(documents: DataFrame, ratios: DataFrame, rules: QualityRules) -> DataFrame:
    """``documents`` with :func:`hashed` columns and ``llr``, the mean log ratio (0 without words)."""
    mask = F.lit(rules.buckets - 1)

    def total(grams: str, start: Column) -> Column:
        return F.aggregate(grams, start, lambda acc, x: acc + F.get(F.col("__ratio"), x.bitwiseAND(mask).cast("int")))

    rows = hashed(documents).withColumn("__ratio", ratios.select("ratio").scalar())
    score = F.when(F.size("__h") == 0, F.lit(0.0)).otherwise(total("__b", total("__h", F.lit(0.0))) / (2 * F.size("__h")))
    return rows.withColumn("llr", score).drop("__ratio")


def threshold(documents: DataFrame, trusted: DataFrame, ratios: DataFrame, rules: QualityRules) -> DataFrame:
    """One row: ``threshold``, the mean ratio that keeps ``keep_trusted`` of the sample.

    Read from a histogram of ``score_bins`` fixed bins, rounded down to a bin.
    Without trusted rows nothing is rejected by the ratio.
    """
    own = documents.select("doc_id", "text").join(_near(trusted.filter("__held"), rules), F.col("doc_id") == F.col("__trusted"), "left_semi")
    width = 2 * rules.score_range / rules.score_bins
    bins = scored(own, ratios, rules).filter(F.size("__words") >= rules.min_words).select(F.floor(F.greatest(F.lit(-rules.score_range), F.least(F.lit(rules.score_range), F.col("llr"))) / width).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    held = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("b"), F.sum("n").alias("all"))
    cut = F.aggregate(
        "b",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")),
        lambda acc, x: F.struct(
            (acc["seen"] + x["n"]).alias("seen"),
            F.coalesce(acc["bin"], F.when(acc["seen"] + x["n"] > (1 - rules.keep_trusted) * F.col("all"), x["bin"])).alias("bin"),
        ),
        lambda acc: acc["bin"],
    )
    return held.select(F.coalesce(cut * F.lit(width) - rules.margin, F.lit(float("-inf"))).alias("threshold"))


def toxic_sample(labels: DataFrame, rules: QualityRules) -> DataFrame:
    """Ids of toxic (``__bad`` 1) and of good, not toxic rows (0): all, or the first ``toxic_rows`` of each by hash.

    An id with both labels is toxic.  A quarter (``__held``) marks no n-grams;
    the toxic threshold is read from its scores.
    """
    bad = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    known = labels.filter(F.col("doc_id").isNotNull() & (bad | (F.col("quality") == 1)))
    ids = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(bad.cast("int")).alias("__bad"))
    if rules.toxic_rows is not None:
        parts = [_first(ids.filter(F.col("__bad") == k), "__id", rules.toxic_rows) for k in (0, 1)]
        ids = parts[0].unionByName(parts[1])
    return ids.withColumn("__held", F.pmod(F.xxhash64("__id"), F.lit(4)) == 3)


def _labelled(documents: DataFrame, sample: DataFrame, rules: QualityRules) -> DataFrame:
    return documents.select("doc_id", "text").join(_near(sample, rules), F.col("doc_id") == F.col("__id"))


def toxic_grams(documents: DataFrame, sample: DataFrame, rules: QualityRules) -> DataFrame:
    """One row: ``marks``, for each bucket null or the whole hashes and weights of its toxic n-grams.

    Only n-grams of ``toxic_least`` toxic documents are counted in the clean ones,
    which are many more.
    """
    rows = stage_table(_labelled(documents, sample.filter(~F.col("__held")), rules), "quality-toxic-rows")

    def counted(bad: int, out: str) -> DataFrame:
        own = hashed(rows.filter(F.col("__bad") == bad))
        return own.select(F.explode(F.array_distinct(F.concat("__h", "__b"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias(out))

    often = stage_table(counted(1, "bad").filter(F.col("bad") >= rules.toxic_least), "quality-toxic-often")
    clean = counted(0, "clean").join(_near(often.select("gram"), rules), "gram", "left_semi")
    counts = often.join(clean, "gram", "left").na.fill(0, ["clean"])
    sizes = rows.agg(F.sum("__bad").alias("n_bad"), F.sum(1 - F.col("__bad")).alias("n_clean"))
    ratio = F.log((F.col("bad") + 0.5) / (F.col("n_bad") + 1)) - F.log((F.col("clean") + 0.5) / (F.col("n_clean") + 1))
    # Without clean documents nothing tells a toxic n-gram from any other.
    marks = counts.join(F.broadcast(sizes)).filter("n_clean > 0").select("gram", ratio.alias("weight")).filter(F.col("weight") >= rules.toxic_ratio)
    most = marks.orderBy(F.desc("weight"), "gram").limit(rules.toxic_grams)
    own = most.groupBy(F.col("gram").bitwiseAND(F.lit(rules.buckets - 1)).cast("int").alias("bucket")).agg(F.collect_list(F.struct("gram", "weight")).alias("own"))
    every = documents.sparkSession.range(rules.buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(own), "bucket", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("bucket", "own"))).alias("p")).select(F.col("p.own").alias("marks"))


def with_toxic(rows: DataFrame, marks: DataFrame, rules: QualityRules) -> DataFrame:
    """``rows`` of :func:`hashed` with toxic_score, the weights of their distinct toxic n-grams.

    The bucket of an n-gram is looked at first; nearly all are empty.
    """
    rows = rows.withColumn("__marks", marks.select("marks").scalar())
    own = lambda x: F.get(F.col("__marks"), x.bitwiseAND(F.lit(rules.buckets - 1)).cast("int"))
    found = [F.filter(grams, lambda x: own(x).isNotNull() & F.exists(own(x), lambda y: y["gram"] == x)) for grams in ("__h", "__b")]
    weight = lambda x: F.aggregate(own(x), F.lit(0.0), lambda acc, y: acc + F.when(y["gram"] == x, y["weight"]).otherwise(0.0))
    score = F.aggregate(F.array_sort(F.array_union(*found)), F.lit(0.0), lambda acc, x: acc + weight(x))
    return rows.withColumn("toxic_score", score).drop("__marks")


def toxic_threshold(documents: DataFrame, sample: DataFrame, marks: DataFrame, rules: QualityRules) -> DataFrame:
    """One row: ``toxic_threshold``, from the held-out scores of both classes.

    The positive score at which the share of toxic documents at or above it less
    ``clean_cost`` times that of clean ones is largest; the lowest of equals.
    Null where no score gains, so that nothing is rejected.
    """
    rows = with_toxic(hashed(_labelled(documents, sample.filter("__held"), rules)), marks, rules)
    bins = rows.groupBy((F.floor(F.col("toxic_score") * 16) / 16).alias("score")).agg(F.sum("__bad").alias("bad"), F.sum(1 - F.col("__bad")).alias("clean"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    share = lambda k: F.sum(k).over(down) / F.greatest(F.lit(1), F.sum(k).over(every))
    gains = bins.select("score", (share("bad") - rules.clean_cost * share("clean")).alias("gain")).filter("score > 0 and gain > 0")
    return gains.agg(F.max_by("score", F.struct("gain", -F.col("score"))).alias("toxic_threshold"))


def quality_rules(documents: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``documents`` with n_words, the base features, llr, toxic_score, base_failed and kept.

    threshold and toxic_threshold are the bounds of llr and toxic_score.

    Null and empty texts have no words, score 0 and fail the base rules.  Every
    input row gives one output row, repeated rows and null ids included.  Columns
    of ``documents`` with the names of new ones are replaced.  Without labels
    (an empty table) only the base rules decide.
    """
    check_columns(documents, "doc_id", "text")
    check_columns(labels, "doc_id", "quality", "toxic")
    trusted = stage_table(trusted_sample(labels, rules), "quality-trusted")
    ratios = stage_table(ratio_table(documents, trusted, rules), "quality-ratios")
    cut = stage_table(threshold(documents, trusted, ratios, rules), "quality-threshold")
    sample = stage_table(toxic_sample(labels, rules), "quality-toxic-sample")
    marks = stage_table(toxic_grams(documents, sample, rules), "quality-toxic-grams")
    worst = stage_table(toxic_threshold(documents, sample, marks, rules), "quality-toxic-threshold")
    out = with_base(with_toxic(scored(documents, ratios, rules), marks, rules), rules.window)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    # Always true, but not deterministic: a filter on the verdict must not move below
    # the projections, where each use of a shared array would compute it anew.
    held = F.monotonically_increasing_id() >= 0
    kept = ~F.col("base_failed") & (F.col("llr") >= F.col("threshold")) & (F.col("toxic_score") < F.coalesce("toxic_threshold", F.lit(float("inf")))) & held
    return out.withColumn("threshold", cut.scalar()).withColumn("toxic_threshold", worst.scalar()).withColumn("base_failed", failed).withColumn("kept", kept).drop("__words", "__h", "__b")
