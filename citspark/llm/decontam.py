"""Benchmark decontamination: shared word n-grams between documents and test items.

A window is ``n`` consecutive normalised words of an item; an item with fewer,
but not none, is one window.  The hashes of all windows are a set inside the
plan, so the documents' texts are scanned where they lie and never move.  What
the scan finds is joined with the windows on their words, which verifies each
hit, and folded into spans.

The set is built only while the items give at most ``max_windows`` windows;
beyond that the documents' windows are joined with a table of the items' ones.
All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, stage_table

#: What separates words: ASCII other than digits and a-z, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    whole = F.coalesce(text, F.lit(""))
    low = F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id (string), gram (its words joined by one space), size, for each window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), normalised_words(F.col("text")).alias("w"))
    size = F.least(F.size("w"), F.lit(n))
    held = words.filter(F.size("w") > 0).select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    return held.select("item_id", "size", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("gram")).distinct()


def _gram_rows(grams: DataFrame) -> DataFrame:
    """gram, size, the hash of each of its words (``h``) and of the whole window."""
    rows = grams.select("gram", "size").distinct().withColumn("h", F.transform(F.split("gram", " "), lambda w: F.xxhash64(w)))
    return rows.withColumn("key", F.aggregate("h", F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)))


def _hits_of(hashes: str, size: int, firsts: list[set[int]], whole: set[int]) -> Column:
    """Hits (start, size) of one window size."""

    def hit(x: Column, i: Column) -> Column:
        # Most places fail at the first words, each a probe of a hash set.
        test = x.isin(list(firsts[0]))
        for d, words in enumerate(firsts[1:], 1):
            test = test & F.get(hashes, i + d).isin(list(words))
        key = F.aggregate(F.slice(hashes, i + 1, F.lit(size)), F.lit(42).cast("long"), lambda acc, h: F.xxhash64(acc, h))
        return (i + size <= F.size(hashes)) & test & key.isin(list(whole))

    places = F.filter(F.transform(hashes, lambda x, i: F.when(hit(x, i), i)), lambda i: i.isNotNull())
    return F.transform(places, lambda i: F.struct(i.alias("start"), F.lit(size).alias("size")))


def _scan_set(hashes: str, keys: dict[int, tuple[list[set[int]], set[int]]]) -> Column:
    """Hits of a text's word hashes against sets inside the plan."""
    found = [_hits_of(hashes, size, *sets) for size, sets in sorted(keys.items())]
    return F.concat(*found) if found else F.array().cast("array<struct<start:int,size:int>>")


def _all_windows(docs: DataFrame, size: int) -> DataFrame:
    """Every window of ``size`` words of every document."""
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "))
    return docs.filter(F.size("w") >= size).select("doc_id", "text_key", F.lit(size).alias("size"), F.posexplode(grams).alias("start", "gram"))


def find_hits(documents: DataFrame, grams: DataFrame, max_windows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(scan, hits): doc_id, text_key, n_words of each row; verified hits.

    hits: doc_id, text_key, gram, start, size.  ``text_key`` tells rows apart
    that share a doc_id.  Both are tables in the shared folder.
    """
    rows = _gram_rows(grams)
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), normalised_words(F.col("text")).alias("w"))
    docs = docs.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    few = rows.count() <= max_windows
    if few:
        keys: dict[int, tuple[list[set[int]], set[int]]] = {}
        for r in rows.select("size", "key", F.slice("h", 1, 4).alias("h")).toLocalIterator():
            firsts, whole = keys.setdefault(r.size, ([set() for _ in range(min(4, r.size))], set()))
            whole.add(r.key)
            for words, h in zip(firsts, r.h):
                words.add(h)
        found = docs.withColumn("hits", _scan_set("h", keys))
        texts = F.transform("hits", lambda x: x.withField("gram", F.array_join(F.slice("w", x["start"] + 1, x["size"]), " ")))
        scan = stage_table(found.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), texts.alias("hits")), "decontam-scan")
        hits = scan.select("doc_id", "text_key", F.explode("hits").alias("x")).select("doc_id", "text_key", "x.*")
        small = F.broadcast(rows.select("gram", "size"))
        hits = hits.join(small, ["gram", "size"], "left_semi")
    else:
        scan = stage_table(docs.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words")), "decontam-scan")
        sizes = [r.size for r in rows.select("size").distinct().collect()]  # at most n numbers
        places = [_all_windows(docs, s) for s in sizes] or [_all_windows(docs, 1).limit(0)]
        hits = reduce(DataFrame.unionByName, places)
        hits = hits.join(rows.select("gram", "size"), ["gram", "size"], "left_semi")
    hits = stage_table(hits.select("doc_id", "text_key", "gram", "start", "size").distinct(), "decontam-hits")
    return scan, hits


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 200_000) -> DataFrame:
    """One row for each row of ``documents``: what of it the benchmark holds.

    Returns doc_id, text_key, n_words, n_hit, spans (array of start, size in
    words, merged), item_ids (sorted strings) and contaminated.  Null and empty
    texts have no words and no hits; repeated rows get the same verdict each;
    null item ids are left out of item_ids but their windows count; an empty
    benchmark hits nothing.  Other columns of the tables are not read.
    """
    check_columns(documents, "doc_id", "text")
    check_columns(benchmark, "item_id", "text")
    grams = stage_table(windows(benchmark, n), "decontam-grams")
    scan, hits = find_hits(documents, grams, max_windows)
    merged = F.aggregate(
        F.array_sort("s"),
        F.struct(F.array().cast("array<struct<start:int,size:int>>").alias("done"), F.lit(0).alias("end")),
        lambda acc, x: F.when(
            (x["start"] > acc["end"]) | (F.size(acc["done"]) == 0),
            F.struct(F.concat(acc["done"], F.array(F.struct(x["start"].alias("start"), x["size"].alias("size")))).alias("done"), (x["start"] + x["size"]).alias("end")),
        ).otherwise(
            F.struct(
                F.concat(
                    F.slice(acc["done"], 1, F.size(acc["done"]) - 1),
                    F.array(F.struct(F.get(acc["done"], F.size(acc["done"]) - 1)["start"].alias("start"), (F.greatest(acc["end"], x["start"] + x["size"]) - F.get(acc["done"], F.size(acc["done"]) - 1)["start"]).alias("size"))),
                ).alias("done"),
                F.greatest(acc["end"], x["start"] + x["size"]).alias("end"),
            )
        ),
        lambda acc: acc["done"],
    )
    spans = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size")).alias("s")).select("doc_id", "text_key", merged.alias("spans"))
    owners = hits.select("doc_id", "text_key", "gram").distinct().join(grams.select("gram", "item_id"), "gram").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = spans.join(owners, _same(spans, owners), "left").drop(owners["doc_id"], owners["text_key"])
    out = scan.join(found, _same(scan, found), "left").drop(found["doc_id"], found["text_key"])
    no_spans, no_items = F.array().cast("array<struct<start:int,size:int>>"), F.array().cast("array<string>")
    out = out.select("doc_id", "text_key", "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("item_ids", no_items).alias("item_ids"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["size"])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 200_000, whole: bool = True) -> DataFrame:
    """``documents`` without contaminated rows, or (``whole=False``) without the hit spans.

    A span goes with the separators before its first word.  All columns stay.
    """
    verdict = decontaminate(documents, benchmark, n, max_windows).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"])
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    if whole:
        return documents.join(verdict, same, "left_anti")
    pieces = F.regexp_extract_all("text", F.lit(_PIECE), 0)
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    left = F.filter(pieces, lambda x, i: ~F.exists(F.col("__spans"), lambda s: (s["start"] <= i) & (i < s["start"] + s["size"])))
    cut = F.when(F.col("__id").isNull() & F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(left, ""), tail))
    return documents.join(verdict, same, "left").withColumn("text", cut).drop("__id", "__key", "__spans")


#: DuckDB's form of the digest that the query returns.
ORACLE_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p0 FROM bw WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, p0, p0 + size - 1), ' ') AS gram FROM bs),
sz AS (SELECT DISTINCT size FROM g),
ds AS (SELECT rid, size, w, unnest(range(1, len(w) - size + 2)) AS p0 FROM dw, sz WHERE len(w) >= size),
dg AS (SELECT rid, size, p0, array_to_string(list_slice(w, p0, p0 + size - 1), ' ') AS gram FROM ds),
hit AS (SELECT dg.rid, dg.p0, dg.size, g.item_id FROM dg JOIN g ON dg.gram = g.gram AND dg.size = g.size),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(p0, p0 + size)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid)
"""
