"""Operator 2: benchmark decontamination (DataFrame only).

A hash set of the benchmark's word windows is broadcast; every document's
windows are scanned against it in one pass without a shuffle, and a hash hit
counts only if the words themselves are equal. The set's size is checked: a
benchmark of more than ``SET_ROWS`` distinct windows is broadcast in slices of
at most about that many, one pass each, with the same result.

Only hits are shuffled, keyed by (id, hash of the text): equal rows have equal
results, so repeated rows need no row number.

Edge cases: null or wordless texts have no words and are clean; an item of
fewer than 13 words is one window; items without words or id hit nothing;
an empty table on either side gives no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SET_ROWS = 1_000_000
END_WORDS = 20_000         # most first or last words for which windows are looked at by their ends first
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """Words of a text with A-Z lower-cased (other letters stay)."""
    text = F.coalesce(text, F.lit(""))
    low = (F.when(F.octet_length(text) == F.length(text), F.lower(text))
           .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))
    return F.filter(F.split(low, SEPARATORS, -1), lambda w: w != "")


def _hashes(w):
    return F.transform(w, lambda x: F.xxhash64(x))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, h, gram, items): the distinct windows and the items that hold them."""
    items = (benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w"))
                      .filter("size(w) > 0 and item is not null")
                      .withColumn("size", F.least(F.lit(WINDOW), F.size("w"))))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1))
    return (items.select("item", "w", "size", at.alias("i"))
                 .select("item", "size", F.slice("w", F.col("i"), F.col("size")).alias("gram"))
                 .groupBy("size", "gram").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
                 .withColumn("h", F.xxhash64(_hashes(F.col("gram")))))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, n_hit, items) of documents with a hit; ``key`` is xxhash64 of the text."""
    grams = benchmark_windows(benchmark)
    shape = grams.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    ends = grams.select(F.xxhash64(F.get("gram", F.lit(0))).alias("a"),
                        F.xxhash64(F.element_at("gram", -1)).alias("b"))
    ends = ends.agg(F.count_distinct("a").alias("n"), F.count_distinct("b").alias("m")).first(), ends
    few = 0 < max(ends[0].n, ends[0].m) <= END_WORDS
    first, last = [[r[0] for r in ends[1].select(c).distinct().collect()] if few else [] for c in "ab"]
    slices = max(1, -(-shape.n // SET_ROWS))
    base = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    base = base.withColumn("wh", _hashes(F.col("w")))

    def windows(size):
        at = F.sequence(F.lit(1), F.size("wh") - size + 1)
        if few:
            # A hit begins and ends with words that some benchmark window begins and ends with.
            at = F.filter(at, lambda i: F.get("wh", i - 1).isin(first) & F.get("wh", i + (size - 2)).isin(last))
        return F.when(F.size("wh") >= size, F.transform(at, lambda i: F.struct(
            i.alias("i"), F.lit(size).alias("size"), F.xxhash64(F.slice("wh", i, size)).alias("h")))).otherwise(
            F.array().cast("array<struct<i:int,size:int,h:bigint>>"))

    found = None
    every = F.concat(*[windows(s) for s in shape.sizes or [WINDOW]])
    scan = base.select("doc_id", "key", "w", F.explode(every).alias("x")).select(
        "doc_id", "key", "w", "x.i", "x.size", "x.h")
    for k in range(slices):
        part = grams if slices == 1 else grams.filter(F.pmod("h", F.lit(slices)) == k)
        some = (scan.join(F.broadcast(part), ["size", "h"])
                    .filter(F.slice("w", F.col("i"), F.col("size")) == F.col("gram"))
                    .select("doc_id", "key", "i", "size", "items"))
        found = some if found is None else found.unionAll(some)
    per = found.groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.struct("i", "size"))).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def cover(acc, x):
        stop = x.i + x.size
        return F.struct(F.greatest(acc.end, stop).alias("end"),
                        (acc.n + F.greatest(F.lit(0), stop - F.greatest(acc.end, x.i))).alias("n"))

    return per.select("doc_id", "key", F.aggregate("at", start, cover).n.cast("long").alias("n_hit"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, items (sorted), contaminated."""
    found = hits(docs, benchmark).withColumnsRenamed({"doc_id": "__d", "key": "__k"})
    base = docs.select("doc_id", F.xxhash64("text").alias("key"),
                       F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "key", "n_words", n_hit.alias("n_hit"),
                      F.sort_array(F.coalesce("items", F.array().cast("array<string>"))).alias("items"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = (contamination(docs, benchmark).filter("contaminated")
           .select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d"))
                     & (F.xxhash64("text") == F.col("__k")), "left_anti")


def op2_decontaminate(spark, sf_dir):
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_TOKENS = (f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', "
           f"'{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS size,
             array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS gram
      FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS t(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM g),
x AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
      FROM d, s, unnest(generate_series(1, len(w) - size + 1)) AS t(i) WHERE len(w) >= size),
m AS (SELECT x.doc_id, x.i, x.size, g.item_id FROM x JOIN g ON x.gram = g.gram AND x.size = g.size),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(generate_series(i, i + size - 1)) AS t(p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
