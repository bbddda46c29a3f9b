"""Operator 8: near-duplicate groups by SuperMinHash.

Method: SuperMinHash signatures (shingles.py) -> bands -> verification on full
shingle sets -> union-find components.

Exact copies (equal shingle sets) become one class before anything is banded,
so a text copied a million times costs one signature comparison. A band's
bucket links its members to the bucket's least class only (a star, not all
pairs). Classes whose buckets still hold several components afterwards go
through an exact positional prefix join: tokens are ordered rarest first and a
pair is looked at once, at its first common token, if the tokens left can
still reach the threshold. Links are confirmed on the full sets.

Rows are told apart by id and a hash of the text, so rows without id and rows
that share one are linked like all others.

Edge cases: null or empty text has no shingle and is linked with nothing;
fewer than five words are one shingle; repeated rows and repeated ids are rows
of their own; a component's id is its least non-null id (null if it has none);
texts are read whole, whatever their length; an empty table gives an empty
result. Other columns are not looked at and may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.components import connected_components
from starlens.llm.shingles import band_keys, set_ids, shingle_sets, super_minhash
from starlens.session import cut_lineage

THRESHOLD = 75          # per cent of the union


def _rows(bits, n):
    return pa.array([bits[k].tobytes() for k in range(n)], pa.binary())


def _signatures(batches):
    for b in batches:
        for i, n, row, h in shingle_sets(b.column(1)):
            size, ids = set_ids(n, row, h)
            keys = band_keys(super_minhash(n, row, h)).view("i8")
            bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, n), b.column(2).slice(i, n), pa.array(size, pa.int64()), _rows(ids, n),
                 bands.cast(pa.list_(pa.int64()))], ["doc_id", "text_id", "n", "set_id", "bands"])


def _full_sets(batches):
    for b in batches:
        for i, n, row, h in shingle_sets(b.column(1)):
            size, ids = set_ids(n, row, h)
            ends = size.cumsum()
            sets = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(h.view("i8")))
            yield pa.RecordBatch.from_arrays([_rows(ids, n), pa.array(size, pa.int64()), sets],
                                             ["set_id", "n", "hashes"])


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold."""
    a = sets.select(F.col("set_id").alias("u"), F.col("n").alias("nu"), F.col("hashes").alias("hu"))
    b = sets.select(F.col("set_id").alias("v"), F.col("n").alias("nv"), F.col("hashes").alias("hv"))
    both = pairs.join(b, "v").join(a, "u")
    both = both.filter(100 * F.least("nu", "nv") >= threshold * F.greatest("nu", "nv"))
    common = F.size(F.array_intersect("hu", "hv"))
    return (both.select("u", "v", "nu", "nv", common.alias("c"))
                .filter(100 * F.col("c") >= threshold * (F.col("nu") + F.col("nv") - F.col("c")))
                .select("u", "v"))


def _prefix_pairs(open_nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of classes in different components that can still reach the
    threshold: an exact positional prefix join, every pair at most once."""
    tokens = (sets.join(open_nodes, "set_id")
                  .select("set_id", "comp", "n", F.explode("hashes").alias("h")))
    often = tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    keep = F.col("n") - F.ceil(threshold * F.col("n") / 100).cast("int") + 1
    nodes = (tokens.join(often, "h", "left").groupBy("set_id", "comp", "n")
                   .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h"))).alias("t"))
                   .withColumn("t", F.transform(F.slice("t", 1, keep.cast("int")),
                                                lambda x, i: F.struct(x.df.alias("df"), x.h.alias("h"), i.alias("i"))))
                   .withColumn("t", F.filter("t", lambda x: x.df > 1))
                   .withColumn("own", F.col("t.h")))
    lists = (nodes.select("set_id", "comp", "n", "own", F.posexplode("t").alias("k", "t"))
                  .select("set_id", "comp", "n", F.col("t.h").alias("h"),
                          (F.col("n") - F.col("t.i")).alias("left"),
                          F.slice("own", F.lit(1), F.col("k")).alias("before")))
    x, y = lists.alias("x"), lists.alias("y")
    most = F.least("x.left", "y.left")
    return (x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.comp") < F.col("y.comp"))
                   & (100 * most >= threshold * (F.col("x.n") + F.col("y.n") - most))
                   & ~F.arrays_overlap("x.before", "y.before"))
             .select(F.col("x.set_id").alias("u"), F.col("y.set_id").alias("v")))


def text_id():
    return F.unhex(F.md5("text"))


def _linked(docs: DataFrame, threshold: int) -> DataFrame:
    """Per row of (doc_id, text): ``doc_id``, ``text_id``, ``n`` shingles,
    ``root`` of its group (null without shingles), ``component_id``."""
    docs = docs.select("doc_id", "text", text_id().alias("text_id"))
    rows = cut_lineage(docs.mapInArrow(
        _signatures, "doc_id long, text_id binary, n long, set_id binary, bands array<long>"))
    # A class's sets are made from one of its texts.
    classes = rows.filter("n > 0").groupBy("set_id", "n").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("text_id", "doc_id")).alias("source"))
    buckets = (rows.filter("n > 0").groupBy("set_id").agg(F.first("bands").alias("bands"))
                   .select("set_id", F.explode("bands").alias("key")))
    leads = (buckets.groupBy("key").agg(F.min("set_id").alias("lead"), F.count("*").alias("c"))
                    .filter("c > 1").drop("c"))
    members = cut_lineage(buckets.join(leads, "key"))
    needed = members.select("set_id").distinct().join(classes.select("set_id", "source"), "set_id")
    source = needed.select(F.col("source.text_id").alias("__text"), F.col("source.doc_id").alias("__doc"))
    sets = (docs.join(source, (F.col("text_id") == F.col("__text")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
                .mapInArrow(_full_sets, "set_id binary, n long, hashes array<long>")
                .join(needed.select("set_id"), "set_id", "left_semi")
                .groupBy("set_id", "n").agg(F.first("hashes").alias("hashes")))
    sets = cut_lineage(sets)

    star = members.filter("set_id != lead").select(F.col("lead").alias("u"), F.col("set_id").alias("v")).distinct()
    comps = cut_lineage(connected_components(_confirmed(star, sets, threshold)))

    at = members.join(comps.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "key", "set_id", F.coalesce("root", "set_id").alias("comp"))
    open_keys = (at.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
                   .filter("a != b").select("key"))
    open_nodes = at.join(open_keys, "key", "left_semi").select("set_id", "comp").distinct()
    more = _confirmed(_prefix_pairs(open_nodes, sets, threshold), sets, threshold)
    comps = cut_lineage(connected_components(
        more.unionAll(comps.filter("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))))

    of_class = (classes.join(comps.withColumnRenamed("node", "set_id"), "set_id", "left")
                       .select("set_id", "rep", F.coalesce("root", "set_id").alias("root")))
    least = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = of_class.join(least, "root").select("set_id", "root", "component_id")
    out = rows.select("doc_id", "text_id", "n", "set_id").join(named, "set_id", "left")
    return out.select("doc_id", "text_id", "n", "root",
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = _linked(docs, threshold)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that lead their group, one per group: the least
    id (rows without id last), then the least hash of the text; of repeated
    rows one. Rows without shingles all stay."""
    linked = _linked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id"))
    lead = linked.filter("n > 0").groupBy("root").agg(first.alias("l"))
    lead = lead.select(F.col("l.doc_id").alias("__lead"), F.col("l.text_id").alias("__lead_text"))
    rows = docs.withColumn("__text", text_id())
    kept = rows.join(lead, F.col("doc_id").eqNullSafe(F.col("__lead")) & (F.col("__text") == F.col("__lead_text")), "left_semi")
    wordless = rows.filter(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.dropDuplicates(["doc_id", "__text"]).unionByName(wordless).drop("__text")


def op8_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
