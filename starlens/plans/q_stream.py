"""Registered streaming queries (L1-L4). Each writes the fixture rows as
files into a fresh folder under the shared checkpoint dir, runs the stream
with ``availableNow`` and returns the sink as a DataFrame; the oracle is the
equivalent batch SQL (stream = batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.labels import label_name
from starlens.operators.audit import add_sample_weight
from starlens.operators.joins import lookup_join
from starlens.plans.audit import conflicted_reviews
from starlens.plans.digest import numeric_reviews_with_sentiment
from starlens.plans.q_audit import audit_sql
from starlens.plans.q_dashboard import NORM_LABEL_SQL, _pct_sql
from starlens.plans.q_digest import digest_sql
from starlens.plans.registry import register, rounded
from starlens.sources import fixtures as fx
from starlens.streaming import stream as st


def _files(df, spark, name, parts=4, batches=4):
    """(folder, files a trigger): the rows as files of a stream of about
    ``batches`` batches. A table of ``parts`` partitions or more is written as
    it is split, so the files grow in number and not in size and no task reads
    more than its own split; a smaller one is dealt out."""
    path = st.scratch_dir(spark, name)
    n = df.rdd.getNumPartitions()
    (df if n >= parts else df.repartition(parts)).write.mode("overwrite").parquet(path + "/in")
    return path, -(-max(n, parts) // batches)


@register("l1_score_stream", audit_sql("""
SELECT review_id, name, cluster_name, rating, lower(lex_label_name) AS sentiment,
       round(lex_compound, 6) AS lex_compound FROM audited"""))
def l1_score_stream(spark, sf):
    raw = fx.reviews_raw(spark, sf)
    path, files = _files(raw, spark, "l1")
    src = st.stream_source(spark, path + "/in", raw.schema, max_files_per_trigger=files)
    lex = fx.lexicon(spark)

    def score(batch):
        a = conflicted_reviews(batch, lex)
        return a.select("review_id", "name", "cluster_name", "rating",
                        F.lower("lex_label_name").alias("sentiment"), "lex_compound")

    q = st.score_stream(src, score, path + "/out", path + "/ckpt")
    q.awaitTermination()
    return rounded(spark.read.parquet(path + "/out").drop("batch"))


@register("l1_running_weights", audit_sql("""
SELECT review_id, star_label, round(class_weight, 6) AS class_weight, round(sample_weight, 6) AS sample_weight
FROM audited"""))
def l1_running_weights(spark, sf):
    """Weights of a stream: from the class counts of all its batches, as in the batch plan."""
    raw = fx.reviews_raw(spark, sf)
    path, files = _files(raw, spark, "l1w")
    src = st.stream_source(spark, path + "/in", raw.schema, max_files_per_trigger=files)
    lex = fx.lexicon(spark)

    def score(batch):
        return conflicted_reviews(batch, lex).select("review_id", "star_label", "quality_weight")

    st.score_stream(src, score, path + "/out", path + "/ckpt", label="star_label",
                    counts_path=path + "/counts").awaitTermination()
    rows = spark.read.parquet(path + "/out").drop("batch")
    weights = st.running_class_weights(spark, path + "/counts").select("star_label", "class_weight")
    return rounded(add_sample_weight(lookup_join(rows, weights, "star_label"))
                   .select("review_id", "star_label", "class_weight", "sample_weight"))


@register("l2_streaming_kpis", digest_sql(f"""
SELECT cluster_name, count(*) AS total, round(avg(CAST(rating AS DOUBLE)), 6) AS avg_rating,
       {_pct_sql('lbl', 'positive')} AS pos_pct, {_pct_sql('lbl', 'neutral')} AS neu_pct,
       {_pct_sql('lbl', 'negative')} AS neg_pct
FROM (SELECT *, {NORM_LABEL_SQL.format(c='lbl0')} AS lbl FROM (
        SELECT *, CASE sentiment WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS lbl0
        FROM joined) j) t
GROUP BY cluster_name""", upto="joined"))
def l2_streaming_kpis(spark, sf):
    r = numeric_reviews_with_sentiment(fx.reviews_num(spark, sf))
    path, files = _files(r, spark, "l2")
    src = st.stream_source(spark, path + "/in", r.schema, max_files_per_trigger=files)
    enriched = st.enrich_stream(src, fx.catalog(spark, sf)).withColumn(
        "sentiment", label_name("sentiment"))
    state = st.run_updates(st.streaming_kpis(enriched), ["cluster_name"], path + "/ckpt", path + "/out")
    return rounded(st.kpi_view(state))


@register("l3_enrich_stream", digest_sql("""
SELECT name, cluster_name, ord, line FROM joined""", upto="joined"))
def l3_enrich_stream(spark, sf):
    r = fx.reviews_num(spark, sf)
    path, files = _files(r, spark, "l3", batches=2)
    src = st.stream_source(spark, path + "/in", r.schema, max_files_per_trigger=files)
    q = st.append_stream(st.enrich_stream(src, fx.catalog(spark, sf))
                           .select("name", "cluster_name", "ord", "line"),
                         path + "/out", path + "/ckpt")
    q.awaitTermination()
    return spark.read.parquet(path + "/out")


@register("l4_stream_ingest", fx.with_views("SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents"))
def l4_stream_ingest(spark, sf):
    d = fx.table(spark, sf, "documents")
    path, files = _files(d, spark, "l4", parts=8)
    src = st.stream_source(spark, path + "/in", d.schema, max_files_per_trigger=files)
    agg = src.agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"))
    return st.run_updates(agg, [], path + "/ckpt", path + "/out")


@register("l4_bounded_ingest", fx.with_views(
    "SELECT least(count(*), 333) AS n_rows, least(count(DISTINCT doc_id), 333) AS n_ids FROM documents"))
def l4_bounded_ingest(spark, sf):
    """Row budget of an ingest: 333 rows, whatever the size of the batches."""
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", "source")
    path = st.scratch_dir(spark, "l4b")
    d.repartition(8).write.mode("overwrite").parquet(path + "/in")
    src = st.stream_source(spark, path + "/in", d.schema, max_bytes_per_trigger=1)
    st.ingest_bounded(src, path + "/out", path + "/ckpt", 333, "doc_id").awaitTermination()
    return spark.read.parquet(path + "/out").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"))
