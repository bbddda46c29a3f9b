"""Registered source, sink, schema and lookup queries: A1-A3, A5, A6, B1-B3,
E3, E4. The whole fixture tables are written to a fresh folder under the
shared checkpoint dir and read again through the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.operators import clean as cl
from starlens.operators.audit import class_weights
from starlens.operators.joins import attach_stats, lookup_join
from starlens.plans.digest import scored_product_stats
from starlens.plans.q_audit import audit_sql
from starlens.plans.q_context import ARTICLE_STAGES, _articles
from starlens.plans.q_digest import _reviews, digest_sql
from starlens.plans.registry import register, rounded
from starlens.sources import fixtures as fx
from starlens.sources import io
from starlens.streaming.stream import scratch_dir


@register("a1_read_reviews", fx.with_views("""
SELECT review_id, review_rating, nullif(review_title, '') AS review_title, nullif(review_text, '') AS review_text,
       name, cluster_name FROM reviews_raw""", "reviews_raw"))
def a1_read_reviews(spark, sf):
    """Titles and texts as they are, line breaks and quotes included."""
    raw = fx.reviews_raw(spark, sf)
    path = scratch_dir(spark, "a1")
    io.write_table(raw, path, fmt="csv")
    return io.read_reviews(spark, path, raw.schema, fmt="csv")


@register("a2_read_catalog", fx.with_views(
    "SELECT concat(name, chr(10), 'pack') AS name, cluster_name, rating, categories FROM catalog", "catalog"))
def a2_read_catalog(spark, sf):
    cat = fx.catalog(spark, sf).withColumn("name", F.concat("name", F.lit("\r\npack")))
    path = scratch_dir(spark, "a2")
    io.write_table(cat, path, fmt="csv")
    return io.read_catalog(spark, path, cat.schema)


@register("a3_select_input", fx.with_views("SELECT name, cluster_name, rating, categories FROM catalog", "catalog"))
def a3_select_input(spark, sf):
    base = scratch_dir(spark, "a3")
    cat = fx.catalog(spark, sf)
    io.write_table(fx.reviews_num(spark, sf), f"{base}/reviews_may.parquet")
    io.write_table(cat, f"{base}/catalog_may.parquet")
    io.write_table(cat.limit(0), f"{base}/catalog_june.csv", fmt="csv")
    # The pattern leaves out the CSV folder, the token the reviews.
    return io.read_reviews(spark, io.select_input(io.find_inputs(spark, f"{base}/*.parquet"), "catalog"), cat.schema)


@register("a5_write_table", fx.with_views("SELECT product_id, name, rating, pred_label, ord, line FROM reviews_num", "reviews_num"))
def a5_write_table(spark, sf):
    df = fx.reviews_num(spark, sf).select("product_id", "name", "rating", "pred_label", "ord", "line")
    path = scratch_dir(spark, "a5")
    io.write_table(df, path, partition_by=["rating"])
    return io.read_reviews(spark, path, df.schema, fmt="parquet")


@register("a6_write_articles", audit_sql("SELECT cluster_name, article FROM articles", more=ARTICLE_STAGES))
def a6_write_articles(spark, sf):
    path = scratch_dir(spark, "a6")
    io.write_articles(_articles(spark, sf), path)
    return io.read_reviews(spark, path, "cluster_name string, article string", fmt="json")


def _renamed(spark, sf):
    names = {"review_rating": " reviews.rating", "review_text": "reviews.text ", "review_title": " title "}
    raw = fx.reviews_raw(spark, sf)
    return raw.toDF(*[names.get(c, c) for c in raw.columns])


@register("b1_resolve_column", fx.with_views(
    "SELECT review_id, review_rating AS rating, review_text AS text, review_title AS title, name AS product FROM reviews_raw",
    "reviews_raw"))
def b1_resolve_column(spark, sf):
    df = cl.trim_column_names(_renamed(spark, sf))
    roles = {"rating": cl.RATING_CANDIDATES, "text": cl.TEXT_CANDIDATES, "title": cl.TITLE_CANDIDATES,
             "product": cl.PRODUCT_CANDIDATES}
    return df.select("review_id", *[F.col(cl.q(cl.resolve_column(df, c))).alias(r) for r, c in roles.items()])


@register("b2_require_columns", fx.with_views(
    "SELECT review_id, review_rating, 'rating' AS missing FROM reviews_raw", "reviews_raw"))
def b2_require_columns(spark, sf):
    """Rows pass with their columns found; without them the error names the role."""
    raw = fx.reviews_raw(spark, sf)
    cl.require_columns(rating=cl.resolve_column(raw, cl.RATING_CANDIDATES), text=cl.resolve_column(raw, cl.TEXT_CANDIDATES))
    bare = raw.drop("review_rating")
    try:
        cl.require_columns(rating=cl.resolve_column(bare, cl.RATING_CANDIDATES), text="review_text")
        missing = ""
    except ValueError as e:
        missing = str(e).rsplit(": ", 1)[-1]
    return raw.select("review_id", "review_rating", F.lit(missing).alias("missing"))


@register("b3_trim_column_names", fx.with_views("""
SELECT review_id, review_rating AS "reviews.rating", review_title AS title, review_text AS "reviews.text", name, cluster_name
FROM reviews_raw""", "reviews_raw"))
def b3_trim_column_names(spark, sf):
    return cl.trim_column_names(_renamed(spark, sf))


@register("e3_lookup_join", audit_sql("""
SELECT c.review_id, c.star_label, round(w.class_weight, 6) AS class_weight FROM clean c JOIN (
  SELECT star_label, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS class_weight
  FROM (SELECT star_label, count(*) AS n FROM clean GROUP BY star_label) k) w ON c.star_label = w.star_label""", upto="clean"))
def e3_lookup_join(spark, sf):
    df = cl.clean_reviews(fx.reviews_raw(spark, sf)).select("review_id", "star_label")
    return rounded(lookup_join(df, class_weights(df).select("star_label", "class_weight"), "star_label"))


@register("e4_attach_stats", digest_sql("""
SELECT c.cluster_name, c.name, round(s.avg_rating, 6) AS avg_rating, s.review_count, round(s.score, 6) AS score
FROM catalog c LEFT JOIN scored s ON c.cluster_name = s.cluster_name AND c.name = s.name"""))
def e4_attach_stats(spark, sf):
    cat = fx.catalog(spark, sf)
    stats = scored_product_stats(_reviews(spark, sf), cat, count_col=None)
    out = attach_stats(cat.select("cluster_name", "name"), stats.select("cluster_name", "name", "avg_rating", "review_count", "score"))
    return rounded(out)
