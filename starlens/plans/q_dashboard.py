"""Registered dashboard queries (APP/SRV data work): E1, E2, D1, D2, D5, F1,
F2, F7-F12, G1, G3, G4, G8, C11, C12, H2, B15."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.labels import label_name, normalize_label
from starlens.operators import aggregates as agg
from starlens.operators import filters as flt
from starlens.operators import ranking as rk
from starlens.operators.clean import select_existing
from starlens.operators.joins import attach_cluster, inner_catalog
from starlens.plans.digest import numeric_reviews_with_sentiment, scored_product_stats
from starlens.plans.q_digest import digest_sql
from starlens.plans.registry import register, rounded
from starlens.sources import fixtures as fx

DASH_SQL = """
SELECT r.product_id, r.name, r.rating AS rating_x, r.pred_label, r.logit_neg, r.logit_neu,
       r.logit_pos, r.ord, r.line,
       CASE r.pred_label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS sentiment,
       c.cluster_name, c.rating AS rating_y, c.categories
FROM reviews_num r JOIN catalog c ON r.name = c.name"""

NORM_LABEL_SQL = """CASE WHEN {c} IS NULL THEN NULL WHEN contains(lower({c}), 'pos') THEN 'positive'
  WHEN contains(lower({c}), 'neg') THEN 'negative' ELSE 'neutral' END"""


def dash_sql(body: str) -> str:
    return fx.with_views(body, "catalog", "reviews_num", extra=[("dash", DASH_SQL)])


def _dash(spark, sf):
    r = fx.reviews_num(spark, sf).withColumn("sentiment", label_name("pred_label"))
    return inner_catalog(r, fx.catalog(spark, sf))


def _joined(spark, sf):
    r = numeric_reviews_with_sentiment(fx.reviews_num(spark, sf))
    return attach_cluster(r, fx.catalog(spark, sf))


def _pct_sql(lbl: str, value: str) -> str:
    return (f"CASE WHEN count({lbl}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE "
            f"round(CAST(count_if({lbl} = '{value}') AS DOUBLE) * 100 / count({lbl}), 6) END")


@register("e1_attach_cluster", digest_sql("""
SELECT name, cluster_name, ord, line, rating, sentiment FROM joined""", upto="joined"))
def e1_attach_cluster(spark, sf):
    return _joined(spark, sf).select("name", "cluster_name", "ord", "line", "rating", "sentiment")


@register("e2_inner_catalog", dash_sql("""
SELECT name, rating_x, rating_y, cluster_name, categories, sentiment, ord, line FROM dash"""))
def e2_inner_catalog(spark, sf):
    return _dash(spark, sf).select("name", "rating_x", "rating_y", "cluster_name", "categories",
                                   "sentiment", "ord", "line")


@register("f1_value_counts", dash_sql("""
SELECT cluster_name, count(*) AS count FROM dash WHERE cluster_name IS NOT NULL GROUP BY cluster_name"""))
def f1_value_counts(spark, sf):
    return agg.value_counts(_dash(spark, sf), "cluster_name")


@register("f2_value_shares", dash_sql("""
SELECT cluster_name, sentiment, count(*) AS count,
       round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY cluster_name) * 100.0, 6) AS share
FROM dash WHERE sentiment IS NOT NULL GROUP BY cluster_name, sentiment"""))
def f2_value_shares(spark, sf):
    return rounded(agg.value_shares(_dash(spark, sf), "sentiment", by=["cluster_name"], scale=100.0))


@register("f7_overall_kpis", dash_sql(f"""
SELECT count(*) AS total, round(round(avg(CAST(rating_x AS DOUBLE)), 2), 6) AS avg_rating,
       {_pct_sql('lbl', 'positive')} AS pos_pct, {_pct_sql('lbl', 'neutral')} AS neu_pct,
       {_pct_sql('lbl', 'negative')} AS neg_pct
FROM (SELECT *, {NORM_LABEL_SQL.format(c='sentiment')} AS lbl FROM dash) t"""))
def f7_overall_kpis(spark, sf):
    return rounded(agg.overall_kpis(_dash(spark, sf), rating="rating_x"))


@register("f8_cluster_kpis", dash_sql(f"""
SELECT cluster_name, total, avg_rating, pos_pct, neu_pct, neg_pct,
       CASE WHEN pos_pct > 60 THEN 'Positive' WHEN pos_pct > 40 THEN 'Mixed' ELSE 'Negative' END AS badge
FROM (SELECT cluster_name, count(*) AS total, round(avg(CAST(rating_x AS DOUBLE)), 6) AS avg_rating,
       {_pct_sql('lbl', 'positive')} AS pos_pct, {_pct_sql('lbl', 'neutral')} AS neu_pct,
       {_pct_sql('lbl', 'negative')} AS neg_pct
  FROM (SELECT *, {NORM_LABEL_SQL.format(c='sentiment')} AS lbl FROM dash) t
  WHERE cluster_name IS NOT NULL GROUP BY cluster_name) k"""))
def f8_cluster_kpis(spark, sf):
    return rounded(agg.cluster_kpis(_dash(spark, sf), rating="rating_x"))


STATS_OUT = ("cluster_name, name, round(avg_rating, 6) AS avg_rating, review_count, "
             "round(positive_pct, 6) AS positive_pct, round(negative_pct, 6) AS negative_pct, "
             "round(neutral_pct, 6) AS neutral_pct")


@register("f9_product_stats", digest_sql(f"SELECT {STATS_OUT} FROM stats", upto="stats"))
def f9_product_stats(spark, sf):
    r = numeric_reviews_with_sentiment(fx.reviews_num(spark, sf))
    joined = attach_cluster(r, fx.catalog(spark, sf))
    return rounded(agg.product_stats(joined, count_col=None))


@register("f10_composite_score", digest_sql(
    "SELECT cluster_name, name, round(score, 6) AS score FROM scored"))
def f10_composite_score(spark, sf):
    r = numeric_reviews_with_sentiment(fx.reviews_num(spark, sf))
    return rounded(scored_product_stats(r, fx.catalog(spark, sf), count_col=None)
                   .select("cluster_name", "name", "score"))


@register("f11_cluster_sentiment", digest_sql("""
SELECT cluster_name, Negative, Neutral, Positive,
       round(CAST(Negative AS DOUBLE) / (Negative + Neutral + Positive) * 100.0, 6) AS negative_pct,
       round(CAST(Neutral AS DOUBLE) / (Negative + Neutral + Positive) * 100.0, 6) AS neutral_pct,
       round(CAST(Positive AS DOUBLE) / (Negative + Neutral + Positive) * 100.0, 6) AS positive_pct
FROM (SELECT cluster_name, CAST(count_if(sentiment = 0) AS BIGINT) AS Negative, CAST(count_if(sentiment = 1) AS BIGINT) AS Neutral,
             CAST(count_if(sentiment = 2) AS BIGINT) AS Positive
      FROM joined WHERE cluster_name <> 'Other' AND sentiment IS NOT NULL GROUP BY cluster_name) t""",
    upto="joined"))
def f11_cluster_sentiment(spark, sf):
    return rounded(agg.cluster_sentiment(_joined(spark, sf)))


@register("f12_top_rated_products", dash_sql("""
SELECT name, round(avg(CAST(rating_x AS DOUBLE)), 6) AS avg_rating, count(rating_x) AS review_count,
       min(cluster_name) AS cluster
FROM dash WHERE name IS NOT NULL GROUP BY name
ORDER BY avg(CAST(rating_x AS DOUBLE)) DESC NULLS LAST, name LIMIT 10"""))
def f12_top_rated_products(spark, sf):
    return rounded(agg.top_rated_products(_dash(spark, sf), rating="rating_x"))


@register("g1_rank_products", digest_sql("""
SELECT cluster_name, name, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY cluster_name ORDER BY score DESC NULLS LAST, name) AS INTEGER) AS rank
FROM scored"""))
def g1_rank_products(spark, sf):
    r = numeric_reviews_with_sentiment(fx.reviews_num(spark, sf))
    stats = scored_product_stats(r, fx.catalog(spark, sf), count_col=None)
    return rounded(rk.rank_products(stats).select("cluster_name", "name", "score", "rank"))


@register("g3_top_by_volume", dash_sql("""
SELECT * FROM (SELECT cluster_name, name, count(*) AS review_count,
       CAST(row_number() OVER (PARTITION BY cluster_name ORDER BY count(*) DESC, name) AS INTEGER) AS rank
  FROM dash WHERE name IS NOT NULL AND cluster_name IS NOT NULL GROUP BY cluster_name, name) t
WHERE rank <= 3"""))
def g3_top_by_volume(spark, sf):
    return rk.top_by_volume(_dash(spark, sf))


@register("g4_worst_by_rating", dash_sql("""
SELECT c.cluster_name, coalesce(w.name, 'N/A') AS worst_name, round(w.mean_rating, 6) AS worst_mean_rating
FROM (SELECT DISTINCT cluster_name FROM dash WHERE cluster_name IS NOT NULL) c
LEFT JOIN (SELECT cluster_name, name, mean_rating FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY mean_rating, name) AS rn FROM (
      SELECT cluster_name, name, avg(CAST(rating_x AS DOUBLE)) AS mean_rating, count(rating_x) AS n
      FROM dash WHERE name IS NOT NULL AND cluster_name IS NOT NULL GROUP BY cluster_name, name) p
    WHERE n >= 3) q WHERE rn = 1) w ON c.cluster_name = w.cluster_name"""))
def g4_worst_by_rating(spark, sf):
    return rounded(rk.worst_by_rating(_dash(spark, sf), rating="rating_x"))


@register("g8_rank_marker", digest_sql("""
SELECT cluster_name, name, CAST(rank AS INTEGER) AS rank,
       CASE WHEN rank <= 3 THEN 'TOP' WHEN rank = 4 OR rank = n_products THEN 'BAD' END AS marker
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY score DESC NULLS LAST, name) AS rank,
             count(*) OVER (PARTITION BY cluster_name) AS n_products FROM scored) t
WHERE rank <= 3 OR rank = n_products"""))
def g8_rank_marker(spark, sf):
    r = numeric_reviews_with_sentiment(fx.reviews_num(spark, sf))
    stats = scored_product_stats(r, fx.catalog(spark, sf), count_col=None)
    tw = rk.top_and_worst(stats)
    return tw.select("cluster_name", "name", "rank", rk.rank_marker().alias("marker"))


@register("d1_filter_reviews", dash_sql("""
SELECT name, cluster_name, rating_x, sentiment, ord, line FROM dash
WHERE cluster_name = 'PROMO' AND sentiment = 'Positive'"""))
def d1_filter_reviews(spark, sf):
    out = flt.filter_reviews(_dash(spark, sf), cluster="PROMO", sentiment="Positive")
    return out.select("name", "cluster_name", "rating_x", "sentiment", "ord", "line")


@register("b15_select_existing", dash_sql("""
SELECT name, cluster_name, rating_x AS rating, sentiment, ord, line FROM dash
"""))
def b15_select_existing(spark, sf):
    df = _dash(spark, sf)
    return select_existing(df, ["name", "cluster_name", None, "rating_x", "sentiment",
                                "prob_Negative", "ord", "line"],
                           rename={"rating_x": "rating"})


@register("b15_select_existing_first", dash_sql("""
SELECT name, rating_x AS rating, ord, line FROM dash
ORDER BY name, ord, line, rating LIMIT 500"""))
def b15_select_existing_first(spark, sf):
    return select_existing(_dash(spark, sf), ["name", "rating_x", "prob_Negative", "ord", "line"],
                           rename={"rating_x": "rating"}, cap=500, order_by=["name", "ord", "line", "rating"])


@register("d2_facet_values", dash_sql("""
SELECT DISTINCT cluster_name FROM dash WHERE cluster_name IS NOT NULL"""))
def d2_facet_values(spark, sf):
    return flt.facet_values(_dash(spark, sf), "cluster_name")


@register("h2_distinct", dash_sql("""
SELECT DISTINCT cluster_name, sentiment FROM dash"""))
def h2_distinct(spark, sf):
    return _dash(spark, sf).select("cluster_name", "sentiment").distinct()


@register("d5_select_cluster", digest_sql("""
SELECT name, cluster_name, ord, line FROM joined WHERE cluster_name <> 'Other'""", upto="joined"))
def d5_select_cluster(spark, sf):
    return flt.select_cluster(_joined(spark, sf)).select("name", "cluster_name", "ord", "line")


@register("c12_normalize_label", dash_sql(f"""
SELECT lbl, count(*) AS count FROM (SELECT {NORM_LABEL_SQL.format(c='sentiment')} AS lbl FROM dash) t
GROUP BY lbl"""))
def c12_normalize_label(spark, sf):
    df = _dash(spark, sf).select(normalize_label("sentiment").alias("lbl"))
    return df.groupBy("lbl").agg(F.count("*").alias("count"))
