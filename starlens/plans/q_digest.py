"""Registered digest / product-ranking queries (E1, F9-F11, G1-G4, ...)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.operators import aggregates as agg
from starlens.operators import ranking as rk
from starlens.operators.joins import attach_cluster
from starlens.plans.digest import (numeric_reviews_with_sentiment, scored_product_stats,
                                   top_and_worst_products)
from starlens.plans.registry import register, rounded
from starlens.sources import fixtures as fx

# Shared SQL pieces -----------------------------------------------------------
JOINED_SQL = """
SELECT r.*, r.pred_label AS sentiment, coalesce(c.cluster_name, 'Other') AS cluster_name
FROM reviews_num r LEFT JOIN (SELECT name AS k, cluster_name FROM catalog) c
  ON r.name IS NOT DISTINCT FROM c.k"""

STATS_SQL = """
SELECT cluster_name, name, avg(CAST(rating AS DOUBLE)) AS avg_rating, count(*) AS review_count,
       avg(CASE WHEN sentiment = 2 THEN 1 ELSE 0 END) AS positive_pct,
       avg(CASE WHEN sentiment = 0 THEN 1 ELSE 0 END) AS negative_pct,
       avg(CASE WHEN sentiment = 1 THEN 1 ELSE 0 END) AS neutral_pct
FROM joined WHERE cluster_name <> 'Other' AND name IS NOT NULL
GROUP BY cluster_name, name HAVING count(*) >= 3"""

SCORED_SQL = """
SELECT *, avg_rating * CAST(0.5 AS DOUBLE) + positive_pct * CAST(5.0 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS score
FROM stats"""


def digest_sql(body: str, upto: str = "scored") -> str:
    extra = [("joined", JOINED_SQL)]
    if upto in ("stats", "scored"):
        extra.append(("stats", STATS_SQL))
    if upto == "scored":
        extra.append(("scored", SCORED_SQL))
    return fx.with_views(body, "catalog", "reviews_num", extra=extra)


def _reviews(spark, sf):
    return numeric_reviews_with_sentiment(fx.reviews_num(spark, sf))


def _joined(spark, sf):
    return attach_cluster(_reviews(spark, sf), fx.catalog(spark, sf))


def _scored(spark, sf):
    return scored_product_stats(_reviews(spark, sf), fx.catalog(spark, sf), count_col=None)


STATS_COLS = ("avg_rating, review_count, positive_pct, negative_pct, neutral_pct, score")


@register("g2_top_and_worst", digest_sql(f"""
SELECT cluster_name, name, CAST(rank AS INTEGER) AS rank, n_products, rank <= 3 AS is_top,
       rank = n_products AS is_worst,
       round(avg_rating, 6) AS avg_rating, review_count, round(positive_pct, 6) AS positive_pct,
       round(negative_pct, 6) AS negative_pct, round(neutral_pct, 6) AS neutral_pct,
       round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY score DESC NULLS LAST, name) AS rank,
             count(*) OVER (PARTITION BY cluster_name) AS n_products FROM scored) t
WHERE rank <= 3 OR rank = n_products"""))
def g2_top_and_worst(spark, sf):
    """Flagship: top 3 and worst product per cluster."""
    out = top_and_worst_products(_reviews(spark, sf), fx.catalog(spark, sf), count_col=None)
    return rounded(out.select("cluster_name", "name", "rank", "n_products", "is_top", "is_worst",
                              "avg_rating", "review_count", "positive_pct", "negative_pct",
                              "neutral_pct", "score"))
