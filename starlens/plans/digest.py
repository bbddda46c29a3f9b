"""Digest plan (NB2): catalogue join -> product stats -> top/worst -> context.

One DAG: the catalogue join is broadcast when proven small; product stats
are a partial/final aggregate on (cluster, name); ranking prunes to k rows
per cluster before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.operators.aggregates import composite_score, product_stats
from starlens.operators.joins import attach_cluster
from starlens.operators.ranking import top_and_worst


def scored_product_stats(reviews: DataFrame, catalog: DataFrame, sentiment: str = "sentiment",
                         count_col: str | None = "text", min_reviews: int = 3) -> DataFrame:
    """E1 -> F9 -> F10: per-product stats with the composite score."""
    joined = attach_cluster(reviews, catalog)
    stats = product_stats(joined, sentiment=sentiment, count_col=count_col,
                          min_reviews=min_reviews)
    return stats.withColumn("score", composite_score())


def top_and_worst_products(reviews: DataFrame, catalog: DataFrame, k: int = 3,
                           sentiment: str = "sentiment", count_col: str | None = "text",
                           min_reviews: int = 3) -> DataFrame:
    """Slice 1: top k and worst product per cluster (E1 -> F9 -> F10 -> G1/G2)."""
    stats = scored_product_stats(reviews, catalog, sentiment, count_col, min_reviews)
    return top_and_worst(stats, k=k)


def numeric_reviews_with_sentiment(reviews_num: DataFrame) -> DataFrame:
    """The numeric fixture with the reference's ``sentiment`` column."""
    return reviews_num.withColumn("sentiment", F.col("pred_label"))
