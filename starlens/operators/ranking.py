"""Ranking, top-k and per-group selection.

Per-group top-k is ``row_number() <= k`` over a window; Catalyst turns the
filter into a ``WindowGroupLimit`` that keeps only k rows per group *before*
the shuffle, so a group holding a third of all rows never reaches one task
whole. "Last row of a group" is a ``max_by`` aggregate (partial/final), not a
second descending window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions.text import flatten_lines
from starlens.operators.filters import filter_computed
from starlens.session import cut_lineage


def _score_order(score: str, name: str):
    return [F.col(score).desc_nulls_last(), F.col(name).asc()]


def rank_products(stats: DataFrame, cluster: str = "cluster_name", name: str = "name",
                  score: str = "score", k: int | None = None) -> DataFrame:
    """G1: rank within cluster by score desc (ties: name asc).

    With ``k`` the window is pruned to the top k per cluster before the
    shuffle (``WindowGroupLimit``). The full ranking is a running count in
    that order computed by the distributed ``prefix_sums`` (range partitioned),
    so one big cluster is not sorted in one task.
    """
    if k:
        w = Window.partitionBy(cluster).orderBy(*_score_order(score, name))
        return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    from starlens.operators.metrics import prefix_sums
    ranked = prefix_sums(stats.withColumn("__one", F.lit(1)), [cluster],
                         _score_order(score, name), ["__one"])
    return (ranked.withColumn("rank", F.col("cum___one").cast("int"))
                  .drop("__one", "cum___one", "total___one"))


def top_and_worst(stats: DataFrame, k: int = 3, cluster: str = "cluster_name",
                  name: str = "name", score: str = "score") -> DataFrame:
    """Top k by score plus the last row (worst) per cluster.

    Rows: the min(k, n) top products, plus the worst when n > k. A product
    can be top and worst at once when a cluster has <= k products. Carries
    ``rank``, ``n_products``, ``is_top``, ``is_worst``. The product rows are
    pinned, so reviews are scanned and joined once for all branches.
    """
    stats = cut_lineage(stats)
    cols = [c for c in stats.columns if c != cluster]
    # Worst = last in (score desc nulls last, name asc) order = max of
    # (score is null, -score, name); partial aggregate per cluster.
    last_key = F.struct(F.col(score).isNull(), -F.col(score), F.col(name))
    per_cluster = (stats.groupBy(cluster)
                        .agg(F.count("*").alias("n_products"),
                             F.max_by(F.struct(*cols), last_key).alias("w")))
    top = rank_products(stats, cluster, name, score, k=k)
    top = (top.join(per_cluster.select(cluster, "n_products"), cluster)
              .withColumn("is_top", F.lit(True))
              .withColumn("is_worst", F.col("rank") == F.col("n_products")))
    worst = (per_cluster.filter(F.col("n_products") > k)
                        .select(cluster, "w.*", F.col("n_products").cast("int").alias("rank"),
                                "n_products", F.lit(False).alias("is_top"),
                                F.lit(True).alias("is_worst")))
    return top.unionByName(worst)


def top_by_volume(df: DataFrame, k: int = 3, cluster: str = "cluster_name",
                  name: str = "name") -> DataFrame:
    """The k most-reviewed products per cluster (ties by name)."""
    counts = (df.filter(F.col(name).isNotNull() & F.col(cluster).isNotNull())
                .groupBy(cluster, name).agg(F.count("*").alias("review_count")))
    w = Window.partitionBy(cluster).orderBy(F.desc("review_count"), F.asc(name))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def worst_by_rating(df: DataFrame, min_reviews: int = 3, cluster: str = "cluster_name",
                    name: str = "name", rating: str = "rating", missing: str = "N/A") -> DataFrame:
    """Per cluster, the product with the lowest mean rating among those
    with >= min_reviews ratings (first by name on ties); ``missing`` if none."""
    per_product = (df.filter(F.col(name).isNotNull() & F.col(cluster).isNotNull())
                     .groupBy(cluster, name)
                     .agg(F.avg(F.col(rating).cast("double")).alias("mean_rating"),
                          F.count(rating).alias("n_ratings"))
                     .filter(F.col("n_ratings") >= min_reviews))
    worst = (per_product.groupBy(cluster)
                        .agg(F.min_by(F.struct(name, "mean_rating"),
                                      F.struct("mean_rating", name)).alias("w")))
    clusters = df.filter(F.col(cluster).isNotNull()).select(cluster).distinct()
    return (clusters.join(worst, cluster, "left")
                    .select(cluster, F.coalesce(F.col("w." + name), F.lit(missing)).alias("worst_name"),
                            F.col("w.mean_rating").alias("worst_mean_rating")))


def longest_reviews(df: DataFrame, n: int = 8, sentiment_value: int | None = None,
                    by: tuple[str, ...] = ("name",), text: str = "text",
                    sentiment: str = "sentiment", key: str = "review_id",
                    sep: str = " | ") -> DataFrame:
    """The n longest texts per product (optionally of one sentiment),
    line breaks flattened, joined by `` | `` longest first (ties: key)."""
    src = df.filter(F.col(text).isNotNull())
    for c in by:
        src = src.filter(F.col(c).isNotNull())
    if sentiment_value is not None:
        src = src.filter(F.col(sentiment) == sentiment_value)
    w = Window.partitionBy(*by).orderBy(F.length(text).desc(), F.col(key).asc())
    top = src.select(*by, key, text, F.row_number().over(w).alias("rn")).filter(F.col("rn") <= n)
    picked = F.array_sort(F.collect_list(F.struct("rn", flatten_lines(F.col(text)).alias("t"))))
    return (top.groupBy(*by)
               .agg(F.array_join(F.transform(picked, lambda s: s["t"]), sep).alias("reviews"),
                    F.count("*").alias("n_reviews")))


def hard_errors(df: DataFrame, n: int = 30, key: str = "review_id",
                columns: list[str] | None = None) -> DataFrame:
    """Wrong predictions, most confident first (global top-n)."""
    columns = columns or ["rating", "true_label_name", "pred_label_name", "pred_confidence",
                          "lex_compound", "lex_strict_label_name", "conflict_type",
                          "review_title", "review_body"]
    return (filter_computed(df, ~F.col("correct"))
              .orderBy(F.desc("pred_confidence"), F.asc(key))
              .select(key, *columns)
              .limit(n))


def recent_reviews(df: DataFrame, n: int = 8, cluster: str = "cluster_name",
                   text: str = "text", key: str = "review_id") -> DataFrame:
    """First n rows with text per cluster, in key order."""
    w = Window.partitionBy(cluster).orderBy(F.col(key))
    return (df.filter(F.col(text).isNotNull())
              .withColumn("position", F.row_number().over(w))
              .filter(F.col("position") <= n))


def rank_marker(rank="rank", is_worst="is_worst", k: int = 3):
    """TOP for rank <= k, BAD for the next one shown and for the last row."""
    r, w = F.col(rank), F.col(is_worst)
    return F.when(r <= k, "TOP").when((r == k + 1) | w, "BAD").otherwise(F.lit(None).cast("string"))
