"""Aggregations.

Every aggregate here is algebraic (count/sum/avg/min/max/corr/stddev) or a
conditional variant of one, so Spark runs it as partial + final
HashAggregate: a hot key is combined map-side before the shuffle and never
lands whole in one task. Totals needed for shares are computed on the
already-aggregated rows (one row per group value), not on raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions.labels import (HIGH_STAR_NEGATIVE, LOW_STAR_POSITIVE,
                                       normalize_label, overall_badge)


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """count per non-null value, most frequent first (ties by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias(name))
              .orderBy(F.desc(name), F.asc(col)))


def value_shares(df: DataFrame, col: str, by: list[str] | None = None,
                 scale: float = 1.0, digits: int | None = None) -> DataFrame:
    """share of each value over non-null rows (optionally within ``by``)."""
    by = list(by or [])
    counts = (df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n")))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy())
    share = F.col("n") / total * F.lit(float(scale))
    if digits is not None:
        share = F.round(share, digits)
    return counts.select(*by, col, F.col("n").alias("count"), share.alias("share"))


def ordered_counts(df: DataFrame, col: str, order: list) -> DataFrame:
    """counts in a fixed order of values; values that never occur get 0."""
    spark = df.sparkSession
    order_df = spark.createDataFrame([(i, v) for i, v in enumerate(order)],
                                     f"position int, {col} {df.schema[col].dataType.simpleString()}")
    counts = df.groupBy(col).agg(F.count("*").alias("count"))
    return (order_df.join(counts, on=col, how="left")
                    .select("position", col, F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """equal-width bins over [min, max]; last bin closed on the right.

    Two scalars (min, max) are fetched first; binning is one partial/final
    aggregate, and every bin (also empty ones) is emitted.
    """
    x = F.col(col).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
                .select("bin",
                        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                        F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def exact_quantiles(df: DataFrame, col: str, probs: tuple[float, ...]) -> dict[float, float | None]:
    """Exact quantiles with linear interpolation (pandas/numpy default).

    Distributed: distinct values with their counts (partial/final
    aggregate), running counts in value order from ``prefix_sums`` (range
    partitioned, no single task holds all values), then for each wanted
    0-based rank the first value whose running count passes it. Returns
    {p: value}; the few scalars come back to the driver.
    """
    from starlens.operators.metrics import prefix_sums
    x = F.col(col).cast("double")
    counts = (df.select(x.alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
                .groupBy("__x").agg(F.count("*").alias("__n"))
                .withColumn("__g", F.lit(0)))
    n = counts.agg(F.sum("__n")).first()[0]
    if not n:
        return {p: None for p in probs}
    ranks = sorted({r for p in probs for r in (int((n - 1) * p), min(int((n - 1) * p) + 1, n - 1))})
    cum = prefix_sums(counts, ["__g"], [F.col("__x").asc()], ["__n"])
    # value at 0-based rank r: smallest x with cum_n > r
    picks = cum.agg(*[F.min(F.when(F.col("cum___n") > r, F.col("__x"))).alias(f"r{r}") for r in ranks]).first()
    out = {}
    for p in probs:
        h = (n - 1) * p
        lo = int(h)
        hi = min(lo + 1, n - 1)
        a, b = picks[f"r{lo}"], picks[f"r{hi}"]
        out[p] = a + (h - lo) * (b - a)
    return out


def describe(df: DataFrame, col: str, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear), max.

    ``exact`` quartiles come from ``exact_quantiles`` (distributed running
    counts over distinct values); ``exact=False`` uses ``percentile_approx``.
    """
    x = F.col(col).cast("double")
    base = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min")]
    names = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
    if exact:
        q = exact_quantiles(df, col, tuple(p for _, p in names))
        quart = [F.lit(q[p]).cast("double").alias(n) for n, p in names]
    else:
        quart = [F.percentile_approx(x, p, accuracy).alias(n) for n, p in names]
    return df.agg(*base, *quart, F.max(x).alias("max"))


def _label_pcts(lbl):
    """Percent of positive/neutral/negative over non-null labels."""
    n = F.count(lbl)
    return [
        F.coalesce(F.try_divide(F.count_if(lbl == "positive") * 100.0, n), F.lit(0.0)).alias("pos_pct"),
        F.coalesce(F.try_divide(F.count_if(lbl == "neutral") * 100.0, n), F.lit(0.0)).alias("neu_pct"),
        F.coalesce(F.try_divide(F.count_if(lbl == "negative") * 100.0, n), F.lit(0.0)).alias("neg_pct"),
    ]


def overall_kpis(df: DataFrame, rating: str = "rating", sentiment: str = "sentiment") -> DataFrame:
    """total reviews, mean rating (2 places), sentiment percentages."""
    lbl = normalize_label(F.col(sentiment))
    return df.agg(F.count("*").alias("total"),
                  F.round(F.avg(F.col(rating).cast("double")), 2).alias("avg_rating"),
                  *_label_pcts(lbl))


def cluster_kpis(df: DataFrame, cluster: str = "cluster_name", rating: str = "rating",
                 sentiment: str = "sentiment") -> DataFrame:
    """F8: one grouped pass replaces the per-cluster filter loop."""
    lbl = normalize_label(F.col(sentiment))
    out = (df.filter(F.col(cluster).isNotNull())
             .groupBy(cluster)
             .agg(F.count("*").alias("total"),
                  F.avg(F.col(rating).cast("double")).alias("avg_rating"),
                  *_label_pcts(lbl)))
    return out.withColumn("badge", overall_badge("pos_pct"))


def product_stats(df: DataFrame, cluster: str = "cluster_name", name: str = "name",
                  rating: str = "rating", sentiment: str = "sentiment",
                  count_col: str | None = "text", min_reviews: int = 3,
                  exclude: str = "Other") -> DataFrame:
    """per (cluster, product) mean rating, review count and sentiment
    shares (null sentiment counts as 'not that class'), HAVING count >= min."""
    s = F.col(sentiment)
    cnt = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    return (df.filter((F.col(cluster) != exclude) & F.col(name).isNotNull())
              .groupBy(cluster, name)
              .agg(F.avg(F.col(rating).cast("double")).alias("avg_rating"),
                   cnt.alias("review_count"),
                   F.avg(F.when(s == 2, 1).otherwise(0)).alias("positive_pct"),
                   F.avg(F.when(s == 0, 1).otherwise(0)).alias("negative_pct"),
                   F.avg(F.when(s == 1, 1).otherwise(0)).alias("neutral_pct"))
              .filter(F.col("review_count") >= min_reviews))


def composite_score(avg_rating="avg_rating", positive_pct="positive_pct"):
    """0.5 * avg_rating + 0.5 * (5 * positive_pct)."""
    return (F.col(avg_rating) * F.lit(0.5) + F.col(positive_pct) * F.lit(5.0) * F.lit(0.5))


def cluster_sentiment(df: DataFrame, cluster: str = "cluster_name", sentiment: str = "sentiment",
                      exclude: str = "Other") -> DataFrame:
    """cluster x sentiment counts (all three forced, missing -> 0) and row %."""
    counts = (df.filter((F.col(cluster) != exclude) & F.col(sentiment).isNotNull())
                .groupBy(cluster).pivot(sentiment, [0, 1, 2]).count().na.fill(0))
    counts = counts.select(cluster, *[F.col(str(i)).cast("long").alias(n) for i, n in
                                      enumerate(["Negative", "Neutral", "Positive"])])
    total = F.col("Negative") + F.col("Neutral") + F.col("Positive")
    return counts.select("*", *[(F.col(n) / total * 100.0).alias(n.lower() + "_pct")
                                for n in ["Negative", "Neutral", "Positive"]])


def top_rated_products(df: DataFrame, n: int = 10, name: str = "name", rating: str = "rating",
                       cluster: str = "cluster_name") -> DataFrame:
    """per product mean and non-null count of ratings, a deterministic
    cluster (min), top n by mean (ties by name). Global top-k -> TakeOrdered."""
    return (df.filter(F.col(name).isNotNull())
              .groupBy(name)
              .agg(F.avg(F.col(rating).cast("double")).alias("avg_rating"),
                   F.count(rating).alias("review_count"),
                   F.min(cluster).alias("cluster"))
              .orderBy(F.desc_nulls_last("avg_rating"), F.asc(name))
              .limit(n))


def error_by_group(df: DataFrame, group: str = "conflict_type", correct: str = "correct",
                   confidence: str = "pred_confidence") -> DataFrame:
    """n, error rate and mean confidence per group, worst first."""
    return (df.groupBy(group)
              .agg(F.count("*").alias("n"),
                   F.avg(F.when(~F.col(correct), 1).otherwise(0)).alias("error_rate"),
                   F.avg(confidence).alias("avg_confidence"))
              .orderBy(F.desc("error_rate"), F.asc(group)))


def hard_error_counts(df: DataFrame, p: float = 0.80, correct: str = "correct",
                      confidence: str = "pred_confidence") -> DataFrame:
    """total, wrong, wrong with confidence >= p."""
    wrong = ~F.col(correct)
    return df.agg(F.count("*").alias("total"),
                  F.count_if(wrong).alias("wrong"),
                  F.count_if(wrong & (F.col(confidence) >= p)).alias("wrong_confident"))


def mismatch_rate(df: DataFrame, conflict: str = "conflict_type") -> DataFrame:
    """share of rows whose stars and text strongly disagree."""
    hit = F.col(conflict).isin(LOW_STAR_POSITIVE, HIGH_STAR_NEGATIVE)
    return df.agg(F.count("*").alias("n"),
                  F.count_if(hit).alias("mismatches"),
                  F.avg(F.when(hit, 1).otherwise(0)).alias("mismatch_rate"))


def rating_polarity_corr(df: DataFrame, rating: str = "rating",
                         compound: str = "lex_compound") -> DataFrame:
    """Pearson correlation of star rating and text polarity."""
    return df.agg(F.count("*").alias("n"),
                  F.corr(F.col(rating).cast("double"), F.col(compound)).alias("pearson_r"))


def calibration_curve(df: DataFrame, bins: int = 10, true_label: str = "star_label",
                      probs: tuple[str, str, str] = ("prob_negative", "prob_neutral",
                                                     "prob_positive")) -> DataFrame:
    """per class and probability bin: mean predicted, observed rate, n."""
    long = df.select(F.col(true_label).alias("y"),
                     F.explode(F.array(*[F.struct(F.lit(i).alias("cls"), F.col(p).alias("p"))
                                          for i, p in enumerate(probs)])).alias("e"))
    b = F.least(F.floor(F.col("e.p") * bins), F.lit(bins - 1)).cast("int")
    return (long.groupBy(F.col("e.cls").alias("cls"), b.alias("bin"))
                .agg(F.avg("e.p").alias("mean_predicted"),
                     F.avg(F.when(F.col("y") == F.col("e.cls"), 1).otherwise(0)).alias("observed_rate"),
                     F.count("*").alias("n")))
