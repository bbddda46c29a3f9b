"""Filters and predicates (D1-D6) and set operations (H1, H2).

Plain ``filter`` / ``isin`` predicates: on parquet they reach the scan as
pushed filters; nothing here shuffles except ``distinct`` (partial/final).
Conditions on columns that are costly to compute go through ``filter_computed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions.labels import STRONG_CONFLICTS


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)`` for a condition on computed columns (scores of
    whole texts). A plain filter moves below the projections that compute its
    columns and there spells out all of their steps once for every mention of
    them, so a text is read hundreds of times; a generated column stays where
    it is made, and its input is computed once."""
    return df.select("*", F.explode_outer(F.array(condition)).alias("__keep")).filter("__keep").drop("__keep")


def filter_reviews(df: DataFrame, cluster: str = "All", sentiment: str = "All",
                   cluster_col: str = "cluster_name", sentiment_col: str = "sentiment") -> DataFrame:
    """Optional equality predicates ("All" = no predicate)."""
    if cluster != "All":
        df = df.filter(F.col(cluster_col) == cluster)
    if sentiment != "All" and sentiment_col in df.columns:
        df = df.filter(F.col(sentiment_col) == sentiment)
    return df


def facet_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values (the UI prepends "All")."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def drop_strong_conflicts(train: DataFrame, conflict: str = "conflict_type",
                          types: list[str] | None = None) -> DataFrame:
    """D3: remove strong star/text contradictions (training split only)."""
    return filter_computed(train, ~F.col(conflict).isin(*(types or STRONG_CONFLICTS)))


def conflict_examples(df: DataFrame, conflict_type: str, n: int = 20,
                      key: str = "review_id", conflict: str = "conflict_type",
                      columns: list[str] | None = None) -> DataFrame:
    """The first n rows of one conflict type (key order), six columns."""
    columns = columns or ["rating", "star_label_name", "lex_compound",
                          "lex_strict_label_name", "review_title", "review_body"]
    return (filter_computed(df, F.col(conflict) == conflict_type)
              .orderBy(key).select(key, *columns).limit(n))


def select_cluster(df: DataFrame, cluster: str | None = None, exclude: str | None = "Other",
                   cluster_col: str = "cluster_name") -> DataFrame:
    """Keep one cluster, and/or drop the catch-all cluster."""
    if cluster is not None:
        df = df.filter(F.col(cluster_col) == cluster)
    if exclude is not None:
        df = df.filter(F.col(cluster_col) != exclude)
    return df


def drop_missing_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with text only."""
    return df.filter(F.col(text).isNotNull())


def append_reviews(df: DataFrame, new: DataFrame) -> DataFrame:
    """H1: append rows carrying a subset of the columns; the rest are null."""
    return df.unionByName(new, allowMissingColumns=True)
