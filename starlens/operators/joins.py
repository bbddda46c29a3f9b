"""Joins (E1-E4).

No side is hinted for broadcast: the planner and AQE compare byte sizes with
``spark.sql.autoBroadcastJoinThreshold`` each time a query runs, so a table
that has grown is shuffled and a hot key split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_key(col) -> "F.Column":
    """Catalogue names may hold CRLF line breaks; join on LF form."""
    return F.regexp_replace(col, "\r\n?", "\n")


def attach_cluster(reviews: DataFrame, catalog: DataFrame, key: str = "name",
                   cluster: str = "cluster_name", default: str = "Other") -> DataFrame:
    """Left join of the catalogue's cluster onto reviews; unmatched -> default.

    Null keys match null keys (pandas merge semantics), hence ``eqNullSafe``.
    Duplicate catalogue names fan out, as in the reference.
    """
    right = catalog.select(F.col(key).alias("__k"), F.col(cluster).alias("__cluster"))
    base = reviews.drop(cluster) if cluster in reviews.columns else reviews
    joined = base.join(right, base[key].eqNullSafe(right["__k"]), "left")
    return (joined.withColumn(cluster, F.coalesce(F.col("__cluster"), F.lit(default)))
                  .drop("__k", "__cluster"))


def inner_catalog(reviews: DataFrame, catalog: DataFrame, key: str = "name",
                  suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner equi-join on ``key``; clashing non-key columns get suffixes."""
    clash = (set(reviews.columns) & set(catalog.columns)) - {key}
    left = reviews.select([F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c)
                           for c in reviews.columns])
    right = catalog.select([F.col(c).alias(c + suffixes[1]) if c in clash else
                            (F.col(c).alias("__k") if c == key else F.col(c))
                            for c in catalog.columns])
    return left.join(right, left[key] == right["__k"], "inner").drop("__k")


def lookup_join(df: DataFrame, lookup: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Apply a (small) lookup table to rows by key."""
    return df.join(lookup, on=on, how=how)


def attach_stats(context: DataFrame, stats: DataFrame,
                 keys: tuple[str, ...] = ("cluster_name", "name")) -> DataFrame:
    """Per-product stats fetched by (cluster_name, name)."""
    return context.join(stats, on=list(keys), how="left")
