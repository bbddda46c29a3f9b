"""Star-vs-text audit columns and weights (C4-C8 on frames).

Class weights need class counts: one partial/final ``groupBy(label)`` (a
handful of rows) joined back by broadcast; no raw row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions.labels import (DEFAULT_THRESHOLD, STRICT_THRESHOLD, conflict_type,
                                       label_name, quality_weight, threshold_label)
from starlens.operators.joins import lookup_join


def add_text_labels(df: DataFrame, compound: str = "lex_compound", prefix: str = "lex_",
                    t_default: float = DEFAULT_THRESHOLD, t_strict: float = STRICT_THRESHOLD) -> DataFrame:
    """C4: default and strict labels from the compound score (+ names)."""
    return (df.withColumn(prefix + "label", threshold_label(compound, t_default))
              .withColumn(prefix + "label_name", label_name(prefix + "label"))
              .withColumn(prefix + "strict_label", threshold_label(compound, t_strict))
              .withColumn(prefix + "strict_label_name", label_name(prefix + "strict_label")))


def add_conflicts(df: DataFrame, star: str = "star_label",
                  strict: str = "lex_strict_label") -> DataFrame:
    """C5 + C6: conflict type, agree flag, quality weight."""
    return (df.withColumn("conflict_type", conflict_type(star, strict))
              .withColumn("agree", F.col("conflict_type") == "agree")
              .withColumn("quality_weight", quality_weight("conflict_type")))


def class_weights(df: DataFrame, label: str = "star_label") -> DataFrame:
    """C7 table: weight_c = N / (k * n_c) over the classes present."""
    return weights_from_counts(df.groupBy(label).agg(F.count("*").alias("n_c")), label)


def weights_from_counts(counts: DataFrame, label: str = "star_label") -> DataFrame:
    """C7 from (label, n_c), one row per class."""
    w = Window.partitionBy()  # over the k class rows only
    return counts.select(label, "n_c",
                         (F.sum("n_c").over(w) / (F.count("*").over(w) * F.col("n_c")))
                         .alias("class_weight"))


def add_class_weight(df: DataFrame, label: str = "star_label", fit_on: DataFrame | None = None,
                     default: float = 1.0) -> DataFrame:
    """Attach class weights computed on ``fit_on`` (default: ``df``);
    classes absent from ``fit_on`` get ``default``."""
    table = class_weights(fit_on if fit_on is not None else df, label).select(label, "class_weight")
    base = df.drop("class_weight")  # re-weighting (e.g. on the train split) replaces old weights
    out = lookup_join(base, table, label)
    return out.withColumn("class_weight", F.coalesce("class_weight", F.lit(float(default))))


def add_sample_weight(df: DataFrame) -> DataFrame:
    """Sample weight = quality weight x class weight."""
    return df.withColumn("sample_weight", F.col("quality_weight") * F.col("class_weight"))
