"""Evaluation metrics.

Everything is derived from small aggregates: confusion counts are one
partial/final ``groupBy(true, pred)`` (at most k*k rows per group), and all
class metrics are arithmetic on those counts.

ROC / PR curves need cumulative sums over distinct scores. A window
``partitionBy(class).orderBy(score)`` would put every distinct score of a
class into one task, so ``prefix_sums`` uses a two-pass scheme instead:
range-sort the (already aggregated) distinct scores, pin the result with a
reliable checkpoint, take per-partition totals (a few rows), turn them into
offsets, and finish with a cumulative window inside each sorted partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import cut_lineage

LABELS = (0, 1, 2)


def _label_grid(spark, labels=LABELS) -> DataFrame:
    return spark.createDataFrame([(t, p) for t in labels for p in labels],
                                 "true_label int, pred_label int")


def confusion_counts(df: DataFrame, true: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """(group..., true_label, pred_label, n) for pairs that occur."""
    group = list(group or [])
    return (df.groupBy(*group, F.col(true).cast("int").alias("true_label"),
                       F.col(pred).cast("int").alias("pred_label"))
              .agg(F.count("*").alias("n")))


def confusion_matrix(df: DataFrame, true: str, pred: str, labels=LABELS) -> DataFrame:
    """k x k zero-filled counts plus row percentage (0 for an empty row)."""
    counts = confusion_counts(df, true, pred)
    grid = _label_grid(df.sparkSession, labels)
    out = (grid.join(counts, ["true_label", "pred_label"], "left")
               .withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))
    row_total = F.sum("n").over(Window.partitionBy("true_label"))
    return out.withColumn("row_pct", F.when(row_total == 0, F.lit(0.0))
                          .otherwise(F.col("n") * 100.0 / row_total))


def _class_table(counts: DataFrame, group: list[str]) -> DataFrame:
    """Per (group, class): tp, true total T, predicted total P."""
    e = F.explode(F.array(
        F.struct(F.col("true_label").alias("cls"), F.col("n").alias("T"), F.lit(0).cast("long").alias("P"),
                 F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).cast("long")
                 .alias("tp")),
        F.struct(F.col("pred_label").alias("cls"), F.lit(0).cast("long").alias("T"), F.col("n").alias("P"),
                 F.lit(0).cast("long").alias("tp")))).alias("e")
    return (counts.select(*group, e).groupBy(*group, F.col("e.cls").alias("cls"))
                  .agg(F.sum("e.T").alias("T"), F.sum("e.P").alias("P"), F.sum("e.tp").alias("tp")))


def classification_metrics(df: DataFrame, true: str, pred: str,
                           group: list[str] | None = None) -> DataFrame:
    """F14 (and F23 with ``group``): accuracy, balanced accuracy, macro F1,
    weighted F1 and MCC from confusion counts."""
    group = list(group or [])
    cls = _class_table(confusion_counts(df, true, pred, group), group)
    # Products of counts overflow 64 bits at a few thousand million rows.
    cls = cls.select(*group, "cls", "T", *[F.col(c).cast("double").alias(c + "_") for c in ("T", "P", "tp")], "P", "tp")
    f1 = F.when(F.col("T") + F.col("P") > 0, 2.0 * F.col("tp") / (F.col("T") + F.col("P"))).otherwise(0.0)
    recall = F.when(F.col("T") > 0, F.col("tp") / F.col("T"))
    n, total = F.sum("T"), F.sum("T_")
    sum_tp = F.sum("tp_")
    cov = total * sum_tp - F.sum(F.col("T_") * F.col("P_"))
    den = F.sqrt(total * total - F.sum(F.col("P_") * F.col("P_"))) * F.sqrt(
        total * total - F.sum(F.col("T_") * F.col("T_")))
    out = cls.groupBy(*group).agg(
        (sum_tp / n).alias("accuracy"),
        F.avg(recall).alias("balanced_accuracy"),
        F.avg(F.when(F.col("T") + F.col("P") > 0, f1)).alias("macro_f1"),
        (F.sum(F.col("T") * f1) / n).alias("weighted_f1"),
        F.when(den == 0, F.lit(0.0)).otherwise(cov / den).alias("mcc"),
        n.alias("n"))
    return out


def classification_report(df: DataFrame, true: str, pred: str, labels=LABELS,
                          names=("Negative", "Neutral", "Positive")) -> DataFrame:
    """per class precision/recall/F1/support, then accuracy, macro avg,
    weighted avg rows (all classes, 0 where undefined)."""
    spark = df.sparkSession
    cls = _class_table(confusion_counts(df, true, pred), [])
    all_cls = spark.createDataFrame([(c, nm) for c, nm in zip(labels, names)], "cls int, label string")
    cls = (all_cls.join(cls, "cls", "left")
                  .select("cls", "label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                            for c in ("T", "P", "tp")]))
    per = cls.select(
        "cls", "label",
        F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0).alias("precision"),
        F.when(F.col("T") > 0, F.col("tp") / F.col("T")).otherwise(0.0).alias("recall"),
        F.when(F.col("T") + F.col("P") > 0, 2.0 * F.col("tp") / (F.col("T") + F.col("P")))
         .otherwise(0.0).alias("f1"),
        F.col("T").alias("support"), "tp")
    n = F.sum("support")
    summary = per.agg(
        F.struct(F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                 (F.sum("tp") / n).alias("f1"), n.alias("support")).alias("accuracy"),
        F.struct(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                 F.avg("f1").alias("f1"), n.alias("support")).alias("macro"),
        F.struct((F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                 (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                 (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"), n.alias("support")).alias("weighted"))
    rows = summary.select(F.explode(F.array(
        F.struct(F.lit(3).alias("cls"), F.lit("accuracy").alias("label"), F.col("accuracy").alias("m")),
        F.struct(F.lit(4).alias("cls"), F.lit("macro avg").alias("label"), F.col("macro").alias("m")),
        F.struct(F.lit(5).alias("cls"), F.lit("weighted avg").alias("label"), F.col("weighted").alias("m"))))
        .alias("r")).select(F.col("r.cls").alias("row"), "r.label", "r.m.precision", "r.m.recall",
                            "r.m.f1", "r.m.support")
    return per.select(F.col("cls").alias("row"), "label", "precision", "recall", "f1",
                      "support").unionByName(rows)


def prefix_sums(df: DataFrame, part: list[str], order: list, values: list[str],
                num_partitions: int | None = None) -> DataFrame:
    """Distributed cumulative sums of ``values`` within ``part`` in ``order``.

    Adds ``cum_<v>`` (inclusive) and ``total_<v>`` per part. ``order``
    must be a total order within a part (e.g. distinct scores). Rows without
    a value in ``part`` are a part of their own.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(n, *[F.col(c) for c in part], *order)
                 .sortWithinPartitions(*[F.col(c) for c in part], *order)
                 .withColumn("__seq", F.monotonically_increasing_id()))
    ordered = cut_lineage(ordered)          # pin the sort: both passes see one layout
    ordered = ordered.withColumn("__blk", F.shiftright("__seq", 33))
    blocks = ordered.groupBy(*part, "__blk").agg(*[F.sum(v).alias("__b_" + v) for v in values])
    wb = Window.partitionBy(*part).orderBy("__blk")
    offsets = blocks.select(*part, "__blk",
                            *[(F.sum("__b_" + v).over(wb.rowsBetween(Window.unboundedPreceding, 0))
                               - F.col("__b_" + v)).alias("__o_" + v) for v in values],
                            *[F.sum("__b_" + v).over(Window.partitionBy(*part)).alias("total_" + v)
                              for v in values])
    wi = Window.partitionBy(*part, "__blk").orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0)
    names = {c: f"__part_{i}" for i, c in enumerate([*part, "__blk"])}
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    out = ordered.join(offsets.withColumnsRenamed(names), same)
    return out.select(*[c for c in df.columns],
                      *[(F.sum(v).over(wi) + F.col("__o_" + v)).alias("cum_" + v) for v in values],
                      *["total_" + v for v in values])


def _score_points(df: DataFrame, true: str, probs: dict[int, str],
                  score_digits: int | None = None) -> DataFrame:
    """One row per (class, distinct score): positives and negatives there.
    ``score_digits`` rounds scores first (thresholds at that precision)."""
    def sc(p):
        return F.round(F.col(p), score_digits) if score_digits is not None else F.col(p)
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), sc(p).alias("score"))
                            for c, p in probs.items()])).alias("e")
    long = df.select(F.col(true).alias("y"), e)
    return (long.groupBy(F.col("e.cls").alias("cls"), F.col("e.score").alias("score"))
                .agg(F.count_if(F.col("y") == F.col("e.cls")).alias("tp"),
                     F.count_if(F.col("y") != F.col("e.cls")).alias("fp")))


DEFAULT_PROBS = {0: "prob_negative", 1: "prob_neutral", 2: "prob_positive"}


def roc_points(df: DataFrame, true: str = "star_label", probs: dict[int, str] | None = None,
               score_digits: int | None = None) -> DataFrame:
    """F16 curve: per class and threshold (distinct score, descending):
    cumulative tp/fp, TPR, FPR. Classes with no positives or no negatives
    are skipped."""
    pts = prefix_sums(_score_points(df, true, probs or DEFAULT_PROBS, score_digits), ["cls"],
                      [F.col("score").desc()], ["tp", "fp"])
    pts = pts.filter((F.col("total_tp") > 0) & (F.col("total_fp") > 0))
    return pts.select("cls", "score", "tp", "fp", "cum_tp", "cum_fp", "total_tp", "total_fp",
                      (F.col("cum_tp") / F.col("total_tp")).alias("tpr"),
                      (F.col("cum_fp") / F.col("total_fp")).alias("fpr"))


def roc_auc(df: DataFrame, true: str = "star_label", probs: dict[int, str] | None = None,
            score_digits: int | None = None) -> DataFrame:
    """F16 area: trapezoids between consecutive thresholds; the previous
    point is (cum - step), so no lag is needed."""
    pts = roc_points(df, true, probs, score_digits)
    area = F.sum(F.col("fp") / F.col("total_fp").cast("double")
                 * ((F.col("cum_tp") + (F.col("cum_tp") - F.col("tp"))) / (2.0 * F.col("total_tp"))))
    return pts.groupBy("cls").agg(area.alias("auc"), F.count("*").alias("n_thresholds"))


def pr_points(df: DataFrame, true: str = "star_label", probs: dict[int, str] | None = None,
               score_digits: int | None = None) -> DataFrame:
    """F17 curve: precision / recall per threshold (classes without positives skipped)."""
    pts = prefix_sums(_score_points(df, true, probs or DEFAULT_PROBS, score_digits), ["cls"],
                      [F.col("score").desc()], ["tp", "fp"])
    pts = pts.filter(F.col("total_tp") > 0)
    return pts.select("cls", "score", "tp", "cum_tp", "cum_fp", "total_tp",
                      (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
                      (F.col("cum_tp") / F.col("total_tp")).alias("recall"))


def average_precision(df: DataFrame, true: str = "star_label",
                      probs: dict[int, str] | None = None, score_digits: int | None = None) -> DataFrame:
    """F17 AP = sum (R_i - R_{i-1}) * P_i, no interpolation."""
    pts = pr_points(df, true, probs, score_digits)
    ap = F.sum(F.col("tp") / F.col("total_tp") * F.col("precision"))
    return pts.groupBy("cls").agg(ap.alias("average_precision"))


def weighted_loss(df: DataFrame, class_weight: list[float], true: str = "star_label",
                  probs: tuple[str, ...] = ("prob_negative", "prob_neutral", "prob_positive"),
                  row_weight: str | None = "sample_weight", smoothing: float = 0.05) -> DataFrame:
    """mean over rows of row_weight * [(1-e) w_y (-log p_y) + (e/K) sum_c w_c (-log p_c)].

    ``class_weight`` holds one weight per class (K numbers, e.g. from
    ``class_weights`` on the training split)."""
    k = len(probs)
    nll = [-F.log(F.col(p)) for p in probs]
    wy = F.lit(None).cast("double")
    nll_y = F.lit(None).cast("double")
    for c in range(k):
        wy = F.when(F.col(true) == c, F.lit(float(class_weight[c]))).otherwise(wy)
        nll_y = F.when(F.col(true) == c, nll[c]).otherwise(nll_y)
    smooth = sum((F.lit(float(class_weight[c])) * nll[c] for c in range(1, k)),
                 F.lit(float(class_weight[0])) * nll[0])
    loss = (1 - smoothing) * wy * nll_y + (smoothing / k) * smooth
    if row_weight:
        loss = F.col(row_weight) * loss
    return df.agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))


def model_comparison(preds: DataFrame, true: str = "true_label", pred: str = "pred_label",
                     group: tuple[str, ...] = ("model", "split")) -> DataFrame:
    """F14 metrics for every (model, split) side by side."""
    return classification_metrics(preds, true, pred, group=list(group))
