"""Registered evaluation, split and sampling queries: C9, C10, F13-F18,
F21-F23, G6, I1-I3, A7."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.labels import label_name, predict_columns, softmax, star_label
from starlens.operators import aggregates as agg
from starlens.operators import metrics as mt
from starlens.operators import ranking as rk
from starlens.operators import sampling as sp
from starlens.operators.audit import class_weights
from starlens.plans.q_audit import audit_sql
from starlens.plans.q_audit import _audited as audited
from starlens.plans.registry import register, rounded
from starlens.sources import fixtures as fx

# --- numeric predictions (reviews_num) -------------------------------------
PRED_NUM_SQL = """
SELECT *, CASE WHEN prob_negative >= prob_neutral AND prob_negative >= prob_positive THEN 0
               WHEN prob_neutral >= prob_positive THEN 1 ELSE 2 END AS pred_label,
       greatest(prob_negative, prob_neutral, prob_positive) AS pred_confidence
FROM (SELECT *, e0 / (e0 + e1 + e2) AS prob_negative, e1 / (e0 + e1 + e2) AS prob_neutral,
             e2 / (e0 + e1 + e2) AS prob_positive
      FROM (SELECT *, exp(logit_neg - m) AS e0, exp(logit_neu - m) AS e1, exp(logit_pos - m) AS e2
            FROM (SELECT *, greatest(logit_neg, logit_neu, logit_pos) AS m,
                         CASE WHEN rating <= 2 THEN 0 WHEN rating = 3 THEN 1 ELSE 2 END AS star_label
                  FROM (SELECT * EXCLUDE (pred_label) FROM reviews_num) r) a) b) c"""

PREDS_SQL = """SELECT *, pred_label = star_label AS correct FROM pred0"""


def num_sql(body: str, more: list | None = None) -> str:
    return fx.with_views(body, "reviews_num",
                         extra=[("pred0", PRED_NUM_SQL), ("preds", PREDS_SQL)] + list(more or []))


def _preds_num(spark, sf):
    df = (fx.reviews_num(spark, sf)
            .withColumn("star_label", star_label("rating"))
            .withColumn("probs", softmax(F.array("logit_neg", "logit_neu", "logit_pos"))))
    for name, col in predict_columns("probs", "star_label").items():
        df = df.withColumn(name, col)
    return df


@register("c9_softmax", num_sql("""
SELECT ord, line, product_id, round(prob_negative, 6) AS prob_negative, round(prob_neutral, 6) AS prob_neutral,
       round(prob_positive, 6) AS prob_positive FROM preds"""))
def c9_softmax(spark, sf):
    return rounded(_preds_num(spark, sf).select("ord", "line", "product_id", "prob_negative",
                                                "prob_neutral", "prob_positive"))


@register("c10_predict_columns", num_sql("""
SELECT ord, line, product_id, pred_label, round(pred_confidence, 6) AS pred_confidence, correct FROM preds"""))
def c10_predict_columns(spark, sf):
    return rounded(_preds_num(spark, sf).select("ord", "line", "product_id", "pred_label",
                                                "pred_confidence", "correct"))


CLS_SQL = """
SELECT c.i AS cls, coalesce(t.T, 0) AS T, coalesce(p.P, 0) AS P, coalesce(d.tp, 0) AS tp
FROM range(3) c(i)
LEFT JOIN (SELECT star_label AS k, count(*) AS T FROM preds GROUP BY 1) t ON t.k = c.i
LEFT JOIN (SELECT pred_label AS k, count(*) AS P FROM preds GROUP BY 1) p ON p.k = c.i
LEFT JOIN (SELECT star_label AS k, count(*) AS tp FROM preds WHERE star_label = pred_label GROUP BY 1) d ON d.k = c.i"""

METRICS_SQL = """
SELECT round(sum(tp) / sum(T), 6) AS accuracy,
       round(avg(CASE WHEN T > 0 THEN tp / T END), 6) AS balanced_accuracy,
       round(avg(CASE WHEN T + P > 0 THEN 2.0 * tp / (T + P) END), 6) AS macro_f1,
       round(sum(T * CASE WHEN T + P > 0 THEN 2.0 * tp / (T + P) ELSE 0.0 END) / sum(T), 6) AS weighted_f1,
       round(CASE WHEN (sum(T) * sum(T) - sum(P * P)) * (sum(T) * sum(T) - sum(T * T)) = 0 THEN 0.0
            ELSE (sum(T) * sum(tp) - sum(T * P)) / sqrt(CAST(sum(T) * sum(T) - sum(P * P) AS DOUBLE)
                 * CAST(sum(T) * sum(T) - sum(T * T) AS DOUBLE)) END, 6) AS mcc,
       CAST(sum(T) AS BIGINT) AS n
FROM cls WHERE T + P > 0"""


@register("f14_classification_metrics", num_sql(METRICS_SQL, more=[("cls", CLS_SQL)]))
def f14_classification_metrics(spark, sf):
    return rounded(mt.classification_metrics(_preds_num(spark, sf), "star_label", "pred_label"))


@register("f15_classification_report", num_sql("""
SELECT CAST(cls AS INTEGER) AS "row", CASE cls WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS label,
       round(CASE WHEN P > 0 THEN tp / P ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN T > 0 THEN tp / T ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN T + P > 0 THEN 2.0 * tp / (T + P) ELSE 0.0 END, 6) AS f1, CAST(T AS BIGINT) AS support
FROM cls
UNION ALL
SELECT 3, 'accuracy', NULL, NULL, round(sum(tp) / sum(T), 6), CAST(sum(T) AS BIGINT) FROM cls
UNION ALL
SELECT 4, 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), CAST(sum(T) AS BIGINT) FROM m
UNION ALL
SELECT 5, 'weighted avg', round(sum(pr * T) / sum(T), 6), round(sum(rc * T) / sum(T), 6),
       round(sum(f1 * T) / sum(T), 6), CAST(sum(T) AS BIGINT) FROM m""", more=[
    ("cls", CLS_SQL),
    ("m", """SELECT T, CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS pr, CASE WHEN T > 0 THEN tp / T ELSE 0.0 END AS rc,
                    CASE WHEN T + P > 0 THEN 2.0 * tp / (T + P) ELSE 0.0 END AS f1 FROM cls""")]))
def f15_classification_report(spark, sf):
    return rounded(mt.classification_report(_preds_num(spark, sf), "star_label", "pred_label"))


# Thresholds are probabilities rounded to 9 places: exp() differs in the last
# ulp between engines (and libm versions), which would split ties.
SCORE_DIGITS = 9

POINTS_SQL = """
SELECT cls, score, tp, fp,
       sum(tp) OVER (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_tp,
       sum(fp) OVER (PARTITION BY cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_fp,
       sum(tp) OVER (PARTITION BY cls) AS total_tp, sum(fp) OVER (PARTITION BY cls) AS total_fp
FROM (SELECT cls, score, CAST(count_if(y = cls) AS BIGINT) AS tp, CAST(count_if(y <> cls) AS BIGINT) AS fp
      FROM (SELECT star_label AS y, 0 AS cls, round(prob_negative, 9) AS score FROM preds
            UNION ALL SELECT star_label, 1, round(prob_neutral, 9) FROM preds
            UNION ALL SELECT star_label, 2, round(prob_positive, 9) FROM preds) l
      GROUP BY cls, score) g"""


@register("f16_roc_curve", num_sql("""
SELECT CAST(cls AS INTEGER) AS cls, round(score, 6) AS score, CAST(cum_tp AS BIGINT) AS cum_tp,
       CAST(cum_fp AS BIGINT) AS cum_fp, round(cum_tp / total_tp, 6) AS tpr, round(cum_fp / total_fp, 6) AS fpr
FROM pts WHERE total_tp > 0 AND total_fp > 0""", more=[("pts", POINTS_SQL)]))
def f16_roc_curve(spark, sf):
    return rounded(mt.roc_points(_preds_num(spark, sf), score_digits=SCORE_DIGITS)
                   .select("cls", "score", "cum_tp", "cum_fp", "tpr", "fpr"))


@register("f16_roc_auc", num_sql("""
SELECT CAST(cls AS INTEGER) AS cls,
       round(sum(fp * (2 * cum_tp - tp)) / (2.0 * any_value(total_tp) * any_value(total_fp)), 6) AS auc,
       count(*) AS n_thresholds
FROM pts WHERE total_tp > 0 AND total_fp > 0 GROUP BY cls""", more=[("pts", POINTS_SQL)]))
def f16_roc_auc(spark, sf):
    return rounded(mt.roc_auc(_preds_num(spark, sf), score_digits=SCORE_DIGITS))


@register("f17_pr_curve", num_sql("""
SELECT CAST(cls AS INTEGER) AS cls, round(score, 6) AS score, round(cum_tp / (cum_tp + cum_fp), 6) AS precision,
       round(cum_tp / total_tp, 6) AS recall
FROM pts WHERE total_tp > 0""", more=[("pts", POINTS_SQL)]))
def f17_pr_curve(spark, sf):
    return rounded(mt.pr_points(_preds_num(spark, sf), score_digits=SCORE_DIGITS).select("cls", "score", "precision", "recall"))


@register("f17_average_precision", num_sql("""
SELECT CAST(cls AS INTEGER) AS cls, round(sum(tp / total_tp * (cum_tp / (cum_tp + cum_fp))), 6) AS average_precision
FROM pts WHERE total_tp > 0 GROUP BY cls""", more=[("pts", POINTS_SQL)]))
def f17_average_precision(spark, sf):
    return rounded(mt.average_precision(_preds_num(spark, sf), score_digits=SCORE_DIGITS))


@register("f18_hard_error_counts", num_sql("""
SELECT count(*) AS total, CAST(count_if(NOT correct) AS BIGINT) AS wrong,
       CAST(count_if(NOT correct AND pred_confidence >= 0.8) AS BIGINT) AS wrong_confident FROM preds"""))
def f18_hard_error_counts(spark, sf):
    return agg.hard_error_counts(_preds_num(spark, sf))


@register("f21_calibration_curve", num_sql("""
SELECT CAST(cls AS INTEGER) AS cls, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, round(avg(p), 6) AS mean_predicted,
       round(avg(CASE WHEN y = cls THEN 1 ELSE 0 END), 6) AS observed_rate, count(*) AS n
FROM (SELECT star_label AS y, 0 AS cls, prob_negative AS p FROM preds
      UNION ALL SELECT star_label, 1, prob_neutral FROM preds
      UNION ALL SELECT star_label, 2, prob_positive FROM preds) l
GROUP BY 1, 2"""))
def f21_calibration_curve(spark, sf):
    return rounded(agg.calibration_curve(_preds_num(spark, sf)))


@register("f22_weighted_loss", num_sql("""
SELECT round(avg(0.95 * wy * -ln(py) + (0.05 / 3) * (w0 * -ln(prob_negative) + w1 * -ln(prob_neutral)
                 + w2 * -ln(prob_positive))), 6) AS loss, count(*) AS n
FROM (SELECT p.*, w.w0, w.w1, w.w2,
             CASE star_label WHEN 0 THEN w.w0 WHEN 1 THEN w.w1 ELSE w.w2 END AS wy,
             CASE star_label WHEN 0 THEN prob_negative WHEN 1 THEN prob_neutral ELSE prob_positive END AS py
      FROM preds p CROSS JOIN (
        SELECT max(CASE WHEN star_label = 0 THEN cw END) AS w0, max(CASE WHEN star_label = 1 THEN cw END) AS w1,
               max(CASE WHEN star_label = 2 THEN cw END) AS w2
        FROM (SELECT star_label, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS cw
              FROM preds GROUP BY star_label) c) w) t"""))
def f22_weighted_loss(spark, sf):
    preds = _preds_num(spark, sf)
    table = {r["star_label"]: r["class_weight"] for r in class_weights(preds).collect()}
    weights = [table.get(c, 1.0) for c in range(3)]
    return rounded(mt.weighted_loss(preds, weights, row_weight=None))


# --- audited text reviews: lexicon model as the scored model ----------------
LEXPRED_SQL = """
SELECT *, pred_label = star_label AS correct,
       CASE pred_label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS pred_label_name,
       star_label_name AS true_label_name
FROM (SELECT *, CASE WHEN prob_negative >= prob_neutral AND prob_negative >= prob_positive THEN 0
                     WHEN prob_neutral >= prob_positive THEN 1 ELSE 2 END AS pred_label,
             greatest(prob_negative, prob_neutral, prob_positive) AS pred_confidence
      FROM (SELECT *, e0 / (e0 + e1 + e2) AS prob_negative, e1 / (e0 + e1 + e2) AS prob_neutral,
                   e2 / (e0 + e1 + e2) AS prob_positive
            FROM (SELECT *, exp(-lex_compound - m) AS e0, exp(0.0 - m) AS e1, exp(lex_compound - m) AS e2
                  FROM (SELECT *, greatest(-lex_compound, 0.0, lex_compound) AS m FROM audited) a) b) c) d"""


def _lex_preds(spark, sf):
    df = audited(spark, sf).withColumn(
        "probs", softmax(F.array(-F.col("lex_compound"), F.lit(0.0), F.col("lex_compound"))))
    for name, col in predict_columns("probs", "star_label").items():
        df = df.withColumn(name, col)
    return (df.withColumn("pred_label_name", label_name("pred_label"))
              .withColumn("true_label_name", F.col("star_label_name")))


@register("f13_error_by_group", audit_sql("""
SELECT conflict_type, count(*) AS n, round(avg(CASE WHEN NOT correct THEN 1 ELSE 0 END), 6) AS error_rate,
       round(avg(pred_confidence), 6) AS avg_confidence
FROM lexpreds GROUP BY conflict_type""", more=[("lexpreds", LEXPRED_SQL)]))
def f13_error_by_group(spark, sf):
    return rounded(agg.error_by_group(_lex_preds(spark, sf)))


@register("g6_hard_errors", audit_sql("""
SELECT review_id, rating, true_label_name, pred_label_name, round(pred_confidence, 6) AS pred_confidence,
       round(lex_compound, 6) AS lex_compound, lex_strict_label_name, conflict_type, review_title, review_body
FROM lexpreds WHERE NOT correct ORDER BY pred_confidence DESC, review_id LIMIT 30""",
    more=[("lexpreds", LEXPRED_SQL)]))
def g6_hard_errors(spark, sf):
    return rounded(rk.hard_errors(_lex_preds(spark, sf)))


SPLIT_SQL = """
SELECT *, CASE WHEN hash_u < 0.7 THEN 'train' WHEN hash_u < 0.85 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, CAST('0x' || substr(md5(concat('42', ':', CAST(review_id AS VARCHAR))), 1, 8) AS BIGINT)
                / 4294967296.0 AS hash_u FROM audited) t"""


@register("i1_stratified_split", audit_sql("SELECT review_id, star_label, split FROM splits",
                                           more=[("splits", SPLIT_SQL)]))
def i1_stratified_split(spark, sf):
    return sp.stratified_split(audited(spark, sf)).select("review_id", "star_label", "split")


EXACT_SPLIT_SQL = """
SELECT review_id, star_label,
       CASE WHEN r <= n - ceil(n * 0.3) THEN 'train'
            WHEN r <= n - ceil(n * 0.3) + (ceil(n * 0.3) - ceil(ceil(n * 0.3) * 0.5)) THEN 'val'
            ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY star_label ORDER BY hash_u, review_id) AS r,
             count(*) OVER (PARTITION BY star_label) AS n FROM splits) t"""


@register("i1_stratified_split_exact", audit_sql(
    "SELECT * FROM exact", more=[("splits", SPLIT_SQL), ("exact", EXACT_SPLIT_SQL)]))
def i1_stratified_split_exact(spark, sf):
    return sp.stratified_split(audited(spark, sf), exact=True).select("review_id", "star_label", "split")


@register("i2_split_report", audit_sql("""
SELECT split, star_label_name, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS split_rows,
       round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY split), 3) AS share
FROM splits GROUP BY split, star_label_name""", more=[("splits", SPLIT_SQL)]))
def i2_split_report(spark, sf):
    return rounded(sp.split_report(sp.stratified_split(audited(spark, sf))))


@register("i3_undersample", audit_sql("""
SELECT review_id, star_label FROM (
  SELECT *, row_number() OVER (PARTITION BY star_label ORDER BY hash_u, review_id) AS r,
         min(n) OVER () AS m
  FROM (SELECT *, count(*) OVER (PARTITION BY star_label) AS n FROM splits) a) t
WHERE r <= m""", more=[("splits", SPLIT_SQL)]))
def i3_undersample(spark, sf):
    return sp.undersample(audited(spark, sf)).select("review_id", "star_label")


@register("a7_bounded_sample", audit_sql("""
SELECT review_id, star_label FROM audited
ORDER BY md5(concat('42', ':', CAST(review_id AS VARCHAR))), review_id LIMIT 100"""))
def a7_bounded_sample(spark, sf):
    return sp.bounded_sample(audited(spark, sf), 100).select("review_id", "star_label")


F23_SQL = """
SELECT model, split, round(sum(tp) / sum(T), 6) AS accuracy,
       round(avg(CASE WHEN T > 0 THEN tp / T END), 6) AS balanced_accuracy,
       round(avg(CASE WHEN T + P > 0 THEN 2.0 * tp / (T + P) END), 6) AS macro_f1,
       round(sum(T * CASE WHEN T + P > 0 THEN 2.0 * tp / (T + P) ELSE 0.0 END) / sum(T), 6) AS weighted_f1,
       round(CASE WHEN (sum(T) * sum(T) - sum(P * P)) * (sum(T) * sum(T) - sum(T * T)) = 0 THEN 0.0
            ELSE (sum(T) * sum(tp) - sum(T * P)) / sqrt(CAST(sum(T) * sum(T) - sum(P * P) AS DOUBLE)
                 * CAST(sum(T) * sum(T) - sum(T * T) AS DOUBLE)) END, 6) AS mcc,
       CAST(sum(T) AS BIGINT) AS n
FROM (SELECT model, split, cls, sum(T) AS T, sum(P) AS P, sum(tp) AS tp FROM (
        SELECT model, split, t AS cls, 1 AS T, 0 AS P, CASE WHEN t = p THEN 1 ELSE 0 END AS tp FROM lp
        UNION ALL SELECT model, split, p, 0, 1, 0 FROM lp) u GROUP BY model, split, cls) c
WHERE T + P > 0 GROUP BY model, split"""


@register("f23_model_comparison", audit_sql(F23_SQL, more=[("splits", SPLIT_SQL), ("lp", """
SELECT 'lexicon' AS model, split, star_label AS t, lex_label AS p FROM splits
UNION ALL SELECT 'lexicon_strict', split, star_label, lex_strict_label FROM splits""")]))
def f23_model_comparison(spark, sf):
    df = sp.stratified_split(audited(spark, sf))
    long = (df.select("split", "star_label", F.explode(F.array(
        F.struct(F.lit("lexicon").alias("model"), F.col("lex_label").alias("p")),
        F.struct(F.lit("lexicon_strict").alias("model"), F.col("lex_strict_label").alias("p")))).alias("m"))
              .select(F.col("m.model").alias("model"), "split", F.col("star_label").alias("true_label"),
                      F.col("m.p").alias("pred_label")))
    return rounded(mt.model_comparison(long))
