"""Registered model queries (J4-J10). Iterative fits have no SQL equivalent:
tests check their invariants. What follows a fit is checked against SQL with
coefficients and centroids that both sides derive from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.labels import label_name, threshold_label
from starlens.operators import features as ft
from starlens.operators import metrics as mt
from starlens.operators import models as md
from starlens.operators import sampling as sp
from starlens.operators import sparse_models as sm
from starlens.operators.audit import add_class_weight
from starlens.operators.clean import clean_reviews
from starlens.operators.scorers import length_scorer
from starlens.plans.audit import scored_reviews, tfidf_featurizer, tfidf_lr_model
from starlens.plans.catalogue import product_catalogue
from starlens.plans.q_audit import _audited as audited
from starlens.plans.q_audit import audit_sql
from starlens.plans.q_eval import F23_SQL, SPLIT_SQL
from starlens.plans.q_text import TERMS_SQL, TEXT_STAGES, TF_SQL
from starlens.plans.registry import register, rounded
from starlens.session import cut_lineage, pin_rows
from starlens.sources import fixtures as fx
from starlens.streaming.stream import scratch_dir


def _split(spark, sf):
    return sp.stratified_split(audited(spark, sf))


def _pinned_split(spark, sf):
    """What features are built of: several readings, one scoring of the texts."""
    return pin_rows(_split(spark, sf).select("review_id", "split", "star_label", "text", *md.LEX_FEATURES))


_MODELS: dict = {}


def _model(spark, sf):
    """Fit once per session and input folder; J5-J7 share the fitted model."""
    k = (spark.sparkContext.applicationId, sf)
    if k not in _MODELS:
        df = _pinned_split(spark, sf)
        _MODELS[k] = (df,) + tfidf_lr_model(df)
    return _MODELS[k]


TRAIN_STAGES = [
    ("splits", SPLIT_SQL), ("terms_src", TERMS_SQL), ("tf", TF_SQL),
    ("train_vocab", """
SELECT term, count(*) AS df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_index
FROM tf WHERE review_id IN (SELECT review_id FROM splits WHERE split = 'train') GROUP BY term
HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM splits WHERE split = 'train')""")]


@register("j4_assemble", audit_sql("""
SELECT s.review_id, CAST((SELECT count(*) FROM train_vocab) + 4 AS INTEGER) AS n_features,
       CAST(coalesce(t.n, 0) + CAST(lex_neg <> 0 AS INTEGER) + CAST(lex_neu <> 0 AS INTEGER)
            + CAST(lex_pos <> 0 AS INTEGER) + CAST(lex_compound <> 0 AS INTEGER) AS INTEGER) AS nnz
FROM splits s LEFT JOIN (SELECT tf.review_id, count(*) AS n FROM tf JOIN train_vocab USING (term) GROUP BY tf.review_id) t
  ON s.review_id = t.review_id""", more=TRAIN_STAGES))
def j4_assemble(spark, sf):
    df = _pinned_split(spark, sf)
    featurize, _ = tfidf_featurizer(df)
    # The sparse vector's own index and value arrays: nothing is made dense.
    parts = md.sparse_parts("features")
    return featurize(df.select("review_id", "text", *md.LEX_FEATURES)).select("review_id", parts["size"].alias("n_features"),
                                F.size(F.filter(parts["values"], lambda x: x != 0)).alias("nnz"))


# Given coefficients of class c: ((term_index + 3 c) mod 7 - 3) / 4, and of the polarity columns and intercepts.
GIVEN_DENSE = {"lex_neg": [1.5, 0.0, -1.0], "lex_neu": [0.1, 0.4, 0.1], "lex_pos": [-1.0, 0.0, 1.5], "lex_compound": [-2.0, 0.0, 2.0]}
GIVEN_INTERCEPTS = [0.1, -0.2, 0.3]


def _z_sql(c):
    dense = " + ".join(f"CAST({v[c]} AS DOUBLE) * s.{k}" for k, v in GIVEN_DENSE.items())
    return f"coalesce(w.z{c}, 0) + {dense} + CAST({GIVEN_INTERCEPTS[c]} AS DOUBLE) AS z{c}"


GIVEN_STAGES = [("splits", SPLIT_SQL), *TEXT_STAGES, ("given", f"""
SELECT s.*, {", ".join(_z_sql(c) for c in range(3))} FROM splits s LEFT JOIN (
  SELECT review_id, {", ".join(f"sum(weight * ((term_index + {3 * c}) % 7 - 3) / 4.0::DOUBLE) AS z{c}" for c in range(3))}
  FROM tfidf GROUP BY review_id) w ON s.review_id = w.review_id"""),
    ("predicted", """
SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2,
       CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS pred_label
FROM (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1,
             exp(z2 - greatest(z0, z1, z2)) AS e2 FROM given) g""")]


def _given(spark, sf):
    df = _pinned_split(spark, sf)
    weights, _, _ = ft.tfidf_table(df, packed=True)
    b = [(((F.col("term_index") + 3 * c) % 7 - 3) / F.lit(4.0)).alias(f"b{c}") for c in range(3)]
    return md.linear_predict(weights, weights.ranked().select(weights.number().alias("term"), *b), GIVEN_INTERCEPTS, df, dense=GIVEN_DENSE)


@register("j6_predict_given", audit_sql("""
SELECT review_id, split, star_label, pred_label, round(greatest(p0, p1, p2), 6) AS pred_confidence, round(p0, 6) AS prob_negative,
       round(p1, 6) AS prob_neutral, round(p2, 6) AS prob_positive FROM predicted WHERE split <> 'train'""", more=GIVEN_STAGES))
def j6_predict_given(spark, sf):
    out = _given(spark, sf).filter(F.col("split") != "train")
    return rounded(out.select("review_id", "split", "star_label", "pred_label", "pred_confidence",
                              "prob_negative", "prob_neutral", "prob_positive"))


@register("j7_score_reviews_given", audit_sql("""
SELECT review_id, text, CASE pred_label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS model_sentiment,
       round(greatest(p0, p1, p2), 6) AS model_confidence, round(p0, 6) AS prob_negative, round(p1, 6) AS prob_neutral,
       round(p2, 6) AS prob_positive, lex_neg, lex_neu, lex_pos, lex_compound FROM predicted""", more=GIVEN_STAGES))
def j7_score_reviews_given(spark, sf):
    out = _given(spark, sf)
    return rounded(out.select("review_id", "text", label_name("pred_label").alias("model_sentiment"),
                              F.col("pred_confidence").alias("model_confidence"), "prob_negative", "prob_neutral",
                              "prob_positive", *md.LEX_FEATURES))


@register("f23_model_comparison_given", audit_sql(F23_SQL, more=[*GIVEN_STAGES, ("lp", """
SELECT 'lexicon' AS model, split, star_label AS t, lex_label AS p FROM predicted
UNION ALL SELECT 'lexicon_strict', split, star_label, lex_strict_label FROM predicted
UNION ALL SELECT 'linear', split, star_label, pred_label FROM predicted""")]))
def f23_model_comparison_given(spark, sf):
    """Lexicon at both thresholds beside the linear text model, on every split."""
    each = {"lexicon": threshold_label("lex_compound", 0.05), "lexicon_strict": threshold_label("lex_compound", 0.35),
            "linear": F.col("pred_label")}
    long = _given(spark, sf).select("split", F.col("star_label").alias("true_label"), F.explode(F.array(
        *[F.struct(F.lit(k).alias("model"), p.cast("int").alias("pred_label")) for k, p in each.items()])).alias("m"))
    return rounded(mt.model_comparison(long.select("m.model", "split", "true_label", "m.pred_label")))


TERM_B = [f"((term_index + {3 * c}) % 7 - 3) / 4.0::DOUBLE" for c in range(3)]
RESID = [f"cw * (p{c} - CAST(star_label = {c} AS INTEGER)) / (SELECT sum(cw) FROM weighted)" for c in range(3)]
OBJECTIVE_STAGES = [*GIVEN_STAGES, ("weighted", """
SELECT p.*, n.cw FROM predicted p JOIN (
  SELECT star_label, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS cw FROM predicted GROUP BY star_label) n
  ON p.star_label = n.star_label"""),
    ("reg", "SELECT 1 / (2.0::DOUBLE * sum(cw)) AS lam, sum(cw) AS w FROM weighted"),
    ("resid", f"SELECT *, {', '.join(f'{r} AS r{c}' for c, r in enumerate(RESID))} FROM weighted"),
    ("by_term", f"""
SELECT {', '.join(f'sum(weight * r{c}) + max((SELECT lam FROM reg) * {b}) AS g{c}' for c, b in enumerate(TERM_B))},
       {', '.join(f'max({b}) AS b{c}' for c, b in enumerate(TERM_B))}
FROM tfidf JOIN resid USING (review_id) GROUP BY term_index"""),
    ("small", "SELECT " + ", ".join(
        [f"sum(r{c} * {k}) + {v[c]}::DOUBLE * (SELECT lam FROM reg) AS {k}{c}" for k, v in GIVEN_DENSE.items() for c in range(3)]
        + [f"sum(r{c}) AS i{c}" for c in range(3)]) + " FROM resid")]
SMALL = [f"{k}{c}" for k in GIVEN_DENSE for c in range(3)] + ["i0", "i1", "i2"]


@register("j5_objective_given", audit_sql(f"""
SELECT round((SELECT sum(cw * -ln(CASE star_label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) FROM weighted) / w
             + lam / 2 * ((SELECT sum(b0 * b0 + b1 * b1 + b2 * b2) FROM by_term) + {sum(x * x for v in GIVEN_DENSE.values() for x in v)}::DOUBLE), 6)
         AS objective,
       round(sqrt((SELECT sum(g0 * g0 + g1 * g1 + g2 * g2) FROM by_term) + (SELECT {' + '.join(f'{x} * {x}' for x in SMALL)} FROM small)), 6)
         AS gradient_norm
FROM reg""", more=OBJECTIVE_STAGES))
def j5_objective_given(spark, sf):
    """Objective and gradient of J5 at given coefficients."""
    df = pin_rows(add_class_weight(audited(spark, sf)).select("review_id", "star_label", "class_weight", "text", *md.LEX_FEATURES))
    weights, _, _ = ft.tfidf_table(df, packed=True)
    b = [(((F.col("term_index") + 3 * c) % 7 - 3) / F.lit(4.0)).alias(f"b{c}") for c in range(3)]
    at = sm.logistic_at(ft.numbered(weights), df, weights.ranked().select(weights.number().alias("term"), *b), GIVEN_INTERCEPTS,
                        GIVEN_DENSE, sample_weight="class_weight")
    return rounded(spark.createDataFrame([at], "objective double, gradient_norm double"))


@register("j5_fit_table", audit_sql("""
SELECT (SELECT count(*) FROM splits WHERE split = 'train') AS n_docs, (SELECT count(*) FROM train_vocab) AS n_terms, true AS reached""",
                                    more=TRAIN_STAGES))
def j5_fit_table(spark, sf):
    """J5 on tables over the train split; reached: the gradient at the returned
    coefficients, computed anew, is within the tolerance of that at zero."""
    train = _split(spark, sf).filter(F.col("split") == "train")
    train = pin_rows(add_class_weight(train).select("review_id", "star_label", "class_weight", "text", *md.LEX_FEATURES))
    weights, _, n_docs = ft.tfidf_table(train, packed=True)
    weights = ft.numbered(weights)
    fit = sm.fit_logistic(weights, train, md.LEX_FEATURES, sample_weight="class_weight", tol=1e-2, memory=4)
    _, norm = sm.logistic_at(weights, train, fit.coefficients, fit.intercepts, fit.dense, sample_weight="class_weight")
    return spark.createDataFrame([(n_docs, fit.coefficients.count(), norm <= 1.01e-2 * fit.start_norm)],
                                 "n_docs long, n_terms long, reached boolean")


@register("j7_score_reviews_scorer", audit_sql("""
SELECT review_id, text, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 'Negative' WHEN e1 >= e2 THEN 'Neutral' ELSE 'Positive' END AS model_sentiment,
       round(greatest(e0, e1, e2) / (e0 + e1 + e2), 6) AS model_confidence, round(e0 / (e0 + e1 + e2), 6) AS prob_negative,
       round(e1 / (e0 + e1 + e2), 6) AS prob_neutral, round(e2 / (e0 + e1 + e2), 6) AS prob_positive,
       lex_neg, lex_neu, lex_pos, lex_compound
FROM (SELECT *, exp(length(text) % 7 / 4.0::DOUBLE) AS e0, exp(length(text) % 5 / 4.0::DOUBLE) AS e1,
             exp(length(text) % 3 / 2.0::DOUBLE) AS e2 FROM scored) s""", upto="scored"))
def j7_score_reviews_scorer(spark, sf):
    """Batch inference through a given scorer, made once per worker."""
    df = scored_reviews(fx.reviews_raw(spark, sf), fx.lexicon(spark))
    return rounded(md.score_reviews(df, make_scorer=length_scorer, name="length"))


@register("j5_fit_sentiment_lr")
def j5_fit_sentiment_lr(spark, sf):
    _, model, _ = _model(spark, sf)
    rows = [(c, int(model.n_features), float(b)) for c, b in enumerate(model.intercepts)]
    return spark.createDataFrame(rows, "cls int, n_coefficients int, intercept double")


@register("j6_predict")
def j6_predict(spark, sf):
    df, model, featurize = _model(spark, sf)
    held = featurize(df.filter(F.col("split") != "train")).select("review_id", "split", "star_label", "features")
    out = md.predict(model, held)
    return out.select("review_id", "split", "star_label", "pred_label", "pred_confidence",
                      "prob_negative", "prob_neutral", "prob_positive")


@register("j7_score_reviews")
def j7_score_reviews(spark, sf):
    df, model, featurize = _model(spark, sf)
    return md.score_reviews(df, model=model, featurize=featurize)


def _embeddings(spark, sf):
    return md.to_vector(fx.table(spark, sf, "embeddings"), "embedding")


@register("j8_kmeans")
def j8_kmeans(spark, sf):
    _, assigned = md.kmeans(_embeddings(spark, sf), k=10)
    return assigned.select("vec_id", "label", "cluster")


def _review_weights(spark, sf):
    docs = clean_reviews(fx.reviews_raw(spark, sf)).select("review_id", "cluster_name", "text")
    weights, _, _ = ft.tfidf_table(docs, packed=True)
    return docs, weights


@register("j8_kmeans_tfidf")
def j8_kmeans_tfidf(spark, sf):
    """K-Means by cosine over the TF-IDF rows of the cleaned reviews."""
    _, weights = _review_weights(spark, sf)
    return sm.spherical_kmeans(weights, [6]).of(6, "review_id")


@register("j9_elbow_tfidf")
def j9_elbow_tfidf(spark, sf):
    """Cost of several k from the same scans."""
    _, weights = _review_weights(spark, sf)
    return sm.elbow_table(spark, sm.spherical_kmeans(weights, [2, 4, 6]))


# The centres given: unit vectors along the sum of each cluster name's reviews.
COSINE_STAGES = [*TEXT_STAGES, ("sums", """
SELECT cluster_name, CAST(dense_rank() OVER (ORDER BY cluster_name) - 1 AS INTEGER) AS j, term, s FROM (
  SELECT c.cluster_name, t.term, sum(t.weight) AS s FROM tfidf t JOIN clean c ON t.review_id = c.review_id
  WHERE c.cluster_name IS NOT NULL GROUP BY 1, 2) x"""),
    ("centres", "SELECT j, term, s / sqrt(sum(s * s) OVER (PARTITION BY j)) AS w FROM sums"),
    ("sims", "SELECT t.review_id, j, sum(t.weight * w) AS sim FROM tfidf t JOIN centres USING (term) GROUP BY 1, 2"),
    ("nearest", """
SELECT d.review_id, coalesce(first(s.j ORDER BY s.sim DESC, s.j), 0) AS cluster, coalesce(max(s.sim), 0) AS similarity
FROM (SELECT DISTINCT review_id FROM tfidf) d LEFT JOIN sims s ON d.review_id = s.review_id GROUP BY d.review_id""")]


@register("j8_lloyd_given", audit_sql("""
SELECT n.review_id, n.cluster, round(n.similarity, 6) AS similarity, round(c.norm, 6) AS centre_norm
FROM nearest n JOIN (SELECT cluster, sqrt(sum(s * s)) AS norm FROM (
  SELECT n.cluster, t.term, sum(t.weight) AS s FROM tfidf t JOIN nearest n ON t.review_id = n.review_id GROUP BY 1, 2) x
  GROUP BY cluster) c ON n.cluster = c.cluster""", upto="clean", more=COSINE_STAGES))
def j8_lloyd_given(spark, sf):
    """One step from given centres: assignment, similarity, length of the new centre's sum."""
    docs, weights = _review_weights(spark, sf)
    names, _, sums = sm.cluster_sums(weights, docs)
    norms = sums.agg(*[F.sqrt(F.sum(F.col("s")[j] * F.col("s")[j])).alias(f"n{j}") for j in range(len(names))]).first()
    w = sums.select("term", F.array(*[F.col("s")[j] / F.lit(norms[j]) for j in range(len(names))]).alias("__c"))
    nearest, new = sm.lloyd_step(weights, w, [len(names)])
    lengths = new.select(F.posexplode("__n").alias("cluster", "s")).groupBy("cluster").agg(
        F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("centre_norm"))
    out = nearest.select("review_id", F.col("cl")[0].alias("cluster"), F.col("best")[0].alias("similarity"))
    return rounded(out.join(lengths, "cluster").select("review_id", "cluster", "similarity", "centre_norm"))


@register("j10_silhouette_tfidf_given", audit_sql("""
SELECT review_id, cluster_name, round(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette
FROM (SELECT c.review_id, c.cluster_name,
             max(CASE WHEN c.cluster_name = z.cluster_name AND z.n > 1
                      THEN (z.n - coalesce(d.dot, 0) - (1 - coalesce(q.norm, 0))) / (z.n - 1) END) AS a,
             min(CASE WHEN c.cluster_name <> z.cluster_name THEN 1 - coalesce(d.dot, 0) / z.n END) AS b
      FROM clean c CROSS JOIN (SELECT cluster_name, count(*) AS n FROM clean WHERE cluster_name IS NOT NULL GROUP BY 1) z
      LEFT JOIN (SELECT t.review_id, s.cluster_name, sum(t.weight * s.s) AS dot FROM tfidf t JOIN sums s USING (term) GROUP BY 1, 2) d
        ON d.review_id = c.review_id AND d.cluster_name = z.cluster_name
      LEFT JOIN (SELECT review_id, sum(weight * weight) AS norm FROM tfidf GROUP BY 1) q ON q.review_id = c.review_id
      WHERE c.cluster_name IS NOT NULL GROUP BY 1, 2) x""", upto="clean", more=COSINE_STAGES[:-3]))
def j10_silhouette_tfidf_given(spark, sf):
    docs, weights = _review_weights(spark, sf)
    return rounded(sm.cosine_silhouette(weights, docs, cluster="cluster_name"))


@register("j9_elbow")
def j9_elbow(spark, sf):
    return md.elbow(_embeddings(spark, sf), [2, 4, 6, 8, 10])


@register("j10_silhouette")
def j10_silhouette(spark, sf):
    _, assigned = md.kmeans(_embeddings(spark, sf), k=10)
    return spark.createDataFrame([(10, md.silhouette(assigned))], "k int, silhouette double")


# The centroids given: the mean vector of each label, in label order.
CENTROID_STAGES = [
    ("centroids", """
SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster, pos, avg(CAST(v AS DOUBLE)) AS c
FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) e GROUP BY label, pos"""),
    ("vectors", "SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings"),
    ("distances", """
SELECT vec_id, cluster, sum((v - c) * (v - c)) AS d FROM vectors JOIN centroids USING (pos) GROUP BY vec_id, cluster"""),
    ("assigned", "SELECT vec_id, arg_min(cluster, d) AS cluster, min(d) AS cost FROM distances GROUP BY vec_id")]


def _centroids(spark, sf) -> list[list[float]]:
    """One mean vector per label (rows of the plan, not of the data)."""
    rows = (fx.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
              .groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("c"))
              .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("cs")).orderBy("label").collect())
    return [[x.c for x in r.cs] for r in rows]


@register("j8_assign_given", fx.with_views("SELECT vec_id, cluster, round(cost, 6) AS cost FROM assigned", extra=CENTROID_STAGES))
def j8_assign_given(spark, sf):
    out = md.nearest_centroid(fx.table(spark, sf, "embeddings"), _centroids(spark, sf))
    return rounded(out.select("vec_id", "cluster", "cost"))


@register("j9_cost_given", fx.with_views("""
SELECT k, round(sum(d), 6) AS cost FROM (
  SELECT k, vec_id, min(d) AS d FROM distances JOIN (SELECT unnest([2, 4, 6, 8, 10]) AS k) ks ON cluster < k GROUP BY k, vec_id) t
GROUP BY k""", extra=CENTROID_STAGES))
def j9_cost_given(spark, sf):
    """Cost of the first k centroids, for each k in one scan."""
    centers, ks = _centroids(spark, sf), [2, 4, 6, 8, 10]
    df = fx.table(spark, sf, "embeddings").select("embedding")
    for k in ks:
        df = md.nearest_centroid(df, centers[:k]).withColumnRenamed("cost", f"c{k}").drop("cluster")
    sums = df.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in ks])
    return rounded(sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("cost")) for k in ks]))
                                .alias("x")).select("x.*"))


@register("j10_silhouette_given", fx.with_views("""
SELECT 10 AS k, round(avg(CASE WHEN n_own = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette
FROM (SELECT vec_id, max(n) FILTER (own) AS n_own, max(m * n / (n - 1)) FILTER (own AND n > 1) AS a, min(m) FILTER (NOT own) AS b
  FROM (SELECT x.vec_id, x.cluster = s.cluster AS own, s.n, x.norm + s.psi / s.n - 2 * x.dot / s.n AS m
    FROM (SELECT v.vec_id, a.cluster, y.cluster AS other, sum(v.v * v.v) AS norm, sum(v.v * y.y) AS dot
          FROM vectors v JOIN assigned a USING (vec_id)
          JOIN (SELECT cluster, pos, sum(v::DOUBLE) AS y FROM vectors JOIN assigned USING (vec_id) GROUP BY cluster, pos) y
            ON v.pos = y.pos GROUP BY v.vec_id, a.cluster, y.cluster) x
    JOIN (SELECT cluster, count(DISTINCT vec_id) AS n, sum(v::DOUBLE * v) AS psi FROM vectors JOIN assigned USING (vec_id)
          GROUP BY cluster) s ON x.other = s.cluster) r GROUP BY vec_id) t""".replace("x.cluster = s.cluster", "x.cluster = x.other"),
    extra=CENTROID_STAGES))
def j10_silhouette_given(spark, sf):
    out = md.nearest_centroid(fx.table(spark, sf, "embeddings"), _centroids(spark, sf))
    return rounded(spark.createDataFrame([(10, md.silhouette(md.to_vector(out, "embedding")))], "k int, silhouette double"))


@register("j8_product_catalogue")
def j8_product_catalogue(spark, sf):
    """Products clustered by their reviews' words, named, written and read as a catalogue."""
    return rounded(product_catalogue(clean_reviews(fx.reviews_raw(spark, sf)), 3, scratch_dir(spark, "catalogue")))
