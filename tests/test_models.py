"""Models: the TF-IDF + LR baseline learns a separable toy set; K-Means and
silhouette invariants on the embeddings table."""

from pyspark.sql import functions as F

from starlens.operators import models as md
from starlens.plans.audit import tfidf_lr_model

from tables import SF_SMALL


def test_tfidf_lr_separable(spark):
    words = {0: "awful broken refund", 1: "average okay fine", 2: "excellent love perfect"}
    rows = [(i, words[i % 3] + f" filler{i % 7}", i % 3, 0.0, 1.0, 0.0, 0.0, "train")
            for i in range(60)]
    df = spark.createDataFrame(rows, "review_id long, text string, star_label int, lex_neg double, "
                                     "lex_neu double, lex_pos double, lex_compound double, split string")
    model, featurize = tfidf_lr_model(df)
    out = md.predict(model, featurize(df))
    r = out.agg(F.avg((F.col("pred_label") == F.col("star_label")).cast("double")).alias("acc"),
                F.max(F.abs(F.col("prob_negative") + F.col("prob_neutral") + F.col("prob_positive") - 1))
                .alias("err")).first()
    assert r.acc == 1.0 and r.err < 1e-9


def test_kmeans_and_silhouette(spark):
    emb = md.to_vector(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"), "embedding")
    model, assigned = md.kmeans(emb, k=4)
    assert assigned.select("cluster").distinct().count() == 4
    assert -1.0 <= md.silhouette(assigned) <= 1.0
    costs = [r.cost for r in md.elbow(emb, [2, 6]).orderBy("k").collect()]
    assert costs[0] >= costs[1]


def test_document_terms_count_as_terms_do(spark):
    from starlens.operators import features as ft
    df = spark.createDataFrame([(1, "a an An the an the"), (2, None), (3, ""), (4, "zz"), (5, "zz zz zz")],
                               "review_id int, text string")
    want = {(r.review_id, r.term): r["count"] for r in ft.terms(df).groupBy("review_id", "term").count().collect()}
    docs = ft.document_terms(df)
    got = {(r.review_id, r.term): r.tf for r in ft.term_frequencies(docs).collect()}
    assert got == want and got[(5, "zz zz")] == 2
    assert docs.count() == 5
    assert ft.counted_terms(df)[1] == 5


def test_predict_from_weights_before_their_norm(spark):
    """The same predictions as from unit rows, with one exchange of term rows after the vocabulary's join."""
    from starlens.operators import features as ft
    texts = ["aa bb cc", "bb cc", "aa aa dd", "dd cc bb aa", None, "zz", "aa bb"]
    df = spark.createDataFrame([(i % 6, t, 0.5 * i) for i, t in enumerate(texts)], "review_id int, text string, lex_pos double")
    unit, vocab, _ = ft.tfidf_table(df, max_df=1.0)
    raw, _, _ = ft.tfidf_table(df, max_df=1.0, norm=False)
    b = vocab.select("term", *[((F.col("term_index") + c) % 3 - 1.0).alias(f"b{c}") for c in range(3)])
    both = [md.linear_predict(w, b, [0.1, 0.0, -0.1], df, dense={"lex_pos": [0.2, 0.0, -0.2]}) for w in (unit, raw)]
    got = [sorted([(r.review_id, str(r.text), r.pred_label, round(r.prob_negative, 9), round(r.prob_positive, 9)) for r in d.collect()])
           for d in both]
    assert got[0] == got[1] and len(got[0]) == 7
    plan = both[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(review_id" in plan and "Window" not in plan


def test_vectors_are_built_and_read_without_python(spark):
    from pyspark.ml.linalg import Vectors
    docs = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.0)], "review_id int, lex_pos double")
    weights = spark.createDataFrame([(1, 3, 0.6), (1, 0, 0.5), (1, 0, 0.25), (3, 2, 1.0)], "review_id int, term_index long, weight double")
    out = md.assemble(docs, weights, 4, dense_cols=("lex_pos",))
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.review_id: r.features for r in out.collect()}
    assert got[1] == Vectors.sparse(5, [0, 3, 4], [0.75, 0.6, 0.5]) and got[3] == Vectors.sparse(5, [2, 4], [1.0, 0.0])
    both = spark.createDataFrame([(Vectors.dense(1.0, 0.0, 2.0),), (Vectors.sparse(4, {1: 3.0}),), (Vectors.sparse(2, {}),)], ["v"])
    parts = md.sparse_parts("v")
    assert [tuple(r) for r in both.select(parts["size"], parts["indices"], parts["values"]).collect()] == [
        (3, [0, 1, 2], [1.0, 0.0, 2.0]), (4, [1], [3.0]), (2, [], [])]


def test_fit_of_vectors_is_the_optimum_and_predicts_row_by_row(spark):
    """The gradient of the penalised loss is small at what the fit returns; equal keys stay rows of their own."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(80, 6)) * (rng.random((80, 6)) < 0.5), rng.integers(0, 3, 80)
    rows = [(i // 2, int(y[i]), Vectors.sparse(6, [(j, float(v)) for j, v in enumerate(x[i]) if v])) for i in range(80)]
    df = spark.createDataFrame(rows, ["review_id", "star_label", "features"])
    model = md.fit_sentiment_lr(df, tol=1e-6)
    b, b0 = np.zeros((6, 3)), np.array(model.intercepts)
    for r in model.coefficients.collect():
        b[r.term] = [r.b0, r.b1, r.b2]
    c = 80 / (3 * np.bincount(y))[y]
    z = x @ b + b0
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    r = c[:, None] / c.sum() * (p - np.eye(3)[y])
    assert model.n_features == 6 and model.fit.converged
    assert np.abs(x.T @ r + b / (2 * c.sum())).max() < 1e-3 and np.abs(r.sum(axis=0)).max() < 1e-3
    out = md.predict(model, df)
    assert set(out.columns) == {"review_id", "star_label", "features", "pred_label", "prob_negative", "prob_neutral",
                                "prob_positive", "pred_confidence"}
    got = sorted((q.review_id, round(q.prob_negative, 8), round(q.prob_positive, 8)) for q in out.collect())
    assert got == sorted((i // 2, round(float(p[i, 0]), 8), round(float(p[i, 2]), 8)) for i in range(80))
