"""Models (J4-J10): feature vectors, logistic regression on their entries (the
fit of ``sparse_models``), batch scoring; K-Means, elbow and silhouette on MLlib
estimators (distributed iterative fits; MLlib caches its own training input).

The only Python on the row path is the optional user scorer in ``score_reviews``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions.labels import DEFAULT_THRESHOLD, label_name, softmax, threshold_label
from starlens.functions.text import clip
from starlens.operators.audit import add_class_weight
from starlens.operators.features import near_table
from starlens.operators.packed import Packed
from starlens.operators.sparse_models import LinearFit, fit_logistic, products_by_key
from starlens.session import cut_lineage, pin_rows

LEX_FEATURES = ("lex_neg", "lex_neu", "lex_pos", "lex_compound")


def assemble(docs: DataFrame, weights: DataFrame | Packed, vocab_size: int, key: str = "review_id",
             dense_cols: tuple[str, ...] = LEX_FEATURES) -> DataFrame:
    """Text vector (term_index -> weight) followed by the dense polarity
    columns, as one sparse ``features`` vector per document. Weights of a term
    that a repeated key has several times are added up. ``weights`` may be packed if all keys differ.

    SQL has no constructor of a vector, but Parquet holds one as its fields: the
    rows are pinned with these and read again as vectors, without Python."""
    if isinstance(weights, Packed):
        per_doc = weights.vectors("__tw")
    else:
        per_doc = (weights.groupBy(key, "term_index").agg(F.sum("weight").alias("weight")).groupBy(key)
                          .agg(F.sort_array(F.collect_list(F.struct(F.col("term_index").cast("int").alias("i"),
                                                                    F.col("weight").cast("double").alias("w")))).alias("__tw")))
    k = len(dense_cols)
    out = docs.join(per_doc, key, "left")
    tw = F.coalesce(F.col("__tw"), F.array().cast("array<struct<i:int,w:double>>"))
    idx = F.concat(tw["i"], F.array(*[F.lit(vocab_size + i) for i in range(k)]).cast("array<int>"))
    val = F.concat(tw["w"], F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in dense_cols]).cast("array<double>"))
    fields = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(vocab_size + k).alias("size"), idx.alias("indices"), val.alias("values"))
    return pin_rows(out.withColumn("features", fields).drop("__tw"), features=VectorUDT())


def sparse_parts(col: str) -> dict[str, Column]:
    """Size and stored indices and values of a vector column, read from its
    fields; a sparse vector is never made dense."""
    v = F.unwrap_udt(F.col(col))
    every = F.when(F.size(v["values"]) > 0, F.sequence(F.lit(0), F.size(v["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    return {"size": F.coalesce(v["size"], F.size(v["values"])), "values": v["values"], "indices": F.coalesce(v["indices"], every)}


@dataclass
class LinearModel:
    """``coefficients`` (term: place in the vector, b0, b1, ...; places that no document of the fit has are 0)."""
    n_features: int
    coefficients: DataFrame
    intercepts: list[float]
    fit: LinearFit


def _entries(rows: DataFrame, features: str) -> DataFrame:
    """(__at, term, weight) of the stored values of every row's vector."""
    v = sparse_parts(features)
    return rows.select("__at", F.explode(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("w"))).alias("e")).select(
        "__at", F.col("e.i").alias("term"), F.col("e.w").alias("weight"))


def fit_sentiment_lr(train: DataFrame, features: str = "features", label: str = "star_label",
                     C: float = 2.0, max_iter: int = 2000, tol: float = 1e-4, dense: int = 0) -> LinearModel:
    """L2 multinomial logistic regression with balanced class weights.

    The penalised objective ``C * sum_i w_i loss_i + 0.5 ||b||^2`` equals
    ``(1/sum w) sum_i w_i loss_i + (lambda/2) ||b||^2`` with
    ``lambda = 1 / (C * sum w)``; no standardisation, intercept unpenalised. The
    vectors' entries are fitted on tables, by MLlib's rule of when to stop: its
    own fit holds vectors of the vocabulary's size in the driver. ``dense``:
    so many places at the end that (nearly) every vector has; they are fitted
    as columns of their own, which takes far fewer steps to the same optimum."""
    weighted = add_class_weight(train, label)
    rows = pin_rows(weighted.select(F.monotonically_increasing_id().alias("__at"), F.col(label).cast("int").alias(label),
                                    "class_weight", features))
    parts = sparse_parts(features)
    seen = rows.agg(F.max(label).alias("label"), F.max(parts["size"]).alias("size")).first()
    columns = [f"__d{j}" for j in range(dense)]
    at = {c: F.array_position(parts["indices"], (parts["size"] - dense + j).cast("int")).cast("int") for j, c in enumerate(columns)}
    docs = rows.select("__at", label, "class_weight", *[
        F.when(i > 0, F.get(parts["values"], i - 1)).otherwise(0.0).alias(c) for c, i in at.items()])
    entries = _entries(rows, features).filter(F.col("term") < F.lit(seen.size - dense))
    fit = fit_logistic(entries, docs, tuple(columns), key="__at", label=label, sample_weight="class_weight", classes=seen.label + 1,
                       C=C, tol=tol, max_iter=max_iter, memory=10, n_terms=seen.size - dense, by_value=True)
    coefficients = fit.coefficients
    if dense:
        more = [(seen.size - dense + j, *map(float, fit.dense[c])) for j, c in enumerate(columns)]
        coefficients = cut_lineage(coefficients.unionByName(coefficients.sparkSession.createDataFrame(more, coefficients.schema)))
    return LinearModel(seen.size, coefficients, fit.intercepts, fit)


def predict(model: LinearModel, df: DataFrame, features: str = "features") -> DataFrame:
    """Predicted label and class probabilities as plain columns. Rows are
    pinned with a number each, so that repeated keys stay rows of their own."""
    rows = pin_rows(df.withColumn("__at", F.monotonically_increasing_id()))
    near = near_table(model.coefficients, len(model.intercepts))
    return linear_predict(_entries(rows, features), near, model.intercepts, rows, key="__at").drop("__at")


def linear_predict(weights: DataFrame | Packed, coefficients: DataFrame, intercepts: list[float],
                   docs: DataFrame, key: str = "review_id", dense: dict[str, list[float]] | None = None) -> DataFrame:
    """J6 on the long table: ``weights`` (key, term, weight) meet
    ``coefficients`` (term, b0, b1, b2), one row per term; the products are
    summed per document map-side first, ``dense`` columns of ``docs`` are added,
    and the softmax gives the class probabilities. ``docs`` with
    pred_label, prob_* and pred_confidence.

    Weights before the norm, (key, __row, term, w) of ``raw_tfidf``, lie by term
    still, so the join deals out coefficients only; sums and norm of a document
    then come from the one exchange of term rows by key. Of packed weights, only
    sums by document leave a bucket of terms; ``coefficients`` go by their numbers."""
    b = [f"b{c}" for c in range(len(intercepts))]
    if isinstance(weights, Packed):
        by_key = products_by_key(weights, coefficients, b, key)
        sums = by_key.groupBy(key).agg(*[F.sum(x).alias(f"__{x}") for x in b])
    elif "__row" in weights.columns:
        own = weights.join(coefficients.select("term", *b), "term").select(key, "__row", "w", *b).repartition(F.col(key))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
        rows = own.groupBy(key, "__row").agg(*[(F.sum(F.col("w") * F.col(x)) / norm).alias(f"__{x}") for x in b])
        sums = rows.groupBy(key).agg(*[F.sum(f"__{x}").alias(f"__{x}") for x in b])
    else:
        sums = (weights.select(key, "term", "weight").join(coefficients.select("term", *b), "term").groupBy(key)
                       .agg(*[F.sum(F.col("weight") * F.col(x)).alias(f"__{x}") for x in b]))
    z = []
    for c, x in enumerate(b):
        extra = F.lit(0.0)
        for name, value in (dense or {}).items():
            extra = extra + F.col(name) * F.lit(float(value[c]))
        z.append(F.coalesce(F.col(f"__{x}"), F.lit(0.0)) + extra + F.lit(float(intercepts[c])))
    p = F.col("__p")
    out = docs.join(sums, key, "left").withColumn("__p", softmax(F.array(*z)))
    best = F.array_position(p, F.array_max(p))
    return (out.withColumn("pred_label", (best - 1).cast("int"))
               .withColumn("prob_negative", p[0]).withColumn("prob_neutral", p[1])
               .withColumn("prob_positive", p[2]).withColumn("pred_confidence", F.array_max(p))
               .drop("__p", *[f"__{x}" for x in b]))


def nearest_centroid(df: DataFrame, centroids: list[list[float]], vector: str = "embedding") -> DataFrame:
    """J8 for given centroids: ``cluster`` (least index of the nearest) and
    ``cost`` (squared distance). The k centroids are literals of the plan, so
    rows stay where they are."""
    x = F.col(vector)

    def distance(c):
        point = F.array(*[F.lit(float(v)) for v in c])
        return F.aggregate(F.zip_with(x, point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    out = df.withColumn("__d", F.array(*[distance(c) for c in centroids]))
    return (out.withColumn("cost", F.array_min("__d"))
               .withColumn("cluster", (F.array_position("__d", F.array_min("__d")) - 1).cast("int")).drop("__d"))


SCORE_COLUMNS = ("model_sentiment string, model_confidence double, "
                 "prob_negative double, prob_neutral double, prob_positive double")


#: Scorers made in this Python worker, by name; a worker serves many tasks.
_SCORERS: dict = {}


def score_reviews(df: DataFrame, scorer: Callable | None = None, model=None, featurize=None,
                  key: str = "review_id", text: str = "text", max_chars: int | None = None,
                  make_scorer: Callable | None = None, name: str = "scorer") -> DataFrame:
    """Batch inference table.

    ``scorer`` is a pluggable Python function ``list[str] -> n x 3 array of
    probabilities`` run with ``mapInPandas`` (Arrow batches); ``make_scorer``
    makes one, for a model that is loaded once per Python worker and ``name``
    instead of being sent with every task. Otherwise the fitted ``model``
    (J5) scores JVM-side on ``featurize(df)``. Whole texts are scored;
    ``max_chars`` clips them as a serving path may. Null texts are scored as
    empty ones. Polarity columns are carried along when present."""
    lex = [c for c in LEX_FEATURES if c in df.columns]
    clipped = df.withColumn(text, clip(F.col(text), max_chars, ellipsis=False)) if max_chars else df
    if scorer is None and make_scorer is None:
        feats = featurize(clipped) if featurize else clipped
        return predict(model, feats).select(
            key, text, label_name("pred_label").alias("model_sentiment"),
            F.col("pred_confidence").alias("model_confidence"),
            "prob_negative", "prob_neutral", "prob_positive", *lex)
    import numpy as np

    names = np.array(["Negative", "Neutral", "Positive"])

    def run(batches):
        score = scorer
        if score is None:
            if name not in _SCORERS:
                _SCORERS[name] = make_scorer()
            score = _SCORERS[name]
        for pdf in batches:
            if not len(pdf):
                continue
            probs = np.asarray(score(pdf[text].fillna("").tolist()), dtype=float).reshape(-1, 3)
            yield pdf.assign(model_sentiment=names[probs.argmax(axis=1)], model_confidence=probs.max(axis=1),
                             prob_negative=probs[:, 0], prob_neutral=probs[:, 1], prob_positive=probs[:, 2])

    carried = clipped.select(key, text, *lex)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    return carried.mapInPandas(run, f"{schema}, {SCORE_COLUMNS}").select(
        key, text, *[c.split()[0] for c in SCORE_COLUMNS.split(", ")], *lex)


def lexicon_scorer_probs(compound) -> "F.Column":
    """Default offline probabilities from a compound score: softmax of
    (-c, 0, c) (used where no trained model is given)."""
    from starlens.functions.labels import softmax
    return softmax(F.array(-compound, F.lit(0.0), compound))


def to_vector(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    """array<float|double> column -> MLlib dense vector (JVM-side)."""
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def kmeans(df: DataFrame, k: int, seed: int = 42, features: str = "features",
           max_iter: int = 500):
    """K-Means on any vector column, run until the centres move by less
    than its tolerance; returns (model, assignments). ``model.summary.numIter``
    equal to ``max_iter`` says that it stopped before that."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster",
                   maxIter=max_iter).fit(df)
    return model, model.transform(df)


def elbow(df: DataFrame, ks: list[int], seed: int = 42, features: str = "features") -> DataFrame:
    """Within-cluster cost (sum of squared distances) for each k, with the
    iterations of the fit and whether it converged; one distributed fit per k,
    one small result row per k."""
    rows = []
    for k in ks:
        model, _ = kmeans(df, k, seed, features)
        done = model.summary
        rows.append((k, float(done.trainingCost), int(done.numIter), done.numIter < model.getMaxIter()))
    return df.sparkSession.createDataFrame(rows, "k int, cost double, iterations int, converged boolean")


def silhouette(assignments: DataFrame, features: str = "features",
               prediction: str = "cluster") -> float:
    """Squared-Euclidean silhouette of a clustering."""
    ev = ClusteringEvaluator(featuresCol=features, predictionCol=prediction,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(assignments))


def lexicon_predictions(df: DataFrame, compound: str = "lex_compound") -> DataFrame:
    """Lexicon label as a model prediction (the 'lexicon' model of F23)."""
    return df.withColumn("pred_label", threshold_label(compound, DEFAULT_THRESHOLD))
