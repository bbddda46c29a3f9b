"""TF-IDF in packed form: the same figures as the long table has."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlens.operators import features as ft
from starlens.operators import packed as pk


@pytest.fixture(scope="module")
def texts(spark):
    """Repeated and absent keys, empty texts, other scripts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["été", "한국어", "aa"]
    rows = [(i % 190, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), "xyz"[i % 3]) for i in range(200)]
    rows += [(None, "w1 w2 w3", "x"), (500, None, "y"), (501, "", None), (502, "aa", None)]
    return spark.createDataFrame(rows, "review_id int, text string, cluster_name string").repartition(3).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_and_texts_in_few_bytes():
    import pyarrow as pa
    for a in ([], [0], [255, 0], [256], [1 << 16, 3], [1 << 33], [-1, 5]):
        assert pk.spread(pk.squeezed(np.array(a, np.int64))).tolist() == a
    for s in ([], [""], ["a", "", "été b"], ["x" * 70000]):
        assert pk.spread_text(pk.squeezed_text(pa.array(s, pa.string()))).to_pylist() == s
    assert pk.spread_text(pk.squeezed_text(pa.array(["a", "bb", "c"]).slice(1, 1))).to_pylist() == ["bb"]
    assert len(pk.squeezed(np.ones(10000, np.int64))) < 100


@pytest.mark.parametrize("at_once", [40, 1 << 19])
def test_packed_weights_are_those_of_the_long_table(spark, texts, at_once):
    """J1-J3 without an exchange of terms by document, in one chunk a partition or many."""
    tf, n = ft.counted_terms(texts)
    vocab = ft.vocabulary(tf, n)
    packed = pk.packed_terms(ft.document_terms(texts), "review_id", 5, at_once=at_once)
    assert packed.n_docs == n and sorted(packed.ranked().select(*vocab.columns).collect()) == sorted(vocab.collect())
    rows = lambda df: sorted((str(r.review_id), r.term_index, round(r.weight, 10)) for r in df.collect())
    assert rows(packed.rows()) == rows(ft.tfidf(tf, vocab, n)) == rows(packed.rows(spell=False))
    names = {r.term_index: r.term for r in vocab.collect()}
    assert all(names[r.term_index] == r.term for r in packed.rows().collect())
    out, _, _ = ft.tfidf_table(texts)
    assert out.columns == ["review_id", "term", "term_index", "weight"]
    assert "hashpartitioning(term" not in plan(out) and "Window" not in plan(out)


def test_no_document_or_no_term(spark, texts):
    for df in (texts.limit(0), texts.filter("text = ''")):
        w, vocab, n = ft.tfidf_table(df)
        assert (w.count(), vocab.count(), n) == (0, 0, df.count())


@pytest.fixture(scope="module")
def own_keys(spark, texts):
    """Every document with a key of its own."""
    return texts.filter("review_id is not null").dropDuplicates(["review_id"]).cache()


def both(df):
    """Packed weights, and the long table with the same numbers of terms."""
    packed, _, _ = ft.tfidf_table(df, packed=True)
    return packed, packed.numbered().cache()


def near(a, b):
    return len(a) == len(b) and all(x == y if not isinstance(x, float) else abs(x - y) < 1e-9 for p, q in zip(a, b) for x, y in zip(p, q))


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(round(c, 6) if isinstance(c, float) else str(c) for c in r))


@pytest.mark.parametrize("repeated", [False, True])
def test_objective_of_packed_weights(spark, texts, own_keys, repeated):
    """the same objective and gradient as from the long table, rows of one key and rows without included."""
    from starlens.operators import sparse_models as sm
    df = texts if repeated else own_keys
    docs = df.select("review_id", F.pmod(F.hash("text"), F.lit(3)).alias("star_label"), (F.length("text") / 50).alias("u"))
    packed, table = both(df)
    assert packed.keyed() != repeated
    b = packed.vocabulary().select(packed.number().alias("term"), *[((F.col("df") + c) % 5 / 4.0 - 0.5).alias(f"b{c}") for c in range(3)])
    at = [sm.logistic_at(w, docs, b, [0.1, 0.0, -0.1], {"u": [0.2, 0.0, -0.3]}, n_terms=n)
          for w, n in ((packed, None), (table, packed.n_numbers()))]
    assert np.allclose(at[0], at[1], atol=1e-10)


def test_dense_columns_do_not_slow_the_fit(spark, own_keys):
    """A column that all documents have, as good as constant, took hundreds of steps."""
    from starlens.operators import sparse_models as sm
    docs = own_keys.select("review_id", F.pmod(F.hash("text"), F.lit(3)).alias("star_label"),
                           (F.lit(5.0) + F.pmod(F.hash("review_id"), F.lit(7)) / 100).alias("u"))
    packed, _ = both(own_keys)
    fit = sm.fit_logistic(packed, docs, ("u",), tol=1e-2)
    assert fit.converged and fit.iterations < 15
    again = sm.logistic_at(packed, docs, fit.coefficients, fit.intercepts, fit.dense)
    assert abs(again[0] - fit.objective) < 1e-8 and abs(again[1] - fit.gradient_norm) < 1e-8


@pytest.mark.parametrize("repeated", [False, True])
def test_clusters_of_packed_weights(spark, texts, own_keys, repeated):
    """K-Means, a step of it and silhouettes are those of the long table."""
    from starlens.operators import sparse_models as sm
    df = texts if repeated else own_keys
    packed, table = both(df)
    fits = [sm.spherical_kmeans(w, [2, 4], max_iter=5) for w in (packed, table)]
    assert sorted_rows(fits[0].assignments) == sorted_rows(fits[1].assignments)
    assert [r["iterations"] for r in fits[0].report] == [r["iterations"] for r in fits[1].report]
    assert np.allclose([r["cost"] for r in fits[0].report], [r["cost"] for r in fits[1].report])
    names, counts, sums = sm.cluster_sums(packed, df)
    assert names == ["x", "y", "z"] and sum(counts) == df.filter("cluster_name is not null").count()
    want = table.join(df, "review_id").filter("cluster_name = 'y'").groupBy("term").agg(F.sum("weight")).filter("term is not null")
    assert near(sorted_rows(sums.select("term", F.col("s")[1]).filter("s[1] > 0")), sorted_rows(want))
    steps = [sm.lloyd_step(w, sums.select("term", F.col("s").alias("__c")), [3]) for w in (packed, table)]
    assert near(sorted_rows(steps[0][1].selectExpr("term", "__n[0]", "__n[2]")), sorted_rows(steps[1][1].selectExpr("term", "__n[0]", "__n[2]")))
    assert near(sorted_rows(steps[0][0].selectExpr("review_id", "cl[0]", "best[0]")), sorted_rows(steps[1][0].selectExpr("review_id", "cl[0]", "best[0]")))
    far = [sm.cosine_silhouette(w, df, cluster="cluster_name") for w in (packed, table)]
    assert near(sorted_rows(far[0]), sorted_rows(far[1]))


@pytest.mark.parametrize("repeated", [False, True])
def test_keywords_and_predictions_of_packed_weights(spark, texts, own_keys, repeated):
    """keywords, ties by term, and probabilities as from the long table."""
    from starlens.operators import models as md
    df = texts if repeated else own_keys
    packed, vocab, _ = ft.tfidf_table(df, packed=True)
    long, v, _ = ft.tfidf_table(df)
    quick = ft.spelled(ft.cluster_keywords(ft.numbered(packed), df, 4), vocab, packed.number())
    plain = ft.cluster_keywords(long, df, 4)
    cols = ["cluster_name", "term", "rank", "mean_weight"]
    assert quick.columns == ["cluster_name", "term", "mean_weight", "rank"]
    assert near(sorted_rows(quick.select(*cols)), sorted_rows(plain.select(*cols))) and quick.count() == 12
    b = [((F.col("df") + c) % 3 - 1.0).alias(f"b{c}") for c in range(3)]
    docs = df.withColumn("lex_pos", F.length("text") / 100)
    out = [md.linear_predict(w, c, [0.1, 0.0, -0.1], docs, dense={"lex_pos": [0.2, 0.0, -0.2]}) for w, c in (
        (packed, vocab.select(packed.number().alias("term"), *b)), (long, v.select("term", *b)))]
    cols = ["review_id", "text", "pred_label", "prob_negative", "prob_positive"]
    assert near(sorted_rows(out[0].select(*cols)), sorted_rows(out[1].select(*cols))) and out[0].count() == df.count()


@pytest.mark.parametrize("repeated", [False, True])
def test_vectors_of_packed_weights(spark, texts, own_keys, repeated):
    """vectors by the train rows' vocabulary, without collecting rows of entries, and as they were."""
    from starlens.operators import models as md
    from starlens.plans.audit import tfidf_featurizer
    df = (texts if repeated else own_keys).select("review_id", "text", F.when(F.length("text") % 4 == 0, "test").otherwise("train").alias("split"),
                                                  *[F.lit(0.5).alias(c) for c in md.LEX_FEATURES])
    featurize, train = tfidf_featurizer(df)
    tf, n = ft.counted_terms(train)
    vocab = ft.vocabulary(tf, n).cache()
    weights = ft.tfidf(ft.term_frequencies(ft.document_terms(df)), vocab, n)
    rows = lambda d: sorted((str(r.review_id), r.features.size, r.features.indices.tolist(), [round(v, 9) for v in r.features.values])
                            for r in d.collect())
    assert rows(featurize(df)) == rows(md.assemble(df, weights, vocab.count()))
