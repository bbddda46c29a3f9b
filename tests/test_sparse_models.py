"""Models on the long table against numpy on the dense matrix."""

import numpy as np
import pytest

from starlens.operators import sparse_models as sm
from starlens.session import cut_lineage


def matrix(seed, n=60, terms=25, groups=3):
    """Unit rows with a few terms each, by group."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, terms))
    for i in range(n):
        own = np.arange(terms) % groups == i % groups
        pick = rng.choice(terms, 5, replace=False, p=np.where(own, 3.0, 1.0) / np.where(own, 3.0, 1.0).sum())
        x[i, pick] = rng.random(5) + 0.1
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def long(spark, x, skip=()):
    rows = [(i, f"t{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x)) if i not in skip]
    return cut_lineage(spark.createDataFrame([(int(i), t, w) for i, t, w in rows], "review_id long, term string, weight double"))


def loss_and_gradient(x, d, y, c, b, s, reg):
    z = x @ b + d @ s
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    pen = s[:-1]
    f = (c * -np.log(p[np.arange(len(y)), y])).sum() / c.sum() + reg / 2 * ((b * b).sum() + (pen * pen).sum())
    r = (p - np.eye(3)[y]) * c[:, None] / c.sum()
    gs = d.T @ r
    gs[:-1] += reg * pen
    return f, np.sqrt(((x.T @ r + reg * b) ** 2).sum() + (gs ** 2).sum())


def test_logistic(spark):
    x = matrix(1)
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(60, 2))
    y = (np.arange(60) % 3 + (rng.random(60) < 0.2)) % 3
    c = np.where(y == 0, 2.0, 0.5)
    weights = long(spark, x)
    docs = spark.createDataFrame([(i, int(y[i]), float(c[i]), *map(float, dense[i])) for i in range(60)] + [(99, None, 1.0, 0.0, 0.0)],
                                 "review_id long, star_label int, cw double, u double, v double")
    fit = sm.fit_logistic(weights, docs, ("u", "v"), sample_weight="cw", tol=2e-3, memory=4)
    assert fit.converged and fit.iterations < 60
    b = np.zeros((25, 3))
    for r in fit.coefficients.collect():
        b[int(r.term[1:])] = (r.b0, r.b1, r.b2)
    s = np.array([fit.dense["u"], fit.dense["v"], fit.intercepts])
    d1 = np.c_[dense, np.ones(60)]
    f, g = loss_and_gradient(x, d1, y, c, b, s, 1 / (2.0 * c.sum()))
    assert abs(f - fit.objective) < 1e-9 and abs(g - fit.gradient_norm) < 1e-9 and g <= 2e-3 * fit.start_norm
    at = sm.logistic_at(weights, docs, fit.coefficients, fit.intercepts, fit.dense, sample_weight="cw")
    assert abs(at[0] - f) < 1e-9 and abs(at[1] - g) < 1e-9
    # points around it are worse
    for seed in range(3):
        move = np.random.default_rng(seed)
        assert loss_and_gradient(x, d1, y, c, b + move.normal(size=b.shape) * .3, s + move.normal(size=s.shape) * .3,
                                 1 / (2.0 * c.sum()))[0] > f
    with pytest.raises(ValueError):
        sm.fit_logistic(weights, docs.filter("star_label > 5"), sample_weight="cw")


def test_logistic_in_packed_blocks(spark, monkeypatch):
    """Several blocks of documents and terms, repeated and absent keys, numbered terms:
    the same as numpy on the summed rows."""
    monkeypatch.setattr(sm, "BLOCK_DOCS", 16)
    monkeypatch.setattr(sm, "BLOCK_ENTRIES", 40)
    x = matrix(7)
    entries = long(spark, x, skip={5}).selectExpr("review_id", "cast(substr(term, 2) as long) as term", "weight")
    entries = cut_lineage(entries.unionByName(entries.filter("review_id = 3")).unionByName(
        entries.filter("review_id = 4").selectExpr("cast(null as long) as review_id", "term", "weight")))
    keys = [*range(60), 3, None, 77]
    docs = spark.createDataFrame([(q, int(i % 3), float(i % 5)) for i, q in enumerate(keys)], "review_id long, star_label int, u double")
    own = np.stack([2 * x[3] if q == 3 else np.zeros(25) if q in (5, None, 77) else x[q] for q in keys])
    labels, d1 = np.arange(63) % 3, np.c_[np.arange(63) % 5, np.ones(63)]
    fit = sm.fit_logistic(entries, docs, ("u",), tol=1e-2, memory=3, n_terms=25)
    b = np.zeros((25, 3))
    for r in fit.coefficients.collect():
        b[r.term] = (r.b0, r.b1, r.b2)
    s = np.array([fit.dense["u"], fit.intercepts])
    f, g = loss_and_gradient(own, d1, labels, np.ones(63), b, s, 1 / (2.0 * 63))
    assert fit.converged and abs(f - fit.objective) < 1e-9 and abs(g - fit.gradient_norm) < 1e-9
    at = sm.logistic_at(entries, docs, fit.coefficients, fit.intercepts, fit.dense, n_terms=25)
    assert abs(at[0] - f) < 1e-9 and abs(at[1] - g) < 1e-9
    assert {type(v) for v in (*at, fit.objective, fit.gradient_norm, fit.start_norm)} == {float}      # as rows take them


def test_kmeans_and_elbow(spark):
    x = matrix(3, n=90)
    x[7] = x[8]
    weights = long(spark, x)
    both = sm.spherical_kmeans(weights, [2, 5], tol=1e-6)
    assert all(r["converged"] for r in both.report)
    for r in both.report:
        alone = sm.spherical_kmeans(weights, [r["k"]], tol=1e-6)
        seeds_agree = sm.spread_seeds(weights, r["k"]) == sm.spread_seeds(weights, 5)[:r["k"]]
        if seeds_agree:
            assert abs(alone.report[0]["cost"] - r["cost"]) < 1e-9 and alone.report[0]["iterations"] == r["iterations"]
        label = np.array([q.cluster for q in both.of(r["k"], "review_id").orderBy("review_id").collect()])
        centre = np.array([x[label == j].sum(axis=0) for j in range(r["k"])])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
        sims = x @ centre.T
        assert (sims.max(axis=1) - sims[np.arange(90), label] < 1e-6).all()       # a fixed point
        assert abs((1 - sims.max(axis=1)).sum() - r["cost"]) < 1e-4
        assert label[7] == label[8]
    assert sorted((q.k, q.converged) for q in sm.elbow_table(spark, both).collect()) == [(2, True), (5, True)]
    with pytest.raises(ValueError):
        sm.spherical_kmeans(weights.limit(0), [2])


def test_silhouette(spark):
    x = matrix(5, n=50)
    x[49] = 0.0                                             # without terms
    own = [None if i == 3 else "c" if i == 4 else "ab"[i % 2] for i in range(50)]
    rows = spark.createDataFrame(list(enumerate(own)), "review_id long, cluster string")
    got = {r.review_id: r.silhouette for r in sm.cosine_silhouette(long(spark, x), rows).collect()}
    assert set(got) == set(range(50)) - {3}
    far = 1 - x @ x.T
    for i in got:
        if own[i] == "c":
            assert got[i] == 0.0
            continue
        same = [far[i, j] for j in got if own[j] == own[i] and j != i]
        other = min(np.mean([far[i, j] for j in got if own[j] == c]) for c in "abc" if c != own[i])
        a = np.mean(same)
        assert abs(got[i] - (other - a) / max(a, other)) < 1e-9
    one = sm.cosine_silhouette(long(spark, x), rows.filter("cluster = 'a'"))
    assert {r.silhouette for r in one.collect()} == {0.0}
    assert sm.cosine_silhouette(long(spark, x), rows.limit(0)).count() == 0


def test_product_catalogue(spark):
    """Products about the same things share a cluster, named by their words."""
    from starlens.plans.catalogue import product_catalogue, product_weights
    from starlens.streaming.stream import scratch_dir
    topic = {0: "battery charge power", 1: "screen display colour", 2: "novel author chapter"}
    rows = [(f"p{p}\r\nline", f"{topic[p % 3]} item{p} item{p} {topic[p % 3].split()[r % 3]}", 1 + (p + r) % 5)
            for p in range(9) for r in range(4)] + [(None, "battery", 5), ("lonely", "unheard", 2)]
    reviews = spark.createDataFrame(rows, "name string, text string, rating int")
    got = product_catalogue(reviews, 3, scratch_dir(spark, "t-cat")).collect()
    assert len(got) == 10 and {r.cluster_name for r in got if r.name == "lonely"} == {"Other"}
    by = {}
    for r in got:
        if r.name != "lonely":
            by.setdefault(r.cluster_name, set()).add(int(r.name[1]) % 3)
    assert len(by) == 3 and all(len(v) == 1 for v in by.values()) and any("battery" in c for c in by)
    norm = product_weights(reviews).groupBy("name").agg({"weight": "count"}).count()
    assert norm == 9


def test_product_norms_are_sums(spark):
    """No window over a product's terms, which are one task's; unit rows all the same."""
    from pyspark.sql import functions as F
    from starlens.plans.catalogue import product_weights
    reviews = spark.createDataFrame([(f"p{i % 3}", f"aa bb w{i % 5} w{i % 5}") for i in range(20)], "name string, text string")
    out = product_weights(reviews)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    norms = out.groupBy("name").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert len(norms) == 3 and all(abs(r.s - 1) < 1e-12 for r in norms)
