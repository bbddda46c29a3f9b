"""Metrics: confusion, classification metrics, ROC/PR, prefix sums, splits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from starlens.operators import metrics as mt
from starlens.operators import sampling as sp


def test_confusion_zero_rows_and_sum(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (2, 2), (2, 2)], "t int, p int")
    cm = {(r.true_label, r.pred_label): (r.n, r.row_pct) for r in mt.confusion_matrix(df, "t", "p").collect()}
    assert len(cm) == 9 and sum(v[0] for v in cm.values()) == 4
    assert cm[(1, 0)] == (0, 0.0) and cm[(0, 2)] == (1, 50.0)


def test_metrics_against_hand_values(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 1)], "t int, p int")
    m = mt.classification_metrics(df, "t", "p").first()
    assert abs(m.accuracy - 0.6) < 1e-12
    # recalls 1/2, 1, 1/2 -> balanced 2/3
    assert abs(m.balanced_accuracy - 2 / 3) < 1e-12
    # f1: c0 2/3, c1 2*1/(1+3)=0.5, c2 2/3
    assert abs(m.macro_f1 - (2 / 3 + 0.5 + 2 / 3) / 3) < 1e-12
    rep = {r.label: r for r in mt.classification_report(df, "t", "p").collect()}
    assert rep["accuracy"].f1 == m.accuracy and rep["Neutral"].support == 1


def test_roc_auc_ties_and_symmetry(spark):
    data = [(0, 0.9), (0, 0.8), (1, 0.8), (1, 0.3), (0, 0.3), (1, 0.1)]
    df = spark.createDataFrame([(y, s, -s, 0.0) for y, s in data],
                               "y int, s double, ns double, z double")
    auc = mt.roc_auc(df, "y", {0: "s"}).first().auc
    # brute force: P(score_pos > score_neg) + 0.5 P(tie), positives = class 0
    pos = [s for y, s in data if y == 0]
    neg = [s for y, s in data if y != 0]
    bf = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(auc - bf) < 1e-12
    auc_neg = mt.roc_auc(df, "y", {0: "ns"}).first().auc
    assert abs(auc_neg - (1 - auc)) < 1e-12
    ap = mt.average_precision(df, "y", {0: "s"}).first().average_precision
    assert 0 < ap <= 1


def test_prefix_sums_equal_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 10007).alias("k"),
                                     (F.col("id") % 5).alias("v"))
    got = mt.prefix_sums(df, ["g"], [F.col("k").desc()], ["v"], num_partitions=7)
    w = Window.partitionBy("g").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("v").over(w))
    bad = got.join(ref, ["g", "k", "v"]).filter(F.col("cum_v") != F.col("ref")).count()
    assert bad == 0 and got.count() == 5000


def test_splits_disjoint_complete_and_exact_sizes(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("review_id"), (F.col("id") % 3).alias("star_label"))
    s = sp.stratified_split(df)
    assert s.count() == 1000 and s.select("review_id").distinct().count() == 1000
    ex = sp.stratified_split(df, exact=True)
    sizes = {(r.star_label, r.split): r["count"] for r in ex.groupBy("star_label", "split").count().collect()}
    # label 0 has 334 rows: test+val = ceil(0.3*334)=101, test = ceil(101/2)=51
    assert sizes[(0, "train")] == 233 and sizes[(0, "val")] == 50 and sizes[(0, "test")] == 51
    un = sp.undersample(df)
    assert sorted(r["count"] for r in un.groupBy("star_label").count().collect()) == [333, 333, 333]


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from starlens.operators.aggregates import describe, exact_quantiles
    vals = [float(v) for v in np.random.default_rng(7).integers(0, 50, 997)] + [0.5, 0.5, 99.25]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, "x", (0.0, 0.25, 0.5, 0.75, 1.0))
    for p, v in q.items():
        assert abs(v - float(np.quantile(vals, p))) < 1e-12
    d = describe(df, "x").first()
    assert d["count"] == 1000 and abs(d.p50 - float(np.median(vals))) < 1e-12


def test_vocabulary_top_n_with_ties(spark):
    from starlens.operators.features import vocabulary
    rows = [(d, f"t{t}", 1 + (t * d) % 3) for d in range(6) for t in range(40) if (t + d) % 4]
    tf = spark.createDataFrame(rows, "review_id long, term string, tf long")
    got = [(r.term, r.df, r.cnt) for r in vocabulary(tf, 6, max_features=17, max_df=0.9)
           .orderBy("term_index").collect()]
    stats = {}
    for d, t, c in rows:
        s = stats.setdefault(t, [0, 0])
        s[0] += 1
        s[1] += c
    kept = [(t, df, cnt) for t, (df, cnt) in stats.items() if 2 <= df <= 0.9 * 6]
    want = sorted(sorted(kept, key=lambda x: (-x[2], x[0]))[:17])
    assert got == want


def test_counts_above_four_thousand_million(spark):
    """Products of such counts do not fit 64 bits."""
    from starlens.operators import metrics as mt
    n = 4_000_000_000
    counts = spark.createDataFrame([(0, 0, n), (0, 1, n // 2), (1, 1, n), (1, 0, n // 2)], "true_label int, pred_label int, n long")
    orig = mt.confusion_counts
    try:
        mt.confusion_counts = lambda *a, **k: counts
        row = mt.classification_metrics(counts, "true_label", "pred_label").first()
    finally:
        mt.confusion_counts = orig
    assert abs(row.accuracy - 2 / 3) < 1e-9 and abs(row.mcc - 1 / 3) < 1e-9
    pts = spark.createDataFrame([(1, 0.9, n, 0), (1, 0.1, 0, n)], "cls int, score double, tp long, fp long")
    orig = mt._score_points
    try:
        mt._score_points = lambda *a, **k: pts
        assert mt.roc_auc(pts).first().auc == 1.0
    finally:
        mt._score_points = orig


def test_groups_without_value(spark):
    """Rows without label or cluster are a group of their own."""
    from starlens.operators import metrics as mt
    from starlens.operators import sampling as sp
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, 1) for i in range(90)], "review_id long, star_label int, one int")
    cum = mt.prefix_sums(df, ["star_label"], ["review_id"], ["one"]).collect()
    assert len(cum) == 90 and sorted(r.cum_one for r in cum if r.star_label is None) == list(range(1, 31))
    sizes = {(r.star_label, r.split): r["count"] for r in
             sp.stratified_split(df, exact=True).groupBy("star_label", "split").count().collect()}
    assert {sizes[(None, s)] for s in ("val", "test")} == {4, 5} and sizes[(None, "train")] == 21
    assert sp.undersample(df.filter("star_label is null or review_id < 40")).filter("star_label is null").count() > 0


def test_bounded_sample_by_cut(spark):
    """The rows that sorting all of them by (hash, key) would give."""
    import hashlib
    from starlens.operators import sampling as sp
    keys = list(range(500)) + [7] * 30 + [None] * 5
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "review_id long, t string")
    order = sorted((hashlib.md5(f"42:{'' if k is None else k}".encode()).hexdigest(), -1 if k is None else k) for k in keys)
    for n in (0, 1, 3, 50, 200, 400, 535, 600):
        for few in (3, 10 ** 6):
            got = sorted((hashlib.md5(f"42:{'' if r.review_id is None else r.review_id}".encode()).hexdigest(),
                          -1 if r.review_id is None else r.review_id) for r in sp.bounded_sample(df, n, few=few).collect())
            assert got == order[:n]
    plan = sp.bounded_sample(df, 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Exchange" not in plan
