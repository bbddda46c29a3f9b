"""SURVEY §5 invariants on the sf0.001 fixtures."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from starlens.operators.metrics import confusion_matrix
from starlens.plans.audit import audited_reviews
from starlens.sources import fixtures as fx

from tables import SF_SMALL


def test_audit_invariants(spark):
    a = audited_reviews(fx.reviews_raw(spark, SF_SMALL), fx.lexicon(spark)).cache()
    n = a.count()
    assert n > 0
    assert a.filter(F.col("agree") != (F.col("star_label") == F.col("lex_strict_label"))).count() == 0
    shares = F.col("lex_neg") + F.col("lex_neu") + F.col("lex_pos")
    assert a.filter((shares > 0) & (F.abs(shares - 1) > 0.0021)).count() == 0
    assert a.filter(~F.col("lex_compound").between(-1, 1)).count() == 0
    cm = confusion_matrix(a, "star_label", "lex_strict_label")
    assert cm.agg(F.sum("n")).first()[0] == n
    a.unpersist()


def test_one_worst_row_per_cluster(spark):
    tw = entry.entry(spark)
    per = {r.cluster_name: r.c for r in tw.filter("is_worst").groupBy("cluster_name")
           .agg(F.count("*").alias("c")).collect()}
    clusters = {r.cluster_name for r in tw.select("cluster_name").distinct().collect()}
    assert set(per) == clusters and set(per.values()) == {1}
