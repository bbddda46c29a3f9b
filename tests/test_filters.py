"""Filters on computed columns: the rows of a plain filter, each step computed once."""

import pytest
from pyspark.sql import functions as F

from starlens.operators.filters import conflict_examples, drop_strong_conflicts, filter_computed
from starlens.operators.ranking import hard_errors
from starlens.plans.audit import conflicted_reviews
from starlens.sources import fixtures as fx


def steps(df):
    """How often the optimized plan spells out the tokens of a text."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("split(")


@pytest.fixture()
def audited(spark):
    rows = [(i, str(1 + i % 5), "t", f"thly heit {'keit ' * (i % 7)} {'thing ' * (i % 4)}", "p", "c") for i in range(40)]
    raw = spark.createDataFrame(rows, "review_id int, review_rating string, review_title string, review_text string, name string, cluster_name string")
    return conflicted_reviews(raw, fx.lexicon(spark))


def test_filter_computed_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "b")], "i int, s string")
    for c in (F.col("s") == "a", F.col("s").isNull(), F.col("i") > 1, ~(F.col("i") > 1)):
        assert sorted(filter_computed(df, c).collect(), key=repr) == sorted(df.filter(c).collect(), key=repr)
    assert filter_computed(df, F.col("i") > 5).columns == ["i", "s"]


def test_texts_are_read_once(audited):
    plain = steps(audited.select("review_id", "conflict_type"))
    kept = drop_strong_conflicts(audited).select("review_id", "conflict_type")
    shown = conflict_examples(audited, "star_polar_text_mixed")
    wrong = hard_errors(audited.withColumns({"correct": F.col("agree"), "true_label_name": F.col("star_label_name"),
                                             "pred_label_name": F.col("lex_label_name"), "pred_confidence": F.abs("lex_compound")}))
    assert [steps(x) <= plain for x in (kept, shown, wrong)] == [True] * 3
    types = {r.review_id: r.conflict_type for r in audited.collect()}
    strong = {"low_star_positive_text", "high_star_negative_text"}
    assert {r.review_id for r in kept.collect()} == {i for i, t in types.items() if t not in strong}
    assert [r.review_id for r in shown.collect()] == sorted(i for i, t in types.items() if t == "star_polar_text_mixed")[:20]
    assert {r.review_id for r in wrong.collect()} <= {i for i, t in types.items() if t != "agree"}
