"""Driver contract: entry smoke, and a sample of registered queries against
their DuckDB oracle at sf0.001 (tools/check_oracle.py runs all at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from starlens.sources.fixtures import TABLES

from tables import SF_SMALL

SAMPLE = ["g2_top_and_worst", "f8_cluster_kpis", "f11_cluster_sentiment", "b9_clean_reviews",
          "c3_lexicon_polarity", "c8_sample_weight", "f6_confusion_matrix", "f14_classification_metrics",
          "f16_roc_auc", "i1_stratified_split", "j3_tfidf", "k2_cluster_context", "b12_near_dedup",
          "l3_enrich_stream"]


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert set(df.columns) >= {"cluster_name", "name", "rank", "is_top", "is_worst", "score"}
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    drows = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert srows == drows
