import duckdb
from brute import quality

from starlens.llm.quality import (STATS, drop_low_quality, fit_label_model, op10_quality_rules, text_stats,
                                  with_votes)

SF = "/root/testdata/sf0.01"


def test_base_columns(spark):
    texts = [None, "", " \n ", "a b", "a b c d e f g h " * 5, "x\ny\nx\n\n \ny\x0bz", "Été ß no break 🙂🙂",
             "a b c d e f g h i a b c d e f g h j", "w " * 30000, "l1\r\nl1\r\nl1"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = {r.doc_id: tuple(r[c] for c in STATS) for r in text_stats(df).collect()}
    assert rows == {i: quality(t)[:5] for i, t in enumerate(texts)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fit_label_model(with_votes(text_stats(empty))).converged
    assert drop_low_quality(empty).count() == 0


def test_table_and_labels(spark):
    got = {r.doc_id: r for r in op10_quality_rules(spark, SF).collect()}
    docs = duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()
    assert len(got) == len(docs)
    for d, t in docs:
        assert (*(got[d][c] for c in STATS), got[d].base_failed) == quality(t)
        assert not (got[d].base_failed and got[d].kept)
    labels = duckdb.sql(f"select doc_id, quality from read_parquet('{SF}/labels.parquet')").fetchall()
    bad = [d for d, q in labels if not q]
    good = [d for d, q in labels if q and not got[d].base_failed]
    assert sum(not got[d].kept for d in bad) >= 0.98 * len(bad)
    assert sum(got[d].kept for d in good) >= 0.995 * len(good)


def test_stage_keeps_columns(spark):
    df = spark.createDataFrame([(1, "w%d " % 1 + " ".join(f"word{i}" for i in range(60)) + ".", "p_good", 0.5),
                                (2, "short", "x", 0.1)], "doc_id long, text string, kept string, row double")
    out = drop_low_quality(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]
