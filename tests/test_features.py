"""Text features: accents of any script, terms, chunks."""

import random
import unicodedata

from pyspark.sql import functions as F

from starlens.operators import features as ft


def nfkd(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def test_strip_accents_is_nfkd_without_marks(spark):
    """Every character of Unicode, and mixed texts."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(3)
    texts = ["".join(chars[i:i + 4096]) for i in range(0, len(chars), 4096)]
    texts += ["Ấm ơi Việt Nam", "élève", "ﬁnal ½ Ⅷ", "한국어 텍스트", "Ёлка й", "ﷺ", "", "plain", "Ångström"]
    texts += ["".join(rng.choice(chars[:0x3000]) for _ in range(50)) for _ in range(50)]
    # Reordering of marks cannot matter, as all of them go.
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    for r in df.select("i", "t", ft.strip_accents(F.col("t")).alias("s")).collect():
        assert r.s == (r.t if r.t is None else nfkd(r.t)), r.t[:60]


def test_terms_of_vietnamese(spark):
    df = spark.createDataFrame([(1, "Tiếng Việt, été")], "review_id int, text string")
    assert df.select(ft.word_tokens(F.col("text")).alias("w")).first().w == ["tieng", "viet", "ete"]


def test_weights_with_and_without_broadcast(spark):
    """The same weights; with the vocabulary broadcast, term rows are not shuffled by term."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)],
                               "review_id int, text string")
    tf, n = ft.counted_terms(df)
    vocab = ft.vocabulary(tf, n)
    both = [sorted((r.review_id, r.term, round(r.weight, 12)) for r in ft.tfidf(tf, ft.near_vocabulary(vocab, limit), n).collect())
            for limit in (0, 1 << 20)]
    assert both[0] == both[1] and len(both[0]) > 500
    want = {(r.review_id, r.term) for r in ft.terms(df).distinct().collect()}
    often = {t for t in {t for _, t in want} if sum((i, t) in want for i in range(60)) >= 2}
    assert {(i, t) for i, t, _ in both[0]} == {(i, t) for i, t in want if t in often and sum((j, t) in want for j in range(60)) <= 0.95 * 60}


def test_terms_are_counted_in_their_row(spark):
    """No exchange before the vocabulary; rows of one id stay documents of their own."""
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (None, "aa bb"), (4, None), (5, "x")], "review_id int, text string")
    tf, n = ft.counted_terms(df)
    assert n == 5 and "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.review_id, r.term, r.tf) for r in tf.collect()), key=repr)
    assert got == sorted([(1, "aa", 2), (1, "bb", 1), (1, "aa bb", 1), (1, "bb aa", 1), (1, "bb", 1), (1, "cc", 1), (1, "bb cc", 1),
                          (None, "aa", 1), (None, "bb", 1), (None, "aa bb", 1)], key=repr)
    assert len({r["__row"] for r in tf.collect()}) == 3


def test_pinned_rows_are_compact(spark):
    """A long table with an id per term takes a fraction of its checkpoint."""
    import os

    from starlens.session import ensure_checkpoint_dir, pin_rows
    base = ensure_checkpoint_dir(spark).removeprefix("file:")

    def held():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(base) for f in fs)

    df = spark.range(0, 200_000, 1, 2).select((F.col("id") / 100).cast("long").alias("review_id"), (F.col("id") % 100).alias("term"),
                                              (F.col("id") % 7 / 7).alias("weight"))
    before = held()
    out = pin_rows(df)
    assert held() - before < 200_000 * 8 and sorted(out.collect()) == sorted(df.collect()) and out.schema == df.schema


def test_terms_in_slices_of_a_batch(spark):
    """Documents counted a few tokens at a time, or all at once, have the same terms."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.choice([0, 1, 2, 40])))) for i in range(80)]
    df = spark.createDataFrame([*rows, (80, None), (None, "aa aa")], "review_id int, text string").coalesce(1)
    want = sorted(((r.review_id, r.term, r["count"]) for r in ft.terms(df).groupBy("review_id", "term").count().collect()), key=repr)
    for at_once in (1, 7, 1 << 18):
        got = sorted((tuple(r) for r in ft.term_frequencies(ft.document_terms(df), at_once=at_once).collect()), key=repr)
        assert got == want
    assert ft.term_frequencies(ft.document_terms(df.limit(0))).count() == 0


def test_norm_deals_rows_out_by_key_once(spark):
    """What follows the norm joins on the key without another exchange of term rows."""
    df = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (2, "bb cc aa"), (3, "dd")], "review_id int, text string")
    tf, n = ft.counted_terms(df)
    w = ft.tfidf(tf, ft.near_vocabulary(ft.vocabulary(tf, n, max_df=1.0)), n)
    joined = w.join(df.select("review_id").hint("merge"), "review_id")
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert plan and "__row" in plan
    executed = joined._jdf.queryExecution().executedPlan().toString()
    by_row = [line for line in executed.splitlines() if "Exchange hashpartitioning(" in line and "__row" in line.split("hashpartitioning(")[1].split("]")[0]]
    by_key = [line for line in executed.splitlines() if "Exchange hashpartitioning(review_id" in line]
    assert not by_row and len(by_key) == 2
    norms = {}
    for r in w.collect():
        norms[r.review_id] = norms.get(r.review_id, 0) + r.weight ** 2
    assert abs(norms[1] - 2) < 1e-9 and abs(norms[2] - 1) < 1e-9         # two rows of one id stay two documents


def test_keywords_by_term_number(spark):
    """The same keywords, ties included, as with the terms' texts; no text is dealt out by document."""
    rows = [(i, "xy"[i % 2], t) for i, t in enumerate(["bb aa", "cc bb", "aa bb", "bb cc dd", "dd aa", "cc dd", "aa", "dd"])]
    df = spark.createDataFrame(rows, "review_id int, cluster_name string, text string")
    w, vocab, _ = ft.tfidf_table(df, max_df=1.0)
    plain = [r.asDict() for r in ft.cluster_keywords(w, df, 3).orderBy("cluster_name", "rank").collect()]
    quick = ft.spelled(ft.cluster_keywords(ft.numbered(w), df, 3), vocab)
    got = [r.asDict() for r in quick.orderBy("cluster_name", "rank").collect()]
    assert quick.columns == ["cluster_name", "term", "mean_weight", "rank"] and len(got) == 6
    assert [(r["cluster_name"], r["term"], r["rank"], round(r["mean_weight"], 9)) for r in got] == [
        (r["cluster_name"], r["term"], r["rank"], round(r["mean_weight"], 9)) for r in plain]
