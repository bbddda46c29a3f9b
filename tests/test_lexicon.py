"""Lexicon polarity: base score by brute force, rule switches by hand."""

import math

from starlens.operators.lexicon import FULL, lexicon_polarity

LEX = [("good", 1.9), ("bad", -2.5), ("great", 3.1)]


def score(spark, texts, rules=None):
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    lex = spark.createDataFrame(LEX, "word string, valence double")
    kw = {"rules": rules} if rules else {}
    return {r["review_id"]: r for r in lexicon_polarity(df, lex, **kw).collect()}


def brute(text):
    import re
    toks = text.split()
    lex = dict(LEX)
    vals = [lex.get(re.sub(r"^[^\w]+|[^\w]+$", "", t).lower(), 0.0) for t in toks]
    s = sum(vals)
    if not toks:
        return 0.0, 0.0, 0.0, 0.0
    pos = sum(v + 1 for v in vals if v > 0)
    neg = sum(v - 1 for v in vals if v < 0)
    neu = sum(1 for v in vals if v == 0)
    tot = pos + abs(neg) + neu
    comp = max(-1.0, min(1.0, s / math.sqrt(s * s + 15)))
    return round(abs(neg / tot), 3), round(abs(neu / tot), 3), round(abs(pos / tot), 3), round(comp, 4)


def test_base_matches_brute_force(spark):
    texts = ["Good product, good price.", "bad BAD bad!", "", "   ", "nothing here",
             "great... but bad", "(good) [bad] great!!"]
    got = score(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["lex_neg"], r["lex_neu"], r["lex_pos"], r["lex_compound"]) == brute(t), t


def test_rules_negation_booster_but_caps_punct(spark):
    texts = ["good", "not good", "very good", "good but bad", "GOOD product", "good!!", "good"]
    g = score(spark, texts, FULL)
    base = g[0]["lex_compound"]
    assert g[1]["lex_compound"] < 0 < base                       # negation flips
    assert g[2]["lex_compound"] > base                           # booster adds
    s = 1.9 * 0.5 + -2.5 * 1.5                                   # but: 0.5 before, 1.5 after
    assert g[3]["lex_compound"] == round(s / math.sqrt(s * s + 15), 4)
    s = 1.9 + 0.733                                              # caps in mixed-case text
    assert g[4]["lex_compound"] == round(s / math.sqrt(s * s + 15), 4)
    s = 1.9 + 2 * 0.292                                          # two exclamation marks
    assert g[5]["lex_compound"] == round(s / math.sqrt(s * s + 15), 4)


def test_scores_keep_reviews_without_hits(spark):
    from starlens.operators.lexicon import polarity_scores
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    df = spark.createDataFrame([(1, "good day"), (2, None), (3, ""), (4, "!!! ..."), (5, "plain words")],
                               "review_id int, text string")
    for rules in (None, FULL):
        kw = {"rules": rules} if rules else {}
        got = {r.review_id: r for r in polarity_scores(df, lex, **kw).collect()}
        assert sorted(got) == [1, 2, 3, 4, 5]
        assert got[1].lex_compound > 0 and got[1].lex_neu > 0
        assert [got[k].lex_neu for k in (2, 3, 4, 5)] == [0.0, 0.0, 1.0, 1.0]
        assert all(got[k].lex_compound == 0.0 for k in (2, 3, 4, 5))


def test_literal_and_join_agree(spark):
    """A lexicon beyond the bound is joined; rows with equal or null ids are
    scored each on its own either way; words given twice have their mean."""
    import random

    from starlens.operators.lexicon import polarity_scores
    rng = random.Random(4)
    bits = ["good", "Bad!", "GREAT", "not", "very", "but", "fine", "(good)", "...", "slightly", "never", "x", "great??", "é"]
    texts = [None, "", " \t", "good bad"] + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 7, t, i) for i, t in enumerate(texts)],
                               "review_id int, text string, place int")
    lex = spark.createDataFrame(LEX + [("fine", 1.0), ("fine", 2.0), (None, 3.0), ("x", None), ("it's", 1.0)],
                                "word string, valence double")
    for rules in ({}, {"rules": FULL}):
        a = lexicon_polarity(df, lex, **rules).orderBy("place").collect()
        b = lexicon_polarity(df, lex, max_words=2, **rules).orderBy("place").collect()
        assert len(a) == len(texts) and a == b
        if not rules:
            for r, t in zip(a, texts):
                want = brute_with(t or "", {**dict(LEX), "fine": 1.5})     # halves may round either way
                assert all(abs(x - y) < 1.1e-3 for x, y in zip((r.lex_neg, r.lex_neu, r.lex_pos, r.lex_compound), want))
    assert polarity_scores(df, lex).count() == len(texts)
    assert lexicon_polarity(df, lex.limit(0)).filter("lex_compound != 0").count() == 0


def brute_with(text, lex):
    global LEX
    kept, LEX = LEX, list(lex.items())
    try:
        return brute(text)
    finally:
        LEX = kept


def test_texts_stay_in_their_rows(spark):
    """One scan, no exchange of tokens or texts."""
    from tables import SF_SMALL

    from starlens.plans.registry import QUERIES
    for name in ("c3_lexicon_polarity", "c3_lexicon_polarity_rules"):
        plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan and plan.count("Scan parquet") == 1
