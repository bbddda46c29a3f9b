"""Sources/sinks, schema resolution, cleaning helpers, articles."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from starlens.operators import clean as cl
from starlens.operators import context as cx
from starlens.sources import io


def test_resolve_require_trim(spark):
    df = spark.createDataFrame([(1, "a")], "`reviews.rating` int, ` text ` string")
    df = cl.trim_column_names(df)
    assert df.columns == ["reviews.rating", "text"]
    assert cl.resolve_column(df, cl.RATING_CANDIDATES) == "reviews.rating"
    assert cl.resolve_column(df, cl.TITLE_CANDIDATES) is None
    with pytest.raises(ValueError):
        cl.require_columns(rating="x", text=None)


def test_clean_reviews_dotted_columns(spark):
    df = spark.createDataFrame(
        [("4.7", "Great", "works well", "p1"), ("0", "x", "long enough text", "p2"),
         (None, "a", "bbbbbbbbb", "p3"), ("5", None, "fine fine", None)],
        "`reviews.rating` string, `reviews.title` string, `reviews.text` string, name string")
    out = {r.review_body: r for r in cl.clean_reviews(df, key=None).collect()}
    assert set(out) == {"works well", "fine fine"}
    assert out["works well"].rating == 4 and out["works well"].text == "Great. works well"
    assert out["fine fine"].product == "Unknown" and out["fine fine"].star_label == 2


def test_read_catalog_crlf_names(spark):
    d = tempfile.mkdtemp(prefix="starlens-test-")
    path = os.path.join(d, "catalog_May19.csv")
    with open(path, "w", newline="") as f:
        f.write('name,cluster_name,reviews.rating,categories\r\n'
                '"Echo\r\nDot",Smart Home,4.5,"A,B"\r\n'
                'Kindle,Readers,5.0,C\r\n')
    cat = io.read_catalog(spark, path)
    assert sorted(r.name for r in cat.collect()) == ["Echo\nDot", "Kindle"]
    assert io.select_input([os.path.join(d, "x.csv"), path], "May19") == path
    df = io.read_reviews(spark, d, glob="*May19*.csv", multi_line=True)
    assert df.count() == 2


def test_write_table_and_articles(spark):
    d = tempfile.mkdtemp(prefix="starlens-test-")
    df = spark.createDataFrame([("Électronique", "Très bien ✓")], "cluster_name string, article string")
    io.write_articles(df, d + "/articles")
    lines = [json.loads(x) for f in os.listdir(d + "/articles") if f.endswith(".json")
             for x in open(os.path.join(d, "articles", f), encoding="utf-8")]
    assert lines == [{"cluster_name": "Électronique", "article": "Très bien ✓"}]
    io.write_table(df, d + "/t", fmt="csv")
    assert spark.read.option("header", True).csv(d + "/t").count() == 1


def test_near_dedup_and_emoji(spark):
    df = spark.createDataFrame([(1, "Hello, World!"), (2, "hello   world"), (3, "other"), (4, "👍"), (5, "👎"), (6, "!!!"),
                                (7, None), (8, None), (9, "👍")], "review_id long, text string")
    assert sorted(r.review_id for r in cl.near_dedup(df).collect()) == [1, 3, 4, 5, 6, 7, 8]
    emo = spark.createDataFrame([("👍", " thumbs up "), ("👍🏽", " tanned thumb "), ("❤️", " heart ")], "emoji string, alias string")
    t = spark.createDataFrame([(1, "ok 👍!"), (2, "plain"), (2, "👍🏽❤️👍")], "review_id long, text string")
    assert sorted(r.text for r in cl.emoji_to_text(t, emo).collect() if r.review_id == 2) == [
        " tanned thumb  heart  thumbs up ", "plain"]
    t = t.filter("text not like '%❤%'")
    got = {r.review_id: r.text for r in cl.emoji_to_text(t, emo).collect()}
    assert got == {1: "ok  thumbs up !", 2: "plain"}


def test_near_dedup_rows_with_equal_and_without_keys(spark):
    """Against plain Python: the row of lowest key per text, none lost, none twice."""
    rows = [(1, "hello world", "a"), (1, "hello world", "a"), (1, "Hello, world", "b"), (3, "aaa", "x"), (2, "aaa", "y"),
            (3, "bbb", "z"), (None, "only null", "p"), (None, "only null", "q"), (None, "aaa", "r"), (4, None, "s"),
            (4, None, "s"), (None, None, "t")]
    rows += [(k % 3, "hot text", str(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "review_id long, text string, extra string")
    got = sorted(map(tuple, cl.near_dedup(df).collect()), key=repr)
    assert len([r for r in got if r[1] is None]) == 3
    by = {}
    for r in got:
        if r[1] is not None:
            by.setdefault(r[1].lower().replace(",", ""), []).append(r)
    assert {k: [r[0] for r in v] for k, v in by.items()} == {
        "hello world": [1], "aaa": [2], "bbb": [3], "only null": [None], "hot text": [0]}
    assert all(r in rows for r in got)
    assert cl.near_dedup(df.limit(0)).count() == 0
    plan = cl.near_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "WindowGroupLimit" in plan


def test_emoji_longest_match(spark):
    """3,000 aliases with overlapping sequences against plain Python."""
    import random
    rng = random.Random(11)
    alphabet = [chr(0x1F600 + i) for i in range(60)] + ["\u2764", "\ufe0f", "\u200d", "#", "*", "[", "\\", "\U0001F3FD"]
    table = {}
    while len(table) < 3000:
        table["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))] = f":{len(table)}:" + rng.choice(["", "\U0001F600", "$1"])
    texts = [None, "", "plain", "a#b*c"] + ["".join(rng.choice(alphabet + ["x", " ", "é"]) for _ in range(rng.randint(1, 80))) for _ in range(150)]

    def plain(t):
        out, i = "", 0
        while i < len(t):
            n = next((n for n in range(5, 0, -1) if t[i:i + n] in table and i + n <= len(t)), 0)
            out += table[t[i:i + n]] if n else t[i]
            i += n or 1
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string")
    emo = spark.createDataFrame([*table.items(), ("", "no"), (None, "no")], "emoji string, alias string")
    got = {r.review_id: r.text for r in cl.emoji_to_text(df, emo).collect()}
    assert got == {i: t if t is None else plain(t) for i, t in enumerate(texts)}
    assert cl.emoji_to_text(df, emo.limit(0)).collect() == df.collect()


def test_chunk_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "")], "review_id long, text string")
    got = [(r.review_id, r.chunk_index, r.chunk) for r in
           cx.chunk_text(df, 4).orderBy("review_id", "chunk_index").collect()]
    assert got == [(1, 0, "abcd"), (1, 1, "efgh"), (1, 2, "ij"), (2, 0, "")]


def test_generate_articles_isolates_failures(spark):
    ctx = spark.createDataFrame([("A", "PRODUCT: x\nPRODUCT: y"), ("B", "boom"), ("C", None)],
                                "cluster_name string, context string")

    def gen(cluster, context):
        if context == "boom":
            raise RuntimeError("quota")
        return f"# {cluster}"

    out = {r.cluster_name: r for r in cx.generate_articles(ctx, gen).collect()}
    assert out["A"].article.startswith("# A") and out["A"].error is None
    assert out["B"].article == "" and "quota" in out["B"].error
    assert out["C"].article == "[Not enough product data for cluster: C]"
    secs = cx.split_sections(spark.createDataFrame(
        [("A", "## TOP 3 PRODUCTS\n- a\n\n## PRODUCT TO AVOID\nz\n## Other\nq")],
        "cluster_name string, article string"))
    assert [(r.kind, r.body) for r in secs.orderBy("section_index").collect()] == \
        [("top_products", "- a"), ("avoid", "z")]
