r"""Registered queries for markup cleaning, emoji aliases, near-duplicate
removal, appends and table profiles: B10, B11, B12, H1, A4."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.labels import label_name
from starlens.functions.text import strip_markup
from starlens.operators.clean import clean_reviews, emoji_to_text, near_dedup
from starlens.operators.filters import append_reviews
from starlens.operators.joins import inner_catalog
from starlens.plans.q_audit import audit_sql
from starlens.plans.q_dashboard import DASH_SQL
from starlens.plans.registry import register, rounded
from starlens.sources import fixtures as fx
from starlens.sources.io import profile_table

MARKUP_SQL = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'),
  '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', ' ', 'g'), '(https?://|www\.)\S+', ' ', 'g'),
  '\s+', ' ', 'g')"""


@register("b10_strip_markup", fx.with_views(rf"""
SELECT page_id, regexp_replace({MARKUP_SQL}, '^\s+|\s+$', '', 'g') AS text FROM pages"""))
def b10_strip_markup(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", strip_markup("html").alias("text"))


# Emoji alias table used by the registered B11 query.
EMOJI_ALIASES = {"😀": " grinning face ", "😡": " angry face ", "👍🏽": " thumbs up (medium skin tone) ",
                 "👍": " thumbs up ", "👎": " thumbs down ", "❤️": " red heart ", "❤": " heart ", "⭐": " star ",
                 "🔥": " fire "}
#: The documents hold no emoji: frequent words stand in for some.
WITH_EMOJI = [(" of ", " ❤️ "), (" the ", " 👍🏽 "), (" and ", " 👍 "), (" de ", " ❤ "), (" die ", " 🔥🔥 "), (" que ", " 👎 ")]


def _with_emoji():
    out = "text"
    for word, emoji in WITH_EMOJI:
        out = f"replace({out}, '{word}', '{emoji}')"
    return out


def _emoji_sql():
    out = "text"
    for e in sorted(EMOJI_ALIASES, key=lambda e: (-len(e), e)):
        out = f"replace({out}, '{e}', '{EMOJI_ALIASES[e]}')"
    return f"SELECT doc_id, {out} AS text FROM (SELECT doc_id, {_with_emoji()} AS text FROM documents) t"


@register("b11_emoji_to_text", fx.with_views(_emoji_sql()))
def b11_emoji_to_text(spark, sf):
    d = fx.table(spark, sf, "documents").selectExpr("doc_id", f"{_with_emoji()} AS text")
    return emoji_to_text(d, spark.createDataFrame(list(EMOJI_ALIASES.items()), "emoji string, alias string"))


NORM_SQL = r"""regexp_replace(regexp_replace(regexp_replace(lower(text), '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g'),
  '^\s+|\s+$', '', 'g')"""


@register("b12_near_dedup", fx.with_views(f"""
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY CASE WHEN {NORM_SQL} = '' THEN chr(1) || text ELSE {NORM_SQL} END ORDER BY doc_id) AS rn,
         text FROM documents) t
WHERE rn = 1 OR text IS NULL"""))
def b12_near_dedup(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return near_dedup(d, key="doc_id").select("doc_id", "lang")


@register("h1_append_reviews", audit_sql(f"""
SELECT count(*) AS total, count(text) AS with_text, round(avg(CAST(rating_x AS DOUBLE)), 6) AS avg_rating,
       CAST(count_if(sentiment = 'positive') AS BIGINT) AS n_positive
FROM (SELECT name, cluster_name, rating_x, lower(sentiment) AS sentiment, NULL AS text FROM dash
      UNION ALL
      SELECT name, cluster_name, rating AS rating_x, lower(star_label_name) AS sentiment, text FROM clean) u""",
    upto="clean", more=[("catalog", fx.VIEW_SQL["catalog"]), ("reviews_num", fx.VIEW_SQL["reviews_num"]),
                        ("dash", DASH_SQL)]))
def h1_append_reviews(spark, sf):
    r = fx.reviews_num(spark, sf).withColumn("sentiment", label_name("pred_label"))
    dash = inner_catalog(r, fx.catalog(spark, sf)).select(
        "name", "cluster_name", "rating_x", F.lower("sentiment").alias("sentiment"))
    new = clean_reviews(fx.reviews_raw(spark, sf)).select(
        "name", "cluster_name", F.col("rating").alias("rating_x"),
        F.lower("star_label_name").alias("sentiment"), "text")
    both = append_reviews(dash, new)
    return rounded(both.agg(F.count("*").alias("total"), F.count("text").alias("with_text"),
                            F.avg(F.col("rating_x").cast("double")).alias("avg_rating"),
                            F.count_if(F.col("sentiment") == "positive").alias("n_positive")))


@register("a4_profile_schema", fx.with_views(
    "SELECT count(*) AS n_rows, 6 AS n_cols FROM documents"))
def a4_profile_schema(spark, sf):
    return profile_table(fx.reviews_raw(spark, sf))
