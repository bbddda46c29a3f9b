"""Registered summary / context queries (G5, K1-K7, C15, C17) over the
audited text reviews: a product is (cluster_name, name), its sentiment the
lexicon label."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.text import markdown_to_html
from starlens.operators import context as cx
from starlens.operators import ranking as rk
from starlens.plans.q_audit import _audited as audited
from starlens.plans.q_audit import audit_sql
from starlens.plans.registry import register, rounded
from starlens.session import cut_lineage
from starlens.sources import fixtures as fx

FLAT = r"regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def longest_sql(n: int, sentiment: int | None, name: str) -> tuple[str, str]:
    cond = f" AND lex_label = {sentiment}" if sentiment is not None else ""
    return (name, f"""
SELECT cluster_name, name, string_agg(flat, ' | ' ORDER BY rn) AS reviews, count(*) AS n_reviews FROM (
  SELECT cluster_name, name, {FLAT} AS flat,
         row_number() OVER (PARTITION BY cluster_name, name ORDER BY length(text) DESC, review_id) AS rn
  FROM audited WHERE text IS NOT NULL AND name IS NOT NULL AND cluster_name IS NOT NULL{cond}) t
WHERE rn <= {n} GROUP BY cluster_name, name""")


def fmt1(x: str) -> str:
    return f"printf('%.1f', floor({x} * 10 + 0.5) / 10)"


def pct0(x: str) -> str:
    return f"CAST(CAST(floor({x} * 100 + 0.5) AS BIGINT) AS VARCHAR)"


LTW_SQL = """
SELECT *, rank <= 3 AS is_top, rank = n_products AS is_worst FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cluster_name ORDER BY score DESC NULLS LAST, name) AS INTEGER) AS rank,
         count(*) OVER (PARTITION BY cluster_name) AS n_products
  FROM (SELECT *, avg_rating * CAST(0.5 AS DOUBLE) + positive_pct * CAST(5.0 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS score
        FROM (SELECT cluster_name, name, avg(CAST(rating AS DOUBLE)) AS avg_rating, count(text) AS review_count,
                     avg(CASE WHEN lex_label = 2 THEN 1 ELSE 0 END) AS positive_pct,
                     avg(CASE WHEN lex_label = 0 THEN 1 ELSE 0 END) AS negative_pct
              FROM audited WHERE cluster_name <> 'Other' AND name IS NOT NULL
              GROUP BY cluster_name, name HAVING count(text) >= 3) s) sc) r
WHERE rank <= 3 OR rank = n_products"""

SECTIONS_SQL = f"""
SELECT t.cluster_name, t.name, t.rank, t.is_top, t.is_worst,
  CASE WHEN t.is_top THEN concat('PRODUCT: ', t.name, chr(10), 'Avg Rating : ', {fmt1('t.avg_rating')},
       '/5  |  Total Reviews: ', CAST(t.review_count AS VARCHAR), '  |  ', {pct0('t.positive_pct')}, '% positive  ',
       {pct0('t.negative_pct')}, '% negative', chr(10), 'What customers love:', chr(10),
       substr(coalesce(p.reviews, ''), 1, 700), chr(10), 'Main complaints:', chr(10),
       substr(coalesce(n3.reviews, ''), 1, 350)) END AS section,
  CASE WHEN t.is_worst THEN concat('Avg Rating: ', {fmt1('t.avg_rating')}, '/5  |  ', {pct0('t.negative_pct')},
       '% negative  (', CAST(t.review_count AS VARCHAR), ' reviews)') END AS worst_line,
  CASE WHEN t.is_worst THEN substr(coalesce(n5.reviews, ''), 1, 550) END AS worst_complaints
FROM ltw t
LEFT JOIN pos5 p ON t.cluster_name = p.cluster_name AND t.name = p.name
LEFT JOIN neg3 n3 ON t.cluster_name = n3.cluster_name AND t.name = n3.name
LEFT JOIN neg5 n5 ON t.cluster_name = n5.cluster_name AND t.name = n5.name"""

CTX_STAGES = [("ltw", LTW_SQL), longest_sql(5, 2, "pos5"), longest_sql(3, 0, "neg3"),
              longest_sql(5, 0, "neg5"), ("sections", SECTIONS_SQL)]


def _aud(spark, sf):
    return audited(spark, sf).withColumn("sentiment", F.col("lex_label"))


def _aud_pinned(spark, sf):
    """The scored table feeds stats, ranked texts and the cluster list: pin
    the columns they read once (reliable checkpoint), not three scorings."""
    return cut_lineage(_aud(spark, sf).select("review_id", "cluster_name", "name", "rating", "text", "sentiment"))


BY = ("cluster_name", "name")


@register("g5_longest_reviews", audit_sql("SELECT * FROM longest8", more=[longest_sql(8, None, "longest8")]))
def g5_longest_reviews(spark, sf):
    return rk.longest_reviews(_aud(spark, sf), n=8, by=BY)


@register("k1_product_section", audit_sql(
    "SELECT * FROM sections", more=CTX_STAGES))
def k1_product_section(spark, sf):
    return cx.product_sections(_aud_pinned(spark, sf), by=BY)


CTX_SQL = """
SELECT c.cluster_name,
  CASE WHEN b.block IS NULL THEN NULL ELSE
  concat('=== TOP PRODUCTS DATA ===', chr(10), b.block, chr(10), chr(10), '=== WORST PRODUCT DATA ===', chr(10),
         'PRODUCT: ', w.name, chr(10), w.worst_line, chr(10), 'Customer complaints:', chr(10), w.worst_complaints)
  END AS context
FROM (SELECT DISTINCT cluster_name FROM audited WHERE cluster_name IS NOT NULL AND cluster_name <> 'Other') c
LEFT JOIN (SELECT cluster_name, string_agg(section, concat(chr(10), '---', chr(10)) ORDER BY rank) AS block
           FROM sections WHERE is_top GROUP BY cluster_name) b ON c.cluster_name = b.cluster_name
LEFT JOIN (SELECT * FROM sections WHERE is_worst) w ON c.cluster_name = w.cluster_name"""


@register("k2_cluster_context", audit_sql(CTX_SQL, more=CTX_STAGES))
def k2_cluster_context(spark, sf):
    return cx.cluster_context(_aud_pinned(spark, sf), by=BY)


@register("k3_marketing_context", audit_sql("""
SELECT c.cluster_name, t.top_products, coalesce(w.name, 'N/A') AS worst_name, s.sample_reviews
FROM (SELECT DISTINCT cluster_name FROM audited WHERE cluster_name IS NOT NULL) c
LEFT JOIN (SELECT cluster_name, string_agg(name, ', ' ORDER BY rk) AS top_products FROM (
    SELECT cluster_name, name, row_number() OVER (PARTITION BY cluster_name ORDER BY count(*) DESC, name) AS rk
    FROM audited WHERE name IS NOT NULL AND cluster_name IS NOT NULL GROUP BY cluster_name, name) v
  WHERE rk <= 3 GROUP BY cluster_name) t ON c.cluster_name = t.cluster_name
LEFT JOIN (SELECT cluster_name, name FROM (
    SELECT cluster_name, name, row_number() OVER (PARTITION BY cluster_name ORDER BY m, name) AS rn FROM (
      SELECT cluster_name, name, avg(CAST(rating AS DOUBLE)) AS m, count(rating) AS n
      FROM audited WHERE name IS NOT NULL AND cluster_name IS NOT NULL GROUP BY 1, 2) p WHERE n >= 3) q
  WHERE rn = 1) w ON c.cluster_name = w.cluster_name
LEFT JOIN (SELECT cluster_name, string_agg(text, chr(10) ORDER BY review_id) AS sample_reviews FROM (
    SELECT cluster_name, text, review_id, row_number() OVER (PARTITION BY cluster_name ORDER BY review_id) AS pos
    FROM audited WHERE text IS NOT NULL) x WHERE pos <= 15 GROUP BY cluster_name) s
  ON c.cluster_name = s.cluster_name"""))
def k3_marketing_context(spark, sf):
    return cx.marketing_context(_aud_pinned(spark, sf))


ARTICLES_SQL = """
SELECT cluster_name, CAST(NULL AS VARCHAR) AS error,
  CASE WHEN coalesce(context, '') = '' THEN concat('[Not enough product data for cluster: ', cluster_name, ']')
  ELSE concat('# ', cluster_name, chr(10), chr(10), '## TOP 3 PRODUCTS', chr(10),
    array_to_string(list_transform(p[1:len(p) - 1], lambda x: concat('- **', x, '**', chr(10))), ''),
    chr(10), '## PRODUCT TO AVOID', chr(10), '- ', coalesce(p[len(p)], 'none'), chr(10), chr(10), '## Verdict', chr(10), chr(10),
    'Based on ', CAST(greatest(len(p) - 1, 0) AS VARCHAR), ' ranked products in ', cluster_name, '.') END AS article
FROM (SELECT *, list_transform(list_filter(string_split(context, chr(10)), lambda x: starts_with(x, 'PRODUCT: ')),
                               lambda x: substr(x, 10)) AS p FROM ctx) t"""
ARTICLE_STAGES = CTX_STAGES + [("ctx", CTX_SQL), ("articles", ARTICLES_SQL)]


def html_sql(col: str, key: str, source: str) -> str:
    """C15 in SQL, by lines as the expression does it."""
    bold = r"regexp_replace(x, '(?s)\*\*(.+?)\*\*', '<strong>\1</strong>', 'g')"
    return rf"""
SELECT {key}, array_to_string(list_transform(string_split(joined, chr(10) || chr(10)), lambda b0:
    list_transform([regexp_replace(b0, '^\s+|\s+$', '', 'g')], lambda b:
      CASE WHEN b = '' OR regexp_matches(b, '^<(h[23]|ul)>') THEN b
           ELSE concat('<p>', replace(b, chr(10), ' '), '</p>') END)[1]), chr(10)) AS html
FROM (SELECT {key}, array_to_string(list_transform(lines, lambda x, i: concat(
        CASE WHEN x.item AND NOT (i > 1 AND coalesce(lines[greatest(i - 1, 1)].item, false)) THEN '<ul>' ELSE '' END, x.html,
        CASE WHEN i < len(lines) THEN chr(10) ELSE '' END,
        CASE WHEN x.item AND NOT coalesce(lines[i + 1].item, false) THEN '</ul>' ELSE '' END)), '') AS joined
  FROM (SELECT {key}, list_transform(list_transform(string_split(
            replace(replace(replace({col}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10)), lambda x: {bold}),
          lambda t: {{'item': len(t) > 2 AND (starts_with(t, '- ') OR starts_with(t, '* ')),
                     'html': CASE WHEN len(t) > 2 AND (starts_with(t, '- ') OR starts_with(t, '* ')) THEN concat('<li>', substr(t, 3), '</li>')
                       WHEN starts_with(t, '### ') AND len(t) > 4 THEN concat('<h3>', substr(t, 5), '</h3>')
                       WHEN starts_with(t, '## ') AND len(t) > 3 THEN concat('<h2>', substr(t, 4), '</h2>')
                       WHEN starts_with(t, '# ') AND len(t) > 2 THEN concat('<h2>', substr(t, 3), '</h2>') ELSE t END}}) AS lines
        FROM {source}) l) j"""


def words_sql(col: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(coalesce({col}, ''), '\s+'), lambda x: x <> ''))"


def _articles(spark, sf):
    return cx.generate_articles(cx.cluster_context(_aud_pinned(spark, sf), by=BY))


@register("k4_generate_articles", audit_sql("SELECT cluster_name, article, error FROM articles", more=ARTICLE_STAGES))
def k4_generate_articles(spark, sf):
    return _articles(spark, sf)


@register("k5_article_report", audit_sql(f"""
SELECT cluster_name, CAST(n AS INTEGER) AS n_words, CASE WHEN n > 100 THEN 'Success' WHEN n > 0 THEN 'Short' ELSE 'Failed' END AS status
FROM (SELECT cluster_name, {words_sql('article')} AS n FROM articles) t""", more=ARTICLE_STAGES))
def k5_article_report(spark, sf):
    return cx.article_report(_articles(spark, sf))


@register("k5_coverage_report", audit_sql("""
SELECT a.*, r.* FROM (SELECT CAST(count_if(length(article) > 0) AS BIGINT) AS articles_generated, count(*) AS clusters_total FROM articles) a,
  (SELECT CAST(count_if(cluster_name <> 'Other') AS BIGINT) AS reviews_clustered, count(*) AS reviews_total FROM audited) r""",
                                          more=ARTICLE_STAGES))
def k5_coverage_report(spark, sf):
    aud = _aud_pinned(spark, sf)
    return cx.coverage_report(cx.generate_articles(cx.cluster_context(aud, by=BY)), aud)


@register("k6_chunk_text", fx.with_views("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS chunk
FROM (SELECT doc_id, text,
             unnest(range(0, CAST(greatest(ceil(length(coalesce(text, '')) / 2000), 1) AS BIGINT))) AS i
      FROM documents) t"""))
def k6_chunk_text(spark, sf):
    return cx.chunk_text(fx.table(spark, sf, "documents"), 2000, key="doc_id")


@register("k7_digest_rows", audit_sql(
    "SELECT regexp_replace(replace(replace(lower(cluster_name), ' ', '-'), '&', 'and'), '[^a-z0-9-]', '', 'g') AS anchor, "
    "cluster_name AS title, html FROM html", more=ARTICLE_STAGES + [("html", html_sql("article", "cluster_name", "articles"))]))
def k7_digest_rows(spark, sf):
    return cx.digest_rows(_articles(spark, sf))


#: Documents made into markdown: headings, bold words, lists, marks to escape.
MARKDOWN = ("'# ' || source || ' & co\n\n## <' || lang || '>\n- **' || lang || '** one\n* two\n\nplain **b** text\n- three\n\n### TOP 3\n' "
            "|| coalesce(text, '') || '\n\n\n## Product to avoid\n' || source || '\n##\n## Marketing action plan'")
MARKDOWN_SQL = "SELECT doc_id, " + MARKDOWN.replace("\n", "' || chr(10) || '") + " AS md FROM documents"


def _markdown(spark, sf):
    return fx.table(spark, sf, "documents").selectExpr("doc_id", f"{MARKDOWN} AS md")


@register("c15_markdown_to_html", fx.with_views(html_sql("md", "doc_id", "md"), extra=[("md", MARKDOWN_SQL)]))
def c15_markdown_to_html(spark, sf):
    return _markdown(spark, sf).select("doc_id", markdown_to_html(F.col("md")).alias("html"))


@register("c17_split_sections", fx.with_views(r"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_index,
  CASE WHEN starts_with(upper(s), 'TOP 3') THEN 'top_products' WHEN starts_with(upper(s), 'PRODUCT TO AVOID') THEN 'avoid'
       ELSE 'action_plan' END AS kind,
  CASE WHEN contains(s, chr(10)) THEN regexp_replace(substr(s, instr(s, chr(10)) + 1), '^\s+|\s+$', '', 'g') ELSE '' END AS body
FROM (SELECT doc_id, i, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS s
      FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
            FROM (SELECT doc_id, string_split(replace(md, '### TOP', '## TOP'), '##') AS parts FROM md) a) b) c
WHERE starts_with(upper(s), 'TOP 3') OR starts_with(upper(s), 'PRODUCT TO AVOID') OR starts_with(upper(s), 'MARKETING ACTION PLAN')""",
    extra=[("md", MARKDOWN_SQL)]))
def c17_split_sections(spark, sf):
    docs = _markdown(spark, sf).withColumn("md", F.expr("replace(md, '### TOP', '## TOP')"))
    return cx.split_sections(docs, text="md", key="doc_id")


@register("g7_recent_reviews", audit_sql("""
SELECT * FROM (
  SELECT cluster_name, review_id, CAST(row_number() OVER (PARTITION BY cluster_name ORDER BY review_id) AS INTEGER) AS position
  FROM audited WHERE text IS NOT NULL) t
WHERE position <= 8"""))
def g7_recent_reviews(spark, sf):
    return rk.recent_reviews(_aud(spark, sf), n=8).select("cluster_name", "review_id", "position")
