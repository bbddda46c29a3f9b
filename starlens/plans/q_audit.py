r"""Registered cleaning / audit queries over ``reviews_raw`` (+ lexicon):
B4-B9, B13, B14, B16, C1-C8, C13, C14, C16, D3, D4, F3-F6, F19, F20."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions import labels as lb
from starlens.functions import text as tx
from starlens.operators import aggregates as agg
from starlens.operators import filters as flt
from starlens.operators.audit import class_weights
from starlens.operators.clean import clean_reviews, drop_short, valid_rating
from starlens.operators.lexicon import FULL, polarity_scores
from starlens.operators.metrics import confusion_matrix
from starlens.plans.audit import audited_reviews, conflicted_reviews, scored_reviews
from starlens.plans.registry import register, rounded
from starlens.sources import fixtures as fx

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


# B4/B5/B6 columns over every raw row.
FILLED_SQL = rf"""
SELECT review_id, cluster_name, review_rating,
       CASE WHEN isnan(TRY_CAST(review_rating AS DOUBLE)) THEN NULL
            ELSE TRY_CAST(review_rating AS DOUBLE) END AS rating,
       coalesce(review_title, '') AS review_title, coalesce(review_text, '') AS review_body,
       coalesce(name, 'Unknown') AS product
FROM reviews_raw"""

COMPOSED_SQL = rf"""
SELECT *, regexp_replace({_strip("concat(" + _strip("review_title") + ", '. ', " + _strip("review_body") + ")")},
                         '^\.\s*', '') AS text
FROM filled"""

SHORT_SQL = """SELECT * FROM composed WHERE rating IS NOT NULL AND text IS NOT NULL AND length(text) > 5"""

CLEAN_SQL = """
SELECT review_id, cluster_name, rating, review_title, review_body, product, text, product AS name,
       CASE WHEN rating <= 2 THEN 0 WHEN rating = 3 THEN 1 ELSE 2 END AS star_label,
       CASE WHEN rating <= 2 THEN 'Negative' WHEN rating = 3 THEN 'Neutral' ELSE 'Positive' END AS star_label_name
FROM (SELECT * REPLACE (CAST(trunc(rating) AS INTEGER) AS rating) FROM short
      WHERE rating >= 1 AND rating < 6) t"""

TOKENS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')"
CORE = r"lower(regexp_replace(tok, '^[\p{P}\p{S}]+|[\p{P}\p{S}]+$', '', 'g'))"

SCORED_SQL = rf"""
SELECT c.* EXCLUDE (n_tokens, S, P, N, U),
  CASE WHEN n_tokens = 0 OR P + abs(N) + U = 0 THEN CAST(0.0 AS DOUBLE) ELSE round(abs(N / (P + abs(N) + U)), 3) END AS lex_neg,
  CASE WHEN n_tokens = 0 OR P + abs(N) + U = 0 THEN CAST(0.0 AS DOUBLE) ELSE round(abs(U / (P + abs(N) + U)), 3) END AS lex_neu,
  CASE WHEN n_tokens = 0 OR P + abs(N) + U = 0 THEN CAST(0.0 AS DOUBLE) ELSE round(abs(P / (P + abs(N) + U)), 3) END AS lex_pos,
  CASE WHEN n_tokens = 0 THEN CAST(0.0 AS DOUBLE)
       ELSE round(greatest(least(S / sqrt(S * S + 15.0), 1.0), -1.0), 4) END AS lex_compound
FROM (
  SELECT c.*, len({TOKENS}) AS n_tokens, coalesce(h.s, 0.0) AS S, coalesce(h.pos, 0.0) AS P,
         coalesce(h.neg, 0.0) AS N, CAST(len({TOKENS}) - coalesce(h.n_polar, 0) AS DOUBLE) AS U
  FROM clean c LEFT JOIN (
    SELECT review_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0.0 END) AS pos,
           sum(CASE WHEN v < 0 THEN v - 1 ELSE 0.0 END) AS neg, count_if(v <> 0) AS n_polar
    FROM (SELECT t.review_id, l.valence AS v
          FROM (SELECT review_id, unnest({TOKENS}) AS tok FROM clean) t
          JOIN lexicon l ON {CORE} = l.word) x
    GROUP BY review_id) h ON c.review_id = h.review_id) c"""


def _lbl(col: str, t: float) -> str:
    return f"CASE WHEN {col} >= {t} THEN 2 WHEN {col} <= -{t} THEN 0 ELSE 1 END"


def _name(col: str) -> str:
    return f"CASE {col} WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END"


LABELED_SQL = f"""
SELECT *, {_name('lex_label')} AS lex_label_name, {_name('lex_strict_label')} AS lex_strict_label_name
FROM (SELECT *, {_lbl('lex_compound', 0.05)} AS lex_label, {_lbl('lex_compound', 0.35)} AS lex_strict_label
      FROM scored) t"""

CONFLICT_SQL = """
SELECT *, conflict_type = 'agree' AS agree,
       CASE WHEN conflict_type = 'agree' THEN 1.0
            WHEN conflict_type IN ('star_polar_text_mixed', 'neutral_star_strong_text') THEN 0.7
            WHEN conflict_type IN ('low_star_positive_text', 'high_star_negative_text') THEN 0.3
            ELSE 0.5 END::DOUBLE AS quality_weight
FROM (SELECT *, CASE WHEN star_label = lex_strict_label THEN 'agree'
        WHEN star_label = 0 AND lex_strict_label = 2 THEN 'low_star_positive_text'
        WHEN star_label = 2 AND lex_strict_label = 0 THEN 'high_star_negative_text'
        WHEN star_label = 1 AND lex_strict_label IN (0, 2) THEN 'neutral_star_strong_text'
        WHEN star_label IN (0, 2) AND lex_strict_label = 1 THEN 'star_polar_text_mixed'
        ELSE 'other_conflict' END AS conflict_type FROM labeled) t"""

WEIGHTS_SQL = """
SELECT *, quality_weight * class_weight AS sample_weight
FROM (SELECT a.*, coalesce(w.class_weight, 1.0) AS class_weight FROM conflicts a
      LEFT JOIN (SELECT star_label, CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c) AS class_weight
                 FROM (SELECT star_label, count(*) AS n_c FROM conflicts GROUP BY star_label) c) w
      ON a.star_label = w.star_label) t"""

STAGES = [("filled", FILLED_SQL), ("composed", COMPOSED_SQL), ("short", SHORT_SQL),
          ("clean", CLEAN_SQL), ("scored", SCORED_SQL), ("labeled", LABELED_SQL),
          ("conflicts", CONFLICT_SQL), ("audited", WEIGHTS_SQL)]


def audit_sql(body: str, upto: str = "audited", more: list | None = None) -> str:
    names = [n for n, _ in STAGES]
    extra = STAGES[: names.index(upto) + 1] + list(more or [])
    views = ("reviews_raw", "lexicon") if names.index(upto) >= names.index("scored") else ("reviews_raw",)
    return fx.with_views(body, *views, extra=extra)


def _raw(spark, sf):
    return fx.reviews_raw(spark, sf)


def _filled(spark, sf):
    raw = _raw(spark, sf)
    return raw.select("review_id", "cluster_name", "review_rating",
                      tx.coerce_rating("review_rating").alias("rating"),
                      tx.fill_text("review_title").alias("review_title"),
                      tx.fill_text("review_text").alias("review_body"),
                      tx.fill_text("name", "Unknown").alias("product"))


def _composed(spark, sf):
    return _filled(spark, sf).withColumn("text", tx.compose_text("review_title", "review_body"))


def _audited(spark, sf):
    """The audited table up to the conflicts: what needs no weights."""
    return conflicted_reviews(_raw(spark, sf), fx.lexicon(spark))


@register("b4_coerce_rating", audit_sql(
    "SELECT review_id, review_rating, rating FROM filled", upto="filled"))
def b4_coerce_rating(spark, sf):
    return _filled(spark, sf).select("review_id", "review_rating", "rating")


@register("b5_fill_text", audit_sql(
    "SELECT review_id, review_title, review_body, product FROM filled", upto="filled"))
def b5_fill_text(spark, sf):
    return _filled(spark, sf).select("review_id", "review_title", "review_body", "product")


@register("b6_compose_text", audit_sql("SELECT review_id, text FROM composed", upto="composed"))
def b6_compose_text(spark, sf):
    return _composed(spark, sf).select("review_id", "text")


@register("b7_drop_short", audit_sql("SELECT review_id, rating, text FROM short", upto="short"))
def b7_drop_short(spark, sf):
    return drop_short(_composed(spark, sf)).select("review_id", "rating", "text")


@register("b8_valid_rating", audit_sql(
    "SELECT review_id, CAST(trunc(rating) AS INTEGER) AS rating FROM filled WHERE rating >= 1 AND rating < 6",
    upto="filled"))
def b8_valid_rating(spark, sf):
    return valid_rating(_filled(spark, sf)).select("review_id", "rating")


@register("b9_clean_reviews", audit_sql("""
SELECT review_id, cluster_name, rating, review_title, review_body, product, name, text, star_label,
       star_label_name FROM clean""", upto="clean"))
def b9_clean_reviews(spark, sf):
    return clean_reviews(_raw(spark, sf)).select(
        "review_id", "cluster_name", "rating", "review_title", "review_body", "product", "name",
        "text", "star_label", "star_label_name")


@register("c1_star_label", audit_sql(
    "SELECT star_label, count(*) AS count FROM clean GROUP BY star_label", upto="clean"))
def c1_star_label(spark, sf):
    return agg.value_counts(clean_reviews(_raw(spark, sf)), "star_label")


@register("c2_label_name", audit_sql(f"""
SELECT review_id, star_label_name,
       CASE star_label_name WHEN 'Negative' THEN 0 WHEN 'Neutral' THEN 1 WHEN 'Positive' THEN 2 END AS label_id
FROM clean""", upto="clean"))
def c2_label_name(spark, sf):
    df = clean_reviews(_raw(spark, sf))
    return df.select("review_id", "star_label_name", lb.label_id("star_label_name").alias("label_id"))


@register("c3_lexicon_polarity", audit_sql(
    "SELECT review_id, lex_neg, lex_neu, lex_pos, lex_compound FROM scored", upto="scored"))
def c3_lexicon_polarity(spark, sf):
    return rounded(polarity_scores(clean_reviews(_raw(spark, sf)), fx.lexicon(spark)))


@register("c4_threshold_label", audit_sql("""
SELECT review_id, lex_compound, lex_label, lex_label_name, lex_strict_label, lex_strict_label_name
FROM labeled""", upto="labeled"))
def c4_threshold_label(spark, sf):
    return rounded(_audited(spark, sf).select("review_id", "lex_compound", "lex_label", "lex_label_name",
                                              "lex_strict_label", "lex_strict_label_name"))


@register("c5_conflict_type", audit_sql("""
SELECT review_id, star_label, lex_strict_label, conflict_type, agree FROM conflicts""", upto="conflicts"))
def c5_conflict_type(spark, sf):
    return _audited(spark, sf).select("review_id", "star_label", "lex_strict_label", "conflict_type",
                                      "agree")


@register("c6_quality_weight", audit_sql(
    "SELECT review_id, conflict_type, round(quality_weight, 6) AS quality_weight FROM conflicts",
    upto="conflicts"))
def c6_quality_weight(spark, sf):
    return rounded(_audited(spark, sf).select("review_id", "conflict_type", "quality_weight"))


@register("c7_class_weight", audit_sql("""
SELECT star_label, count(*) AS n_c,
       round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS class_weight
FROM clean GROUP BY star_label""", upto="clean"))
def c7_class_weight(spark, sf):
    return rounded(class_weights(clean_reviews(_raw(spark, sf))))


@register("c8_sample_weight", audit_sql("""
SELECT review_id, round(quality_weight, 6) AS quality_weight, round(class_weight, 6) AS class_weight,
       round(sample_weight, 6) AS sample_weight FROM audited"""))
def c8_sample_weight(spark, sf):
    df = audited_reviews(_raw(spark, sf), fx.lexicon(spark), columns=["review_id", "quality_weight"])
    return rounded(df.select("review_id", "quality_weight", "class_weight", "sample_weight"))


CONFLICT_ORDER = ["agree", "low_star_positive_text", "high_star_negative_text",
                  "neutral_star_strong_text", "star_polar_text_mixed", "other_conflict"]


@register("f3_ordered_counts", audit_sql("""
SELECT CAST(o.position AS INTEGER) AS position, o.conflict_type, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT * FROM (VALUES (0, 'agree'), (1, 'low_star_positive_text'), (2, 'high_star_negative_text'),
        (3, 'neutral_star_strong_text'), (4, 'star_polar_text_mixed'), (5, 'other_conflict'))
        AS t(position, conflict_type)) o
LEFT JOIN (SELECT conflict_type, count(*) AS n FROM conflicts GROUP BY conflict_type) c
  ON o.conflict_type = c.conflict_type""", upto="conflicts"))
def f3_ordered_counts(spark, sf):
    return agg.ordered_counts(_audited(spark, sf), "conflict_type", CONFLICT_ORDER)


@register("f4_histogram", audit_sql("""
SELECT g.bin, round(b.lo + g.bin * ((b.hi - b.lo) / 50), 6) AS lower,
       round(b.lo + (g.bin + 1) * ((b.hi - b.lo) / 50), 6) AS upper, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM grid g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin""", upto="scored", more=[
    ("mm", "SELECT min(lex_compound) AS lo, max(lex_compound) AS hi FROM scored"),
    ("b", "SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM mm"),
    ("grid", "SELECT CAST(i AS INTEGER) AS bin FROM range(50) t(i)"),
    ("c", """SELECT CAST(least(floor((s.lex_compound - b.lo) / (b.hi - b.lo) * 50), 49) AS INTEGER) AS bin,
                  count(*) AS n FROM scored s, b WHERE s.lex_compound IS NOT NULL GROUP BY 1""")]))
def f4_histogram(spark, sf):
    return rounded(agg.histogram(polarity_scores(clean_reviews(_raw(spark, sf)), fx.lexicon(spark)), "lex_compound", 50))


@register("f5_describe", audit_sql("""
SELECT count(sample_weight) AS count, round(avg(sample_weight), 6) AS mean,
       round(stddev_samp(sample_weight), 6) AS std, round(min(sample_weight), 6) AS min,
       round(quantile_cont(sample_weight, 0.25), 6) AS p25, round(quantile_cont(sample_weight, 0.5), 6) AS p50,
       round(quantile_cont(sample_weight, 0.75), 6) AS p75, round(max(sample_weight), 6) AS max
FROM audited"""))
def f5_describe(spark, sf):
    return rounded(agg.describe(audited_reviews(_raw(spark, sf), fx.lexicon(spark), columns=["review_id"]), "sample_weight"))


CONFUSION_SQL = """
SELECT CAST(g.t AS INTEGER) AS true_label, CAST(g.p AS INTEGER) AS pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       round(CASE WHEN sum(coalesce(c.n, 0)) OVER (PARTITION BY g.t) = 0 THEN 0.0
            ELSE coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.t) END, 6) AS row_pct
FROM (SELECT t.i AS t, p.i AS p FROM range(3) t(i), range(3) p(i)) g
LEFT JOIN (SELECT {t} AS t, {p} AS p, count(*) AS n FROM {src} GROUP BY 1, 2) c
  ON g.t = c.t AND g.p = c.p"""


@register("f6_confusion_matrix", audit_sql(
    CONFUSION_SQL.format(t="star_label", p="lex_strict_label", src="labeled"), upto="labeled"))
def f6_confusion_matrix(spark, sf):
    return rounded(confusion_matrix(_audited(spark, sf), "star_label", "lex_strict_label"))


@register("f19_mismatch_rate", audit_sql("""
SELECT count(*) AS n, CAST(count_if(conflict_type IN ('low_star_positive_text', 'high_star_negative_text')) AS BIGINT) AS mismatches,
       round(avg(CASE WHEN conflict_type IN ('low_star_positive_text', 'high_star_negative_text') THEN 1 ELSE 0 END), 6)
         AS mismatch_rate
FROM conflicts""", upto="conflicts"))
def f19_mismatch_rate(spark, sf):
    return rounded(agg.mismatch_rate(_audited(spark, sf)))


@register("f20_rating_polarity_corr", audit_sql("""
SELECT count(*) AS n, round(corr(CAST(rating AS DOUBLE), lex_compound), 6) AS pearson_r FROM scored""",
    upto="scored"))
def f20_rating_polarity_corr(spark, sf):
    return rounded(agg.rating_polarity_corr(scored_reviews(_raw(spark, sf), fx.lexicon(spark))))


@register("d3_drop_strong_conflicts", audit_sql("""
SELECT review_id, conflict_type FROM conflicts
WHERE conflict_type NOT IN ('low_star_positive_text', 'high_star_negative_text')""", upto="conflicts"))
def d3_drop_strong_conflicts(spark, sf):
    return flt.drop_strong_conflicts(_audited(spark, sf)).select("review_id", "conflict_type")


@register("d4_conflict_examples", audit_sql("""
SELECT review_id, rating, star_label_name, round(lex_compound, 6) AS lex_compound, lex_strict_label_name,
       review_title, review_body
FROM conflicts WHERE conflict_type = 'star_polar_text_mixed' ORDER BY review_id LIMIT 20""",
    upto="conflicts"))
def d4_conflict_examples(spark, sf):
    return rounded(flt.conflict_examples(_audited(spark, sf), "star_polar_text_mixed"))


@register("d6_drop_missing_text", audit_sql(
    "SELECT review_id FROM reviews_raw WHERE review_text IS NOT NULL", upto="filled"))
def d6_drop_missing_text(spark, sf):
    return flt.drop_missing_text(_raw(spark, sf), "review_text").select("review_id")


@register("b13_flatten_lines", fx.with_views(r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS flat
FROM documents"""))
def b13_flatten_lines(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", tx.flatten_lines("text").alias("flat"))


@register("b14_clip", fx.with_views("""
SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS clip200,
       substr(text, 1, 55) AS head55 FROM documents"""))
def b14_clip(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", tx.clip("text", 200).alias("clip200"),
                    tx.clip("text", 55, ellipsis=False).alias("head55"))


@register("b16_capitalize_label", audit_sql(f"""
SELECT review_id, concat(upper(substr(lbl, 1, 1)), lower(substr(lbl, 2))) AS label
FROM (SELECT review_id, lower({_name('lex_label')}) AS lbl FROM labeled) t""", upto="labeled"))
def b16_capitalize_label(spark, sf):
    df = _audited(spark, sf)
    return df.select("review_id", tx.capitalize_label(F.lower("lex_label_name")).alias("label"))


@register("c14_slug", fx.with_views(r"""
SELECT DISTINCT p_type AS cluster_name,
       regexp_replace(replace(replace(lower(p_type), ' ', '-'), '&', 'and'), '[^a-z0-9-]', '', 'g') AS slug
FROM part"""))
def c14_slug(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(F.col("p_type").alias("cluster_name")).distinct().select(
        "cluster_name", tx.slug("cluster_name").alias("slug"))


@register("c16_article_status", fx.with_views(r"""
SELECT doc_id, n_words, CASE WHEN n_words > 100 THEN 'Success' WHEN n_words > 0 THEN 'Short' ELSE 'Failed' END AS status
FROM (SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) = 0 THEN 0
             ELSE CAST(len(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS INTEGER) END AS n_words
      FROM documents) t"""))
def c16_article_status(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", tx.word_count("text").alias("n_words"), tx.article_status("text").alias("status"))


@register("c13_review_card", audit_sql(r"""
SELECT review_id, substr(coalesce(name, 'Anonymous'), 1, 20) AS "user",
       upper(substr(substr(coalesce(name, 'Anonymous'), 1, 20), 1, 2)) AS initials,
       rating AS stars, concat(repeat('★', rating), repeat('☆', 5 - rating)) AS star_string,
       CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS card_text,
       lower(lex_label_name) AS label
FROM labeled"""
, upto="labeled"))
def c13_review_card(spark, sf):
    df = _audited(spark, sf)
    card = tx.review_card(user="name", rating="rating", text="text", label="lex_label_name")
    return df.select("review_id", *[c.alias(n) for n, c in card.items()])


# --- C3 with the rule set on: same rules in SQL over the whole fixture table --
def _rules_sql() -> str:
    from starlens.operators.lexicon import FULL as R

    def lst(words):
        return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"

    caps = "({t} = upper({t}) AND {t} <> lower({t}))"
    core = r"lower(regexp_replace({t}, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g'))"
    steps, prev = [], "r0"
    for d, dec in zip((1, 2, 3), R.distance_decay):
        pc = core.format(t=f"p{d}")
        sc0 = (f"CASE WHEN list_contains({lst(R.boosters_up)}, {pc}) THEN {R.booster_incr} "
               f"WHEN list_contains({lst(R.boosters_down)}, {pc}) THEN {-R.booster_incr} ELSE 0.0 END")
        sc1 = f"(CASE WHEN {prev} < 0 THEN -({sc0}) ELSE ({sc0}) END)"
        sc2 = (f"(CASE WHEN {sc1} <> 0 AND cap_diff AND {caps.format(t=f'p{d}')} THEN "
               f"(CASE WHEN {prev} > 0 THEN {sc1} + {R.caps_incr} ELSE {sc1} - {R.caps_incr} END) ELSE {sc1} END)")
        b = f"({prev} + coalesce({sc2} * {dec}, 0.0))"
        steps.append(f"SELECT *, CASE WHEN coalesce(list_contains({lst(R.negators)}, {pc}), false) "
                     f"THEN {b} * {R.negation_scalar} ELSE {b} END AS r{d} FROM " + "{src}")
        prev = f"r{d}"
    chain = "hits0"
    for i, st in enumerate(steps):
        chain = "(" + st.replace("{src}", chain) + f") s{i}"
    tok_core = core.format(t="tok")
    return rf"""
WITH base AS (
  SELECT review_id, {TOKENS} AS toks, coalesce(text, '') AS txt FROM clean),
rev AS (
  SELECT review_id, toks, len(toks) AS n_tokens,
         length(txt) - length(replace(txt, '!', '')) AS n_excl, length(txt) - length(replace(txt, '?', '')) AS n_q,
         coalesce(list_bool_or(list_transform(toks, lambda t: {caps.format(t='t')})), false)
           AND coalesce(list_bool_or(list_transform(toks, lambda t: NOT {caps.format(t='t')})), false) AS cap_diff,
         list_position(list_transform(toks, lambda t: {core.format(t='t')}), '{R.but_word}') - 1 AS but_idx
  FROM base),
tok AS (
  SELECT review_id, cap_diff, coalesce(but_idx, -1) AS but_idx, e.pos, e.tok, e.p1, e.p2, e.p3 FROM (
    SELECT review_id, cap_diff, but_idx, unnest(list_transform(toks, lambda t, i: {{'pos': i - 1, 'tok': t,
           'p1': CASE WHEN i > 1 THEN toks[i - 1] END, 'p2': CASE WHEN i > 2 THEN toks[i - 2] END,
           'p3': CASE WHEN i > 3 THEN toks[i - 3] END}})) AS e FROM rev) u),
hits0 AS (
  SELECT t.*, CASE WHEN t.cap_diff AND {caps.format(t='t.tok')}
                   THEN (CASE WHEN l.valence > 0 THEN l.valence + {R.caps_incr} ELSE l.valence - {R.caps_incr} END)
                   ELSE l.valence END AS r0
  FROM tok t JOIN lexicon l ON {tok_core.replace('tok', 't.tok')} = l.word),
vals AS (
  SELECT review_id, CASE WHEN but_idx >= 0 AND pos < but_idx THEN r3 * {R.but_before}
                         WHEN but_idx >= 0 AND pos > but_idx THEN r3 * {R.but_after} ELSE r3 END AS v
  FROM {chain}),
sums AS (
  SELECT review_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0.0 END) AS pos,
         sum(CASE WHEN v < 0 THEN v - 1 ELSE 0.0 END) AS neg, count_if(v <> 0) AS n_polar
  FROM vals GROUP BY review_id),
adj AS (
  SELECT r.review_id, r.n_tokens, coalesce(s.s, 0.0) AS s0, coalesce(s.pos, 0.0) AS pos0,
         coalesce(s.neg, 0.0) AS neg0, CAST(r.n_tokens - coalesce(s.n_polar, 0) AS DOUBLE) AS U,
         least(r.n_excl, {R.exclaim_max}) * {R.exclaim_incr}
           + CASE WHEN r.n_q > 3 THEN {R.question_max_incr} WHEN r.n_q > 1 THEN r.n_q * {R.question_incr} ELSE 0.0 END AS punct
  FROM rev r LEFT JOIN sums s ON r.review_id = s.review_id),
fin AS (
  SELECT review_id, n_tokens, U,
         CASE WHEN s0 > 0 THEN s0 + punct WHEN s0 < 0 THEN s0 - punct ELSE s0 END AS S,
         CASE WHEN pos0 > abs(neg0) THEN pos0 + punct ELSE pos0 END AS P,
         CASE WHEN pos0 < abs(neg0) THEN neg0 - punct ELSE neg0 END AS N
  FROM adj)
SELECT review_id,
  CASE WHEN n_tokens = 0 OR P + abs(N) + U = 0 THEN CAST(0.0 AS DOUBLE) ELSE round(abs(N / (P + abs(N) + U)), 3) END AS lex_neg,
  CASE WHEN n_tokens = 0 OR P + abs(N) + U = 0 THEN CAST(0.0 AS DOUBLE) ELSE round(abs(U / (P + abs(N) + U)), 3) END AS lex_neu,
  CASE WHEN n_tokens = 0 OR P + abs(N) + U = 0 THEN CAST(0.0 AS DOUBLE) ELSE round(abs(P / (P + abs(N) + U)), 3) END AS lex_pos,
  CASE WHEN n_tokens = 0 THEN CAST(0.0 AS DOUBLE)
       ELSE round(greatest(least(S / sqrt(S * S + 15.0), 1.0), -1.0), 4) END AS lex_compound
FROM fin"""


def _rules_oracle() -> str:
    body = _rules_sql()
    # the rule query has its own WITH; splice the fixture stages in front of it
    prefix = fx.with_views("SELECT 1", "reviews_raw", "lexicon", extra=STAGES[:4])
    prefix = prefix[: prefix.rindex("SELECT 1")].rstrip()
    return prefix + ",\n" + body.strip()[len("WITH "):]


@register("c3_lexicon_polarity_rules", _rules_oracle())
def c3_lexicon_polarity_rules(spark, sf):
    return rounded(polarity_scores(clean_reviews(_raw(spark, sf)), fx.lexicon(spark), rules=FULL))
