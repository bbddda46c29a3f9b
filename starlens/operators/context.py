"""Summary context and articles (K1-K7, C17).

Every text assembled here is built from bounded groups: the top k products
and one worst product per cluster (G2), and at most n longest reviews per
product (G5, pruned by ``WindowGroupLimit`` before the shuffle), so no
group grows with the data. The text generator is the one Python extension
point (``mapInPandas``); failures stay in their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions.text import (article_status, clip, flatten_lines, markdown_to_html, slug,
                                     strip_ws, word_count)
from starlens.operators.aggregates import composite_score, product_stats
from starlens.operators.ranking import (recent_reviews, top_and_worst, top_by_volume,
                                        worst_by_rating)


def fmt_fixed(x: Column, digits: int) -> Column:
    """Half-up rounding then fixed formatting (engine-independent)."""
    scale = 10 ** digits
    r = F.floor(x * scale + 0.5) / scale
    if digits == 0:
        return r.cast("long").cast("string")
    return F.format_string(f"%.{digits}f", r)


def digest_stats(df: DataFrame, sentiment: str = "sentiment", min_reviews: int = 3,
                 by: tuple[str, str] = ("cluster_name", "name")) -> DataFrame:
    """F9 + F10 for the digest (count of texts)."""
    stats = product_stats(df, cluster=by[0], name=by[1], sentiment=sentiment, count_col="text",
                          min_reviews=min_reviews)
    return stats.withColumn("score", composite_score())


def _ranked_texts(df: DataFrame, by: tuple[str, str], sentiment: str, key: str,
                  text: str = "text", n: int = 5) -> DataFrame:
    """Praise (5 longest positive), complaints (3 longest negative) and worst
    complaints (5 longest negative) per product from ONE window pruned to n
    rows per (product, sentiment) before its shuffle."""
    src = df.filter(F.col(text).isNotNull() & F.col(sentiment).isin(0, 2))
    for c in by:
        src = src.filter(F.col(c).isNotNull())
    w = Window.partitionBy(*by, sentiment).orderBy(F.length(text).desc(), F.col(key).asc())
    top = (src.select(*by, F.col(sentiment).alias("__s"), F.row_number().over(w).alias("rn"),
                      flatten_lines(F.col(text)).alias("t"))
              .filter(F.col("rn") <= n))

    def joined(cond):
        picked = F.array_sort(F.collect_list(F.when(cond, F.struct("rn", "t"))))
        return F.array_join(F.transform(picked, lambda s: s["t"]), " | ")

    s, rn = F.col("__s"), F.col("rn")
    return top.groupBy(*by).agg(joined((s == 2) & (rn <= 5)).alias("praise"),
                                joined((s == 0) & (rn <= 3)).alias("complaints"),
                                joined((s == 0) & (rn <= 5)).alias("worst_complaints"))


def product_sections(df: DataFrame, sentiment: str = "sentiment", k: int = 3,
                     by: tuple[str, str] = ("cluster_name", "name"),
                     key: str = "review_id") -> DataFrame:
    """K1: one text section per selected product (top k and worst) with its
    praise (5 longest positive texts, clip 700) and complaints (3 longest
    negative, clip 350); the worst row also gets 5 complaints clipped to 550."""
    cluster, name = by
    tw = top_and_worst(digest_stats(df, sentiment, by=by), k=k, cluster=cluster, name=name)
    texts = _ranked_texts(df, by, sentiment, key)
    j = tw.join(texts, list(by), "left")
    praise = F.coalesce("praise", F.lit(""))
    complaints = F.coalesce("complaints", F.lit(""))
    # The wording of a section and of the worst product's line.
    section = F.concat(
        F.lit("PRODUCT: "), F.col(name), F.lit("\nAvg Rating : "), fmt_fixed(F.col("avg_rating"), 1),
        F.lit("/5  |  Total Reviews: "), F.col("review_count").cast("string"),
        F.lit("  |  "), fmt_fixed(F.col("positive_pct") * 100, 0), F.lit("% positive  "),
        fmt_fixed(F.col("negative_pct") * 100, 0), F.lit("% negative\nWhat customers love:\n"),
        clip(praise, 700, ellipsis=False), F.lit("\nMain complaints:\n"),
        clip(complaints, 350, ellipsis=False))
    worst_line = F.concat(
        F.lit("Avg Rating: "), fmt_fixed(F.col("avg_rating"), 1), F.lit("/5  |  "),
        fmt_fixed(F.col("negative_pct") * 100, 0), F.lit("% negative  ("),
        F.col("review_count").cast("string"), F.lit(" reviews)"))
    return j.select(cluster, name, "rank", "is_top", "is_worst",
                    F.when(F.col("is_top"), section).alias("section"),
                    F.when(F.col("is_worst"), worst_line).alias("worst_line"),
                    F.when(F.col("is_worst"), clip(F.coalesce("worst_complaints", F.lit("")), 550,
                                                   ellipsis=False)).alias("worst_complaints"))


def cluster_context(df: DataFrame, sentiment: str = "sentiment", k: int = 3,
                    by: tuple[str, str] = ("cluster_name", "name"), key: str = "review_id",
                    exclude: str = "Other") -> DataFrame:
    """K2: one context text per cluster (null when it has no ranked product)."""
    cluster, name = by
    secs = product_sections(df, sentiment, k, by, key)
    ordered = F.array_sort(F.collect_list(F.when(F.col("is_top"), F.struct("rank", "section"))))
    worst = F.max_by(F.struct(name, "worst_line", "worst_complaints"),
                     F.when(F.col("is_worst"), F.lit(1)).otherwise(F.lit(0)))
    per = secs.groupBy(cluster).agg(
        F.array_join(F.transform(ordered, lambda s: s["section"]), "\n---\n").alias("block"),
        worst.alias("w"))
    # The headings of a cluster's context.
    ctx = F.concat(F.lit("=== TOP PRODUCTS DATA ===\n"), F.col("block"),
                   F.lit("\n\n=== WORST PRODUCT DATA ===\nPRODUCT: "), F.col("w." + name),
                   F.lit("\n"), F.col("w.worst_line"), F.lit("\nCustomer complaints:\n"),
                   F.col("w.worst_complaints"))
    clusters = (df.filter(F.col(cluster).isNotNull() & (F.col(cluster) != exclude))
                  .select(cluster).distinct())
    return clusters.join(per.select(cluster, ctx.alias("context")), cluster, "left")


def marketing_context(df: DataFrame, k: int = 3, n_texts: int = 15, rating: str = "rating",
                      cluster: str = "cluster_name", name: str = "name", text: str = "text",
                      key: str = "review_id") -> DataFrame:
    """K3: per cluster the top k products by volume, the worst by mean rating
    and the first n review texts (key order)."""
    top = top_by_volume(df, k, cluster, name)
    top_names = top.groupBy(cluster).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", name))), lambda s: s[name]), ", ").alias("top_products"))
    worst = worst_by_rating(df, 3, cluster, name, rating)
    sample = recent_reviews(df, n_texts, cluster, text, key)
    texts = sample.groupBy(cluster).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", text))), lambda s: s[text]), "\n")
        .alias("sample_reviews"))
    return (worst.join(top_names, cluster, "left").join(texts, cluster, "left")
                 .select(cluster, "top_products", "worst_name", "sample_reviews"))


ARTICLE_SCHEMA = "cluster_name string, article string, error string"


def template_article(cluster: Column, context: Column) -> Column:
    """Offline default generator as an expression: a markdown article that
    only restates the context (no invented facts)."""
    head = F.lit("PRODUCT: ")
    products = F.transform(F.filter(F.split(context, "\n"), lambda x: x.startswith("PRODUCT: ")),
                           lambda x: F.substr(x, F.length(head) + 1))
    n = F.greatest(F.size(products) - 1, F.lit(0))
    items = F.transform(F.slice(products, F.lit(1), n), lambda x: F.concat(F.lit("- **"), x, F.lit("**\n")))
    return F.concat(F.lit("# "), cluster, F.lit("\n\n## TOP 3 PRODUCTS\n"), F.array_join(items, ""),
                    F.lit("\n## PRODUCT TO AVOID\n- "), F.coalesce(F.get(products, F.size(products) - 1), F.lit("none")),
                    F.lit("\n\n## Verdict\n\nBased on "), n.cast("string"), F.lit(" ranked products in "), cluster, F.lit("."))


def generate_articles(ctx: DataFrame, generator: Callable[[str, str], str] | None = None,
                      cluster: str = "cluster_name", context: str = "context",
                      tasks: int | None = None) -> DataFrame:
    """K4: one article per cluster; an empty context gets the 'not enough
    data' text. Without ``generator`` the template expression writes it. A
    Python generator runs with ``mapInPandas`` in ``tasks`` tasks (default:
    the session's parallelism); a failing row gets ``article = ''`` and the
    error text."""
    none = F.coalesce(F.col(context), F.lit("")) == ""
    missing = F.concat(F.lit("[Not enough product data for cluster: "), F.col(cluster), F.lit("]"))
    if generator is None:
        return ctx.select(F.col(cluster).alias("cluster_name"),
                          F.when(none, missing).otherwise(template_article(F.col(cluster), F.col(context))).alias("article"),
                          F.lit(None).cast("string").alias("error"))

    def run(batches):
        import pandas as pd
        for pdf in batches:
            arts, errs = [], []
            for c, x, instead in zip(pdf["cluster_name"], pdf["context"], pdf["instead"]):
                article, error = instead, None
                if article is None:
                    try:
                        article = str(generator(c, x))
                    except Exception as e:  # noqa: BLE001 - isolate the failure to its row
                        article, error = "", f"{type(e).__name__}: {e}"
                arts.append(article)
                errs.append(error)
            yield pd.DataFrame({"cluster_name": pdf["cluster_name"], "article": arts, "error": errs})

    rows = ctx.select(F.col(cluster).alias("cluster_name"), F.col(context).alias("context"),
                      F.when(none, missing).alias("instead"))
    return (rows.repartition(tasks or ctx.sparkSession.sparkContext.defaultParallelism, "cluster_name")
                .mapInPandas(run, ARTICLE_SCHEMA))


def article_report(articles: DataFrame, article: str = "article") -> DataFrame:
    """K5 per cluster: word count and status."""
    return articles.select("cluster_name", word_count(F.col(article)).alias("n_words"),
                           article_status(F.col(article)).alias("status"))


def coverage_report(articles: DataFrame, reviews: DataFrame, cluster: str = "cluster_name",
                    exclude: str = "Other") -> DataFrame:
    """K5 totals: clusters with a non-empty article / all clusters; reviews
    in a real cluster / all reviews."""
    a = articles.agg(F.count_if(F.length(F.coalesce("article", F.lit(""))) > 0).alias("articles_generated"),
                     F.count("*").alias("clusters_total"))
    r = reviews.agg(F.count_if(F.col(cluster) != exclude).alias("reviews_clustered"),
                    F.count("*").alias("reviews_total"))
    return a.withColumn("__one", F.lit(1)).join(r.withColumn("__one", F.lit(1)), "__one").drop("__one")


def chunk_text(df: DataFrame, max_len: int, text: str = "text", key: str = "review_id") -> DataFrame:
    """K6: split each text into ordered chunks of at most ``max_len`` chars (an
    empty text is one empty chunk, a null one a null chunk). One pass over the
    text cuts all chunks within the row; they are exploded then, so no row
    carries the whole text."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{int(max_len)}}}"), F.lit(0))
    cut = df.select(key, F.when(F.size(found) > 0, found).otherwise(F.array(F.col(text))).alias("__chunks"))
    return cut.select(key, F.posexplode("__chunks").alias("chunk_index", "chunk"))


def digest_rows(articles: DataFrame, cluster: str = "cluster_name", article: str = "article") -> DataFrame:
    """K7: anchor slug, title and HTML body per cluster, in cluster order."""
    return (articles.select(slug(F.col(cluster)).alias("anchor"), F.col(cluster).alias("title"),
                            markdown_to_html(F.coalesce(F.col(article), F.lit(""))).alias("html"))
                    .orderBy("title"))


# Section headings of the marketing summary and their kinds.
SECTION_KINDS = [("TOP 3", "top_products"), ("PRODUCT TO AVOID", "avoid"),
                 ("MARKETING ACTION PLAN", "action_plan")]


def split_sections(df: DataFrame, text: str = "article", key: str = "cluster_name") -> DataFrame:
    """C17: split on '##', strip, drop blanks, classify by the upper-cased
    heading prefix; body = the lines after the first. Unknown headings drop."""
    parts = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "##"))
                      .alias("section_index", "raw"))
    s = strip_ws(F.col("raw"))
    kind = F.lit(None).cast("string")
    for prefix, k in reversed(SECTION_KINDS):
        kind = F.when(F.upper(s).startswith(prefix), k).otherwise(kind)
    body = strip_ws(F.array_join(F.slice(F.split(s, "\n"), 2, 1 << 30), "\n"))
    out = parts.select(key, F.col("section_index").cast("int").alias("section_index"),
                       kind.alias("kind"), body.alias("body"), (F.length(s) > 0).alias("__nonblank"))
    return out.filter(F.col("__nonblank") & F.col("kind").isNotNull()).drop("__nonblank")
