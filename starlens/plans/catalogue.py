"""From reviews to a catalogue: products are clustered by the words of their
reviews, clusters get readable names, and the table is written as the catalogue
that the digest reads (J1-J3, J8, J11, J12, A5, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.operators import features as ft
from starlens.operators.sparse_models import spherical_kmeans
from starlens.session import cut_lineage, pin_rows
from starlens.sources import io


def product_weights(reviews: DataFrame, product: str = "name", text: str = "text") -> DataFrame:
    """Unit TF-IDF rows (product, term, term_index, weight): a product's document
    is all of its reviews, counted review by review and added up, so no text of a
    popular product is ever put together. Its norm is a sum that is joined, for a
    window would put all its terms into one task. Reviews without product do not
    count."""
    reviews = reviews.filter(F.col(product).isNotNull())
    tf, _ = ft.counted_terms(reviews, text, product)
    tf = pin_rows(tf.groupBy(product, "term").agg(F.sum("tf").alias("tf")))
    n = reviews.select(product).distinct().count()
    vocab = cut_lineage(ft.vocabulary(tf, n, max_df=1.0))
    raw = pin_rows(ft.raw_tfidf(tf, ft.near_vocabulary(vocab), n, product))
    norms = pin_rows(raw.groupBy(product).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__norm")))
    return raw.join(ft.near_table(norms, 1), product).select(
        product, "term", "term_index", (F.col("w") / F.col("__norm")).alias("weight"))


def product_catalogue(reviews: DataFrame, k: int, path: str, product: str = "name", text: str = "text",
                      rating: str = "rating", n_words: int = 3) -> DataFrame:
    """``name, cluster_name, rating`` of every product, written to ``path`` as
    CSV and read again. A cluster is named by its ``n_words`` strongest terms;
    products without any term shared with another one go to ``Other``. Terms are
    numbers but for the few that name a cluster."""
    terms = pin_rows(product_weights(reviews, product, text))
    weights = ft.numbered(terms, product)
    clusters = spherical_kmeans(weights, [k], key=product).of(k, product)
    keywords = cut_lineage(ft.cluster_keywords(weights, clusters, n_words, product, "cluster"))
    chosen = keywords.select(F.col("term").alias("term_index")).distinct()
    spelled = ft.spelled(keywords, terms.join(F.broadcast(chosen), "term_index").select("term_index", "term").distinct())
    names = ft.keyword_names(spelled, n_words, "cluster")
    named = ft.name_clusters(clusters, names, "cluster").select(product, "cluster_label")
    stats = reviews.filter(F.col(product).isNotNull()).groupBy(product).agg(F.avg(rating).alias("rating"))
    out = stats.join(named, product, "left").select(
        F.col(product).alias("name"), F.coalesce("cluster_label", F.lit("Other")).alias("cluster_name"), "rating")
    io.write_table(out, path, fmt="csv")
    return io.read_catalog(reviews.sparkSession, path, out.schema)
