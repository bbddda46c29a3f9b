"""Review-shaped views over the driver's tables.

The reference reads a review CSV and a product catalogue CSV; the test data
are TPC-H-like tables plus generated prose. These builders give the same
shapes (see FIXTURES.md) so every operator runs over whole tables. The SQL
text in ``VIEW_SQL`` is the same definition for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table, created once per session and path (file listing and
    footer reads are not repeated for every query that uses it)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    k = (spark.sparkContext.applicationId, id(spark), path)
    if k not in _TABLES:
        _TABLES[k] = spark.read.parquet(path)
    return _TABLES[k]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product catalogue: name, cluster_name, rating, categories."""
    p = table(spark, sf_dir, "part")
    return (p.filter(F.col("p_size") <= 45)
             .select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"),
                     F.col("p_type").alias("cluster_name"),
                     (F.lit(3) + F.col("p_size") % 3).cast("double").alias("rating"),
                     F.concat(F.col("p_brand"), F.lit(","), F.col("p_type")).alias("categories")))


def reviews_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large numeric review table (no text) derived from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("rating"),
        F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1)
         .otherwise(2).alias("pred_label"),
        (F.col("l_discount") * 10).alias("logit_neg"),
        (F.col("l_tax") * 10).alias("logit_neu"),
        ((F.col("l_quantity") % 7) / 2).alias("logit_pos"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
    )


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty text reviews derived from documents."""
    d = table(spark, sf_dir, "documents")
    first_line = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    k = F.col("doc_id")
    rating = (F.when(k % 11 == 0, F.lit(None).cast("string"))
               .when(k % 11 == 1, F.lit("n/a"))
               .when(k % 11 == 2, F.lit("4.7"))
               .when(k % 11 == 3, F.lit("0"))
               .when(k % 11 == 4, F.lit(" 5 "))
               .otherwise((F.lit(1) + k % 5).cast("string")))
    return d.select(
        k.alias("review_id"),
        rating.alias("review_rating"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(first_line).alias("review_title"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.expr("substr(text, length(split_part(text, chr(10), 1)) + 2)"))
         .alias("review_text"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("name"),
        F.col("lang").alias("cluster_name"),
    )


# The fixture lexicon (word, valence) over words of the generated prose.
FIXTURE_LEXICON = [
    ("keit", 1.8), ("lich", 2.4), ("ther", 1.9), ("thon", 2.4), ("thble", 1.5),
    ("anea", 2.7), ("thly", 0.9), ("sich", -1.3), ("heit", -2.1), ("thing", -2.2),
    ("ered", -1.1), ("erer", -1.6), ("thed", -0.8), ("inth", -3.1),
]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE_LEXICON, "word string, valence double")


# ---------------------------------------------------------------------------
# Same views as SQL text, for the DuckDB oracle (FIXTURES.md §2).
VIEW_SQL = {
    "catalog": """
SELECT concat('part-', CAST(p_partkey AS VARCHAR)) AS name, p_type AS cluster_name,
       CAST(3 + p_size % 3 AS DOUBLE) AS rating, concat(p_brand, ',', p_type) AS categories
FROM part WHERE p_size <= 45""",
    "reviews_num": """
SELECT l_partkey AS product_id, concat('part-', CAST(l_partkey AS VARCHAR)) AS name,
       CAST(ceil(l_quantity / 10) AS INTEGER) AS rating,
       CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS pred_label,
       l_discount * 10 AS logit_neg, l_tax * 10 AS logit_neu, (l_quantity % 7) / 2 AS logit_pos,
       l_orderkey AS ord, l_linenumber AS line
FROM lineitem""",
    "reviews_raw": """
SELECT doc_id AS review_id,
       CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '4.7' WHEN 3 THEN '0'
            WHEN 4 THEN ' 5 ' ELSE CAST(1 + doc_id % 5 AS VARCHAR) END AS review_rating,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS review_title,
       CASE WHEN doc_id % 13 = 0 THEN NULL
            ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS review_text,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS name, lang AS cluster_name
FROM documents""",
    "lexicon": "SELECT word, CAST(valence AS DOUBLE) AS valence FROM (VALUES "
               + ", ".join(f"('{w}', {v})" for w, v in FIXTURE_LEXICON)
               + ") AS t(word, valence)",
}


def with_views(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named fixture views (and extra CTEs)."""
    ctes = [f"{v} AS ({VIEW_SQL[v]}\n)" for v in views]
    ctes += [f"{name} AS ({sql}\n)" for name, sql in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
