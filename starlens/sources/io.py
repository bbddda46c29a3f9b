"""Sources and sinks.

CSV files are read with ``multiLine``, as review texts and product names hold
line breaks inside quotes; a file known to have none can be read in splits with
``multi_line=False``. Schemas can be given explicitly (preferred at scale: no
inference pass). Writers overwrite atomically per output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.operators.clean import trim_column_names
from starlens.operators.joins import canonical_key


def read_reviews(spark: SparkSession, path: str, schema=None, fmt: str | None = None,
                 glob: str | None = None, multi_line: bool = True) -> DataFrame:
    """A1: headered CSV (or parquet/json by extension or ``fmt``); A3 via ``glob``
    on file names, or a pattern in ``path``.

    Give a schema where the data are large: without one a CSV is read once
    more to infer it. Empty CSV fields are null. Line breaks inside quotes are
    part of the field, and a file is one task; ``multi_line=False`` reads a file
    in splits and is right only where no field has a line break."""
    fmt = fmt or ("parquet" if path.endswith(".parquet") else
                  "json" if path.endswith(".json") else "csv")
    reader = spark.read.format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        reader = (reader.option("header", "true").option("multiLine", str(multi_line).lower())
                        .option("escape", '"').option("quote", '"'))
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    elif schema is not None:
        reader = reader.schema(schema)
    return trim_column_names(reader.load(path))


def read_catalog(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A2: product catalogue; names are canonicalised (CRLF -> LF) so they
    join with review names."""
    df = read_reviews(spark, path, schema, multi_line=True)
    return df.withColumn("name", canonical_key(F.col("name")))


def find_inputs(spark: SparkSession, pattern: str) -> list[str]:
    """A3: paths that match a glob pattern in any store Spark reads, sorted."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(f.getPath().toString() for f in found or [])


def select_input(paths: list[str], token: str) -> str | None:
    """A3: the first path whose file name contains ``token``."""
    return next((p for p in paths if token in p.rsplit("/", 1)[-1]), None)


def profile_schema(df: DataFrame, preview: int = 3):
    """A4: (column list, row count, column count, preview rows)."""
    return df.columns, df.count(), len(df.columns), df.limit(preview)


def profile_table(df: DataFrame) -> DataFrame:
    """A4 as a DataFrame: one row with the row and column counts."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """A5: persist a table (overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        (w.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
          .option("ignoreTrailingWhiteSpace", "false").csv(path))
    else:
        w.format(fmt).save(path)


def write_articles(df: DataFrame, path: str) -> None:
    """One JSON object per cluster, non-ASCII kept as is."""
    (df.select("cluster_name", "article").write.mode("overwrite")
       .option("ignoreNullFields", "false").json(path))
