"""Structured Streaming (L1-L4).

* L4 ``stream_source``: file stream with an explicit schema, bounded by files
  or bytes a trigger; ``ingest_bounded`` stops at a number of rows.
* L3 ``enrich_stream``: stream-static left join with the catalogue
  (broadcast when proven small, as in batch).
* L2 ``streaming_kpis``: stateful ``groupBy`` aggregate in update mode: a batch
  writes the keys that it changed, readers take the last row of each key.
* L1 ``score_stream``: scoring works within a row, so each micro-batch is
  scored as a batch job inside ``foreachBatch`` and the state store holds
  nothing. Class counts run along: each batch writes its own, and weights come
  from the sum of all, so they are those of the whole stream so far.

Sinks and checkpoints live under the session's checkpoint dir (shared
storage on a cluster), and every query restarts from its checkpoint after a
failure; the parquet sink is idempotent per batch id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.functions.labels import normalize_label
from starlens.operators.audit import weights_from_counts
from starlens.operators.joins import attach_cluster
from starlens.operators.sampling import bounded_sample
from starlens.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def stream_source(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None,
                  max_bytes_per_trigger: int | None = None) -> DataFrame:
    """L4: bounded-memory file stream; one of the two bounds may be given."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return reader.load(path)


def finished_batches(spark: SparkSession, sink_path: str) -> list[int]:
    """Batches whose folder under ``sink_path`` was written whole, in order.
    What is known of them lies in the folders, so a restart finds it again."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{sink_path}/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    names = [f.getPath().getParent().getName() for f in found or []]
    return sorted(int(n.removeprefix("batch=")) for n in names)


def read_batches(spark: SparkSession, sink_path: str, batches: list[int], schema) -> DataFrame:
    """The rows of these batches and their number as ``batch``."""
    if not batches:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    out = spark.read.option("basePath", sink_path).parquet(*[f"{sink_path}/batch={b}" for b in batches])
    return out.withColumn("batch", F.col("batch").cast("long"))


def ingest_bounded(src: DataFrame, sink_path: str, checkpoint: str, max_rows: int, key: str, seed: int = 42):
    """L4: append a stream to files until ``max_rows`` rows lie there. The
    batch that would pass the bound is cut to the rows of lowest seeded hash
    (``bounded_sample``), later ones write nothing. The rows written so far are
    counted in the files of the batches before, so a rerun of a batch after a
    failure sees the same budget."""
    spark = src.sparkSession

    def run(batch_df: DataFrame, batch_id: int):
        before = [b for b in finished_batches(spark, sink_path) if b < batch_id]
        room = max(max_rows - read_batches(spark, sink_path, before, src.schema).count(), 0)
        fits = batch_df if batch_df.count() <= room else bounded_sample(batch_df, room, key, seed)
        fits.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    return (src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())


def enrich_stream(src: DataFrame, catalog: DataFrame, default: str = "Other") -> DataFrame:
    """L3: catalogue cluster attached to every arriving review."""
    return attach_cluster(src, catalog, default=default)


def streaming_kpis(src: DataFrame, cluster: str = "cluster_name", rating: str = "rating",
                   sentiment: str = "sentiment") -> DataFrame:
    """L2: running KPIs per cluster (counts and sums are the state; shares
    are derived from them)."""
    lbl = normalize_label(F.col(sentiment))
    agg = src.groupBy(cluster).agg(
        F.count("*").alias("total"),
        F.sum(F.col(rating).cast("double")).alias("rating_sum"),
        F.count(rating).alias("rating_n"),
        F.count(lbl).alias("labelled"),
        F.count_if(lbl == "positive").alias("n_positive"),
        F.count_if(lbl == "neutral").alias("n_neutral"),
        F.count_if(lbl == "negative").alias("n_negative"))
    return agg


def kpi_view(state: DataFrame, cluster: str = "cluster_name") -> DataFrame:
    """Shares from the streamed counts (same numbers as batch F8)."""
    def pct(c):
        return F.when(F.col("labelled") == 0, F.lit(0.0)).otherwise(F.col(c) * 100.0 / F.col("labelled"))
    return state.select(cluster, "total", (F.col("rating_sum") / F.col("rating_n")).alias("avg_rating"),
                        pct("n_positive").alias("pos_pct"), pct("n_neutral").alias("neu_pct"),
                        pct("n_negative").alias("neg_pct"))


def score_stream(src: DataFrame, score_batch, sink_path: str, checkpoint: str,
                 trigger_available_now: bool = True, label: str | None = None, counts_path: str | None = None):
    """L1: score each micro-batch with a batch function and append it.

    ``score_batch(df) -> DataFrame`` is any batch plan (cleaning, lexicon
    polarity, labels). Writing per batch id keeps reruns of a batch after a
    failure idempotent (overwrite of that batch's folder). With ``label`` the
    batch's class counts go to ``counts_path``, for ``running_class_weights``."""
    def run(batch_df: DataFrame, batch_id: int):
        path = f"{sink_path}/batch={batch_id}"
        score_batch(batch_df).write.mode("overwrite").parquet(path)
        if label:
            counts = batch_df.sparkSession.read.parquet(path).groupBy(label).agg(F.count("*").alias("n_c"))
            counts.write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")

    writer = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_available_now else writer
    return writer.start()


def running_class_weights(spark: SparkSession, counts_path: str, label: str = "star_label",
                          kind: str = "int") -> DataFrame:
    """C7 over a stream: (label, n_c, class_weight) from the counts of all
    batches written so far."""
    schema = f"{label} {kind}, n_c long"
    rows = read_batches(spark, counts_path, finished_batches(spark, counts_path), schema)
    return weights_from_counts(rows.groupBy(label).agg(F.sum("n_c").alias("n_c")), label)


def append_stream(src: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet"):
    """Append a stateless stream (e.g. L3 output) to files, exactly once."""
    return (src.writeStream.format(fmt).outputMode("append")
               .option("checkpointLocation", checkpoint).trigger(availableNow=True)
               .start(sink_path))


def run_complete(agg: DataFrame, checkpoint: str, sink_path: str) -> DataFrame:
    """Run a complete-mode aggregate to the end of the available input; each
    batch writes its whole result to a folder of its own, the last is returned,
    be it from an earlier run (no rows where no batch ever ran)."""
    def run(batch_df: DataFrame, batch_id: int):
        batch_df.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    (agg.writeStream.foreachBatch(run).outputMode("complete")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    spark = agg.sparkSession
    return read_batches(spark, sink_path, finished_batches(spark, sink_path)[-1:], agg.schema).drop("batch")


def run_updates(agg: DataFrame, keys: list[str], checkpoint: str, sink_path: str) -> DataFrame:
    """Run an aggregate in update mode to the end of the available input: a
    batch writes only the keys that it changed. Returns ``latest_rows``."""
    def run(batch_df: DataFrame, batch_id: int):
        batch_df.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    (agg.writeStream.foreachBatch(run).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return latest_rows(agg.sparkSession, sink_path, keys, agg.schema)


def latest_rows(spark: SparkSession, sink_path: str, keys: list[str], schema) -> DataFrame:
    """The last row of each key over all batches written, earlier runs included."""
    rows = read_batches(spark, sink_path, finished_batches(spark, sink_path), schema)
    values = [f.name for f in schema if f.name not in keys]
    last = F.max_by(F.struct(*values), "batch").alias("__last")
    out = rows.groupBy(*keys).agg(last, F.count("*").alias("__n")).filter("__n > 0")
    return out.select(*keys, "__last.*").select(*schema.names)
