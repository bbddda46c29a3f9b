"""Session helpers.

On a cluster the session is created by the platform; ``get_spark`` only fills
in settings that are unset, so cluster-level values (shuffle partitions,
checkpoint dir, broadcast threshold) always win.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.types import StructField, StructType

# Defaults applied only when the key is not already set on the session.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "starlens", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where nothing is set, a plain
    local session (tests) gets a fresh private folder; on a cluster a folder
    of one machine would lose data, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="starlens-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


class Pins:
    """Tables of an iterative fit, written in the shared checkpoint folder.

    ``keep(df, name)`` writes ``df`` and reads it again; the version of that
    name before it goes then. Unlike a checkpoint's, its size is that of its
    files, so size estimates do not multiply from one iteration to the next. On
    leaving the block all go; what is returned must be a checkpoint of its own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/pins-{uuid.uuid4().hex}"
        self.version: dict[str, int] = {}

    def keep(self, df, name: str):
        n = self.version[name] = self.version.get(name, -1) + 1
        path = f"{self.folder}/{name}-{n}"
        df.write.parquet(path)
        if n:
            self._delete(f"{self.folder}/{name}-{n - 1}")
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self._delete(self.folder)


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint dir (survives executor
    loss, unlike a local checkpoint). What led to it is garbage afterwards;
    a collection on the driver lets Spark delete those shuffle files at once
    instead of at some later time."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def pin_rows(df, **kinds):
    """A long table written as Parquet in the shared checkpoint dir and read
    again. Its columns are compressed, so it is a fraction of a checkpoint.
    ``kinds``: columns to read as a user-defined type of their fields."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/pins-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = StructType([StructField(f.name, kinds.get(f.name, f.dataType), f.nullable, f.metadata) for f in df.schema])
    return df.sparkSession.read.schema(schema).parquet(path)
