"""Tables written for the time of one operator in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from starlens.session import ensure_checkpoint_dir


class Scratch:
    """``with Scratch(spark) as s: t = s.keep(df, "name")`` writes ``df`` as
    Parquet and reads it again; on leaving, the folder goes. What is returned
    from the block must not read it any more (a checkpoint, for instance).
    ``bucketed`` does so as a table dealt by a key: joins on it leave the table
    where it is."""

    def __init__(self, spark: SparkSession, label: str = "scratch"):
        self.spark = spark
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.folder = f"{ensure_checkpoint_dir(spark)}/{self.name}"
        self.tables: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{self.name}_{name}"
        self.tables.append(table)
        (df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("compression", "zstd")
           .option("path", f"{self.folder}/{name}").saveAsTable(table))
        return self.spark.table(table)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
