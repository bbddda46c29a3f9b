"""Connected components of an edge table: union-find inside partitions, then
star contraction between them. No edge or label is collected to the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.session import cut_lineage


def _forest(batches):
    """Spanning forest of a partition's edges as (node, root), root the least node."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()),
                                          pa.array([find(x) for x in nodes], pa.binary())], ["u", "v"])


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u binary, v binary) -> (node, root): every node of an edge and
    the least node of its component.

    Partitions are contracted by union-find first, so what goes on is at most
    one edge per node and partition. Then large-star and small-star steps
    alternate until nothing changes (a logarithmic number of rounds in
    practice; each is cut by a checkpoint). Empty input gives empty output.
    """
    edges = cut_lineage(edges.select("u", "v").mapInArrow(_forest, "u binary, v binary"))
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_minima(both), "u").filter(F.col("v") > F.col("u"))
                     .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        down = large.select("u", "v")
        low = _minima(down)
        small = (down.join(low, "u")
                     .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                               F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                     .select("e.u", "e.v").filter("u != v").distinct())
        edges = cut_lineage(small)
        state = edges.agg(F.count("*").alias("n"),
                          F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
