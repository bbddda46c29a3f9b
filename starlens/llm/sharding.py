"""Operator 4: minimax contiguous sharding (law ``bytes``).

Equal texts are one atomic group. Groups are ordered by the hash of their
text; what is cut is the sequence of 2 ** 16 hash ranges with the bytes in
each, a table of a fixed size however large the corpus, so that part runs on
the driver. The smallest feasible shard capacity is found by binary search,
each candidate checked by greedy packing, and the order is cut there; among
the cuts that keep the capacity, those nearest to an even rest are taken. A
range above an even share (a text copied very often) comes first and has a
shard of its own.

Slots are gapless without a global sort: a row's slot is the rows before its
range in the shard, plus those before its salt in the range, plus its number
within (range, salt). No task holds more than a salt's share of a group.

Edge cases: null text has no bytes, size 16 and checksum 0, and is a group of
its own; repeated rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import cut_lineage

RANGES, SALTS, OVERHEAD = 1 << 16, 64, 16


def _ends(total: np.ndarray, start: int, capacity: int, shards: int) -> list[int]:
    """Greedy packing: ends of at most ``shards`` pieces of at most ``capacity``."""
    out = []
    for _ in range(shards):
        start = int(np.searchsorted(total, total[start] + capacity, "right")) - 1
        out.append(start)
        if start == len(total) - 1:
            break
    return out


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """(capacity, ends): the least possible largest piece of ``sizes`` cut into
    ``shards`` contiguous pieces, and such cuts."""
    total = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    n = len(total) - 1
    low, high = int(max([0, *sizes, -(-int(total[-1]) // shards)])), int(total[-1])
    while low < high:
        middle = (low + high) // 2
        if _ends(total, 0, middle, shards)[-1] == n:
            high = middle
        else:
            low = middle + 1
    # The last cuts that still leave a feasible rest, from the right.
    least, at = [n], n
    for _ in range(shards - 1):
        at = int(np.searchsorted(total, total[at] - low, "left"))
        least.append(at)
    least = least[::-1]
    ends, at = [], 0
    for k in range(shards):
        even = total[at] + (total[-1] - total[at]) / (shards - k)
        near = int(np.searchsorted(total, even, "left"))
        if near > at and near <= n and total[near] - even > even - total[near - 1]:
            near -= 1
        most = int(np.searchsorted(total, total[at] + low, "right")) - 1
        at = max(at, min(max(near, least[k]), most))
        ends.append(at)
    return low, ends


def place_ranges(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """range -> shard. Ranges above an even share of the rest stand alone."""
    rest, alone = sorted(sizes), []
    while len(alone) < shards - 1 and rest:
        big = max(rest, key=lambda r: (sizes[r], -r))
        if sizes[big] * (shards - len(alone)) <= sum(sizes[r] for r in rest):
            break
        alone.append(big)
        rest.remove(big)
    out = {r: k for k, r in enumerate(alone)}
    if rest:
        _, ends = minimax_cuts(np.array([sizes[r] for r in rest], np.int64), shards - len(alone))
        for i, r in enumerate(rest):
            out[r] = len(alone) + int(np.searchsorted(ends, i, "right"))
    return out


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text", F.col("text").isNull()).alias("h"),
                       (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.select("*", F.shiftrightunsigned("h", 48).cast("int").alias("range"),
                       F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = cut_lineage(rows.groupBy("range", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("s")))
    ranges = parts.groupBy("range").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()   # RANGES rows at most
    shard_of = place_ranges({r.range: r.s for r in ranges}, shards)
    filled = [0] * shards
    table = []
    for r in sorted(ranges, key=lambda r: r.range):
        k = shard_of[r.range]
        table.append((r.range, k, filled[k]))
        filled[k] += r.n
    places = F.broadcast(docs.sparkSession.createDataFrame(table, "range int, shard int, first long"))
    before = Window.partitionBy("range").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("range", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    number = F.row_number().over(Window.partitionBy("range", "salt").orderBy("h", "doc_id"))
    out = rows.join(offsets, ["range", "salt"]).withColumn("rn", number).join(places, "range")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      (F.col("first") + F.col("skip") + F.col("rn") - 1).alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_shard(spark, sf_dir):
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
