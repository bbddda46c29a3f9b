"""Sampling and splits.

Row assignment uses a seeded hash of the row key, ``md5(seed ':' key)``
read as a number in [0, 1): reproducible, independent of partitioning and
of retries, and computed row by row with no shuffle. Exact per-label sizes
(I1 ``exact=True``, I3) need ranks within a label; those come from the
distributed ``prefix_sums`` (range partitioned), never from one window
partition per label.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.operators.metrics import prefix_sums


def unit_hash(key, seed: int = 42) -> Column:
    """Seeded hash of ``key`` as a double in [0, 1)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), k.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def stratified_split(df: DataFrame, label: str = "star_label", key: str = "review_id",
                     fractions: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42,
                     exact: bool = False) -> DataFrame:
    """Add ``split`` in {train, val, test}.

    Default: hash thresholds (per-label shares match in expectation, no
    shuffle). ``exact=True``: per label, test = ceil(0.3 n) rows last in hash
    order, of the remainder val/test halves as ``ceil`` (the two-step
    70 / (15 / 15) split), using distributed ranks.
    """
    u = unit_hash(key, seed)
    f_train, f_val, _ = fractions
    if not exact:
        split = (F.when(u < f_train, "train").when(u < f_train + f_val, "val").otherwise("test"))
        return df.withColumn("split", split)
    # Exact decimal fractions: 1 - 0.70 is 0.30000000000000004 in binary
    # floating point, which would make ceil(n * 0.3) overshoot.
    holdout_d = Decimal(str(1 - Decimal(str(f_train))))
    second_d = (holdout_d - Decimal(str(f_val))) / holdout_d
    holdout, second = F.lit(holdout_d), F.lit(second_d)
    at = F.struct(u.alias("u"), F.col(key).alias("k"))
    ranked = prefix_sums(df.select(label, u.alias("__u"), F.col(key).alias("__k"), F.lit(1).alias("__one")),
                         [label], [F.col("__u"), F.col("__k")], ["__one"])
    n = F.col("total___one")
    n_temp = F.ceil(n * holdout)
    n_train = n - n_temp
    n_val = n_temp - F.ceil(n_temp * second)
    r, place = F.col("cum___one"), F.struct(F.col("__u").alias("u"), F.col("__k").alias("k"))
    # Only (label, hash, key) is ranked; the last place of each split, one row
    # per label, then decides the wide rows where they are.
    cuts = ranked.groupBy(F.col(label).alias("__label")).agg(
        F.max(F.when(r <= n_train, place)).alias("__train"), F.max(F.when(r <= n_train + n_val, place)).alias("__val"))
    split = F.when(at <= F.col("__train"), "train").when(at <= F.col("__val"), "val").otherwise("test")
    return (df.join(cuts, F.col(label).eqNullSafe(F.col("__label")), "left")
              .withColumn("split", split).drop("__label", "__train", "__val"))


def split_report(df: DataFrame, label: str = "star_label_name", split: str = "split",
                 digits: int = 3) -> DataFrame:
    """Rows per split and label share within the split (rounded)."""
    counts = df.groupBy(split, label).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(split))
    return counts.select(split, label, "count", total.alias("split_rows"),
                         F.round(F.col("count") / total, digits).alias("share"))


def undersample(df: DataFrame, label: str = "star_label", key: str = "review_id",
                seed: int = 42) -> DataFrame:
    """Cut every class to the minority class size (lowest hashes kept).

    Only (label, hash, key) is ranked; the last place kept, one row per label,
    then decides the wide rows where they are."""
    at = F.struct(unit_hash(key, seed).alias("u"), F.col(key).alias("k"))
    ranked = prefix_sums(df.select(label, unit_hash(key, seed).alias("__u"), F.col(key).alias("__k"), F.lit(1).alias("__one")),
                         [label], [F.col("__u"), F.col("__k")], ["__one"])
    m = ranked.agg(F.min("total___one")).first()[0]
    last = (ranked.filter(F.col("cum___one") <= F.lit(m)).groupBy(F.col(label).alias("__label"))
                  .agg(F.max(F.struct(F.col("__u").alias("u"), F.col("__k").alias("k"))).alias("__last")))
    return (df.join(last, F.col(label).eqNullSafe(F.col("__label")))
              .filter(at <= F.col("__last")).drop("__label", "__last"))


#: Rows with a common hash prefix up to which the cut is read off directly.
FEW = 100_000


def _cut_place(places: DataFrame, n: int, few: int = FEW):
    """(hash, key) of the n-th of ``places`` (hash, key) and how many of its
    equals belong to the first n; None if there are no more than n rows.

    A histogram over the first 4 hex digits of the hash says in which bucket
    the n-th row lies, then over the next 4 within that bucket, until a bucket
    holds few rows; only those narrow rows are sorted."""
    prefix, before = "", 0
    while True:
        rest = places.filter(F.col("h").startswith(prefix)) if prefix else places
        digits = len(prefix) + 4
        counts = rest.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.count("*").alias("c"))
        w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)       # at most 65,536 rows
        reach = counts.withColumn("upto", F.sum("c").over(w) + before).filter(F.col("upto") >= n).orderBy("b").first()
        if reach is None:
            return None
        prefix, before = reach.b, reach.upto - reach.c
        if reach.c <= few or digits >= 32:
            break
    # Equal (hash, key) are counted together, so a repeated key is one row here.
    own = places.filter(F.col("h").startswith(prefix)).groupBy("h", "k").agg(F.count("*").alias("c"))
    w = Window.orderBy("h", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = (own.withColumn("upto", F.sum("c").over(w) + before).filter(F.col("upto") >= n).orderBy("h", "k").first())
    return last.h, last.k, n - (last.upto - last.c), last.c


def bounded_sample(df: DataFrame, n: int, key: str = "review_id", seed: int = 42, few: int = FEW) -> DataFrame:
    """A reproducible sample of ``n`` rows, those of lowest seeded hash
    (then key) of all rows; all rows if there are no more.

    Two passes: histograms of the narrow hashes give the place of the n-th row,
    then every row is kept or dropped where it is. No partition sends whole
    rows. Rows without a key come first, in the hash of an empty one; of rows
    that share the last place (a repeated key) as many as fit are taken."""
    if n <= 0:
        return df.limit(0)
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    cut = _cut_place(df.select(h.alias("h"), F.col(key).alias("k")), n, few)
    if cut is None:
        return df
    last_h, last_k, fit, equals = cut
    out = df.withColumn("__h", h)
    same = F.col(key).eqNullSafe(F.lit(last_k)) & (F.col("__h") == last_h)
    lower = (F.col("__h") < last_h) | ((F.col("__h") == last_h) & F.when(
        F.lit(last_k is None), F.lit(False)).otherwise(F.coalesce(F.col(key) < F.lit(last_k), F.lit(True))))
    if fit == equals:
        return out.filter(lower | same).drop("__h")
    return out.filter(lower).unionByName(out.filter(same).limit(fit)).drop("__h")
