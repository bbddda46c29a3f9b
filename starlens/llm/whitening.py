"""Operator 11: embedding whitening by polarisation covariance.

Every entry c becomes the integer x = floor(64 c) + 1000000. The fit list is
each distinct x vector once (a distinct, combined before its shuffle, so a
vector that a third of all rows share travels once per task). Two passes over
it: the sums S of each dimension, then, centred by the integer part p of the
mean, the exact sums of squares of every dimension, d_i^2, and of every sum of
two dimensions, (d_i + d_j)^2, d = x - p. What the integer p left of the mean,
r = S - n p, is taken off exactly, so both variances are exact rationals:

    Var(x_i + x_j) = sum (d_i + d_j)^2 / n - ((r_i + r_j) / n)^2
    Cov(x_i, x_j)  = (Var(x_i + x_j) - Var(x_i) - Var(x_j)) / 2

Each covariance is rounded once, to a double, and the matrix goes to ``eigh``.
Tasks send one row per pair of dimensions; Spark adds them, and the driver gets
as many as the dimension allows, whatever the number of vectors.

Edge cases: rows whose vector is null, is empty or holds null or non-finite
entries have no result, nor have those with an entry of 2^56 or more (x would
leave a long) or of another length than most distinct vectors have (ties: the
longer length). Repeated rows and null ids keep a result per row. Components
without variance (to rounding) cannot be whitened and are left out; a table
without rows, or whose vectors are all equal, gives an empty result. Other
columns are not looked at. ``deviation`` is null beyond 38 digits.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 62)            # of |64 c|
FLAT = 1e-13                        # share of the trace under which a component has no variance
EXACT = pa.decimal128(38, 0)
SCHEMA = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
          "explained double, identity_error double")


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is whole."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(float(SCALE))) >= LARGEST))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """x vectors of one batch as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def _centred(x: np.ndarray, pivot: list[int], terms: int) -> np.ndarray:
    """x - pivot; Python integers where ``terms`` summed squares would leave a long."""
    lo, hi = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    most = max(max(abs(a - p), abs(b - p)) for a, b, p in zip(lo, hi, pivot))
    if terms * (most + 1) ** 2 < 1 << 62:
        return x - np.array(pivot, np.int64)
    return x.astype(object) - np.array(pivot, object)


def _exact(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], EXACT)


def _sums(dim: int):
    def run(batches):
        n, s = 0, [0] * dim
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                n += len(x)
                s = [a + int(v) for a, v in zip(s, _centred(x, [0] * dim, len(x)).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                                              _exact(s)], ["i", "n", "s"])
    return run


def squares(d: np.ndarray) -> tuple[list, list]:
    """Column sums of d_i^2, and of (d_i + d_j)^2 for i < j, row after row."""
    own = (d * d).sum(axis=0).tolist()
    pairs = []
    for i in range(d.shape[1] - 1):
        u = d[:, i + 1:] + d[:, i:i + 1]
        pairs.append((u * u).sum(axis=0))
    return own, np.concatenate(pairs).tolist() if pairs else []


def _squares(dim: int, pivot: list[int]):
    i, j = np.triu_indices(dim, 1)

    def run(batches):
        own, pairs = [0] * dim, [0] * len(i)
        seen = False
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                a, p = squares(_centred(x, pivot, 4 * len(x)))
                own, pairs = [u + v for u, v in zip(own, a)], [u + v for u, v in zip(pairs, p)]
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.arange(dim), i].astype(np.int32)), pa.array(np.r_[np.arange(dim), j].astype(np.int32)),
                 _exact(own + pairs)], ["i", "j", "q"])
    return run


def polarised_covariance(n: int, rest: list[int], own: list[int], pairs: dict) -> np.ndarray:
    """The covariance matrix from the exact sums; each entry rounded once."""
    dim = len(own)
    v = np.empty((dim, dim))
    for i in range(dim):
        v[i, i] = (n * own[i] - rest[i] * rest[i]) / (n * n)
        for j in range(i + 1, dim):
            v[i, j] = v[j, i] = (n * (pairs[i, j] - own[i] - own[j]) - 2 * rest[i] * rest[j]) / (2 * n * n)
    return v


class Whitening:
    """What the fit leaves: size bounded by the dimension of the vectors."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.dim = n, len(sums)
        self.pivot = [s // n for s in sums]
        self.rest = [s - n * p for s, p in zip(sums, self.pivot)]
        self.mean = np.array([r / n for r in self.rest])
        e, vectors = np.linalg.eigh(covariance)
        e, vectors = e[::-1], vectors[:, ::-1]
        trace = float(np.trace(covariance))
        k = min(components, int((e > FLAT * trace).sum()))
        self.axes, self.roots = vectors[:, :k], np.sqrt(e[:k])
        self.explained = (e[:k] / trace).tolist() if trace > 0 else []
        self.error = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        d = _centred(x, self.pivot, 1)
        return (d.astype(np.float64) - self.mean) @ self.axes / self.roots

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sum over dimensions of (n x - S)^2."""
        d = _centred(x, self.pivot, self.dim * self.n * self.n)
        u = d * self.n - np.array(self.rest, d.dtype)
        out = (u * u).sum(axis=1)
        if out.dtype == object:
            return pa.array([Decimal(v) if v < 10 ** 38 else None for v in out.tolist()], EXACT)
        return pa.array(out).cast(EXACT)


def _products(model: Whitening):
    k = len(model.explained)
    a, b = np.triu_indices(k)

    def run(batches):
        first, second, seen = np.zeros(k), np.zeros(len(a)), False
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(_matrix(batch.column(0), model.dim))
                first, second, seen = first + w.sum(axis=0), second + (w.T @ w)[a, b], True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.arange(k), a].astype(np.int32)),
                 pa.array(np.r_[np.full(k, -1), b].astype(np.int32)), pa.array(np.r_[first, second])], ["a", "b", "s"])
    return run


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of a table with a column ``x`` of integer vectors."""
    distinct = cut_lineage(x.select("x").distinct())
    common = (distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c"))
                      .orderBy(F.desc("c"), F.desc("d")).first())
    if common is None:
        return None
    dim = common.d
    distinct = distinct.filter(F.size("x") == dim)
    got = (distinct.mapInArrow(_sums(dim), "i int, n long, s decimal(38,0)").groupBy("i")
                   .agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect())
    n, sums = got[0].n, [int(r.s) for r in got]
    pivot = [s // n for s in sums]
    rest = [s - n * p for s, p in zip(sums, pivot)]
    q = {(r.i, r.j): int(r.q) for r in
         distinct.mapInArrow(_squares(dim, pivot), "i int, j int, q decimal(38,0)")
                 .groupBy("i", "j").agg(F.sum("q").alias("q")).collect()}
    covariance = polarised_covariance(n, rest, [q[i, i] for i in range(dim)], q)
    model = Whitening(n, sums, covariance, components)
    k = len(model.explained)
    if k:
        p = {(r.a, r.b): r.s / n for r in distinct.mapInArrow(_products(model), "a int, b int, s double")
                                                  .groupBy("a", "b").agg(F.sum("s").alias("s")).collect()}
        model.error = max(abs(p[a, b] - p[a, -1] * p[b, -1] - (a == b)) for a in range(k) for b in range(a, k))
    return model


def _apply(model: Whitening):
    k = len(model.explained)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), model.dim)
            rows = len(x)
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, model.n)), model.deviations(x).take(each),
                 pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.explained, rows)),
                 pa.array(np.full(rows * k, model.error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whitened_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``vectors`` and component: ``SCHEMA``."""
    x = integer_vectors(vectors, id_col, vec_col)
    model = fit(x, components)
    if model is None or not model.explained:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return x.filter(F.size("x") == model.dim).mapInArrow(_apply(model), SCHEMA)


def op11_whitening(spark, sf_dir):
    out = whitened_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
