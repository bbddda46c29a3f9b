import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from starlens.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], "clash", 7) for i, v in rows], SCHEMA)


def whole(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, k=16):
    """The contract by fractions: (n, sums, covariance, rows left)."""
    left = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if whole(v)]
    fit = sorted({tuple(x) for _, x in left})
    n, dim = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(dim)]
    cov = np.array([[float(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit) / Fraction(n) ** 3)
                     for b in range(dim)] for a in range(dim)])
    return n, s, cov, left


def check(got, rows, tol=1e-9):
    n, s, cov, left = brute(rows)
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    k = max(r.component for r in got)
    assert len(got) == len(left) * k
    want = {}
    for i, x in left:
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
        want.setdefault(i, (sum((n * a - b) ** 2 for a, b in zip(x, s)), centred))
    sign = {}
    for r in got:
        dev, centred = want[r.vec_id]
        c = r.component - 1
        w = centred @ axes[:, c] / math.sqrt(e[c])
        if abs(w) > 1e-6:
            sign.setdefault(c, math.copysign(1, w * r.whitened))
        assert r.n == n and int(r.deviation) == dev
        assert abs(w * sign.get(c, 1) - r.whitened) < tol * max(1, abs(w))
        assert abs(r.explained - e[c] / e.sum()) < 1e-9 and r.identity_error < 1e-9


def test_table(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pydict()
    rows = list(zip(t["vec_id"], t["embedding"]))
    got = wh.op11_whitening(spark, "/root/testdata/sf0.01").collect()
    check(got, rows)
    assert max(r.component for r in got) == 16


def test_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(rng.normal(size=(60, 5)) * [3, 2, 1, .5, 40])]
    rows += [(i, rows[0][1]) for i in range(100, 300)]                       # one hot vector
    bad = [(900, None), (901, [1.0, None, 0, 0, 0]), (902, [float("nan")] * 5), (903, [float("inf"), 0, 0, 0, 0]),
           (904, []), (905, [1.0, 2.0]), (906, [3e17, 0, 0, 0, 0])]
    got = wh.whitened_vectors(frame(spark, rows + bad)).collect()
    assert not {r.vec_id for r in got} & {i for i, _ in bad}
    check(got, rows)
    twice = wh.whitened_vectors(frame(spark, rows + [(None, rows[1][1]), (1, rows[1][1])])).collect()
    assert sum(r.vec_id is None for r in twice) == 5 and sum(r.vec_id == 1 for r in twice) == 10
    assert wh.whitened_vectors(frame(spark, [])).count() == 0
    assert wh.whitened_vectors(frame(spark, bad)).filter("vec_id < 904").count() == 0
    assert wh.whitened_vectors(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_flat_and_huge(spark):
    """A constant dimension has no component; entries whose squares leave a long stay exact."""
    rows = [(i, [float(i % 7) * 2.0 ** 40, 5.0, float(i * i)]) for i in range(30)]
    got = wh.whitened_vectors(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1}        # the second is under rounding beside 2^80
    n, s, _, left = brute(rows)
    want = {i: sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in left}
    assert all(int(r.deviation) == want[r.vec_id] for r in got if r.deviation is not None)


@pytest.mark.parametrize("seed", [0, 1])
def test_polarisation(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-500, 500, (40, 6)) + 1000000
    n, sums = len(x), x.sum(axis=0).tolist()
    pivot = [v // n for v in sums]
    own, pairs = wh.squares(x - np.array(pivot))
    i, j = np.triu_indices(6, 1)
    v = wh.polarised_covariance(n, [a - n * p for a, p in zip(sums, pivot)], own, dict(zip(zip(i.tolist(), j.tolist()), pairs)))
    want = [[float(sum((n * int(r[a]) - sums[a]) * (n * int(r[b]) - sums[b]) for r in x) / Fraction(n) ** 3)
             for b in range(6)] for a in range(6)]
    assert np.allclose(v, want, rtol=1e-14, atol=0)
