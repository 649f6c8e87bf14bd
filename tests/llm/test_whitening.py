import math
from fractions import Fraction

import numpy as np
import pytest

from labelway.llm import whitening as W
from labelway.llm.common import table
from labelway.operators import joins


def brute(rows, counted=True):
    """Everything on one machine: exact integers, then one eigendecomposition."""
    keep = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(1024 * float(c)) + 100_000 for c in v)) for i, v in keep]
    fit = [v for _, v in x] if counted else sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    gaps = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    cov = gaps.T @ gaps / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    out = [
        (i, n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array(v, float) - mean) @ axes / np.sqrt(e))
        for i, v in x
    ]
    return out, e / np.trace(cov)


def compare(got, rows, counted=True):
    want, explained = brute(rows, counted)
    found = {}
    for r in got:
        found.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == 8 * len(want) and {i for i, *_ in want} == set(found)
    signs = np.sign([sum(found[i][c + 1].whitened * y[c] for i, *_, y in want) for c in range(8)])
    for i, n, deviation, y in want:
        for c in range(8):
            r = found[i][c + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened == pytest.approx(signs[c] * y[c], abs=1e-7)
            assert r.explained == pytest.approx(explained[c], rel=1e-9)
            assert r.identity_error < 1e-9


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, sf, "embeddings").collect()]
    compare(W.q_whitening(spark, sf).collect(), rows)


@pytest.mark.parametrize("counted", [True, False])
@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_vectors(spark, monkeypatch, counted, broadcast):
    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 12)).round(3)
    rows = [(i, vectors[0 if i % 3 == 0 else i % 60].tolist()) for i in range(240)]
    odd = [(900, None), (901, [None] + [0.0] * 11), (902, [math.nan] * 12), (903, [math.inf] * 12)]
    odd += [(904, [1.0] * 5), (905, []), (906, [1e300] * 12)]
    df = spark.createDataFrame([(i, v, 1, "y") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, y string")
    got = W.whiten(df, cfg=W.Whitening(counted=counted)).collect()
    compare(got, rows, counted)


def test_wide_numbers(spark):
    rows = [(i, [float(i) * 2.0**44, float(i % 3), 1.0]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in W.whiten(df).collect()}
    assert len(got) == 21
    assert all(r.deviation is None for r in got.values() if r.vec_id != 3)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    exact = sum((7 * c - s) ** 2 for c, s in zip(x[3], map(sum, zip(*x))))
    assert got[3, 1].deviation == exact and got[3, 3].whitened is None


def test_without_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).collect() == []
    got = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert sorted(r.component for r in got) == [1, 1, 1, 2, 2, 2]
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(3, 0, None, None, None)}
