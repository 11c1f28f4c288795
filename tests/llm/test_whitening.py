"""Whitening against numpy's eigendecomposition of the exact covariance."""
import math
from decimal import Decimal

import numpy as np
import pytest

from veilscan.llm import whitening
from veilscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def same_up_to_sign(a, b, tol):
    sign = np.sign((a * b).sum(0))
    return np.abs(a - b * sign).max() < tol


@pytest.mark.parametrize("seed", range(8))
def test_rank_one_updates(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 24))
    values, vectors = np.zeros(d), np.eye(d)
    want = np.zeros((d, d))
    for k in range(80):
        v = rng.integers(-3, 4, d).astype(float) if seed % 2 else rng.standard_normal(d) * 10.0 ** rng.integers(-6, 3)
        if k % 5 == 0:
            v[: d // 2] = 0
        w = float(rng.random() + 0.1)
        values, vectors = whitening.rank_one(values, vectors, w, v)
        want += w * np.outer(v, v)
        scale = max(np.abs(want).max(), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert np.abs((vectors * values) @ vectors.T - want).max() < 1e-12 * scale * d
        assert (np.diff(values) >= 0).all()


def test_spectra_combine():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (300, 12)) + whitening.OFFSET
    x[:, 3] = x[:, 4]
    x[100:180] = x[100]
    parts = []
    for rows in (x[:100], x[100:180], x[180:181], x[181:]):
        s = whitening.Spectrum(12)
        for u, c in zip(*np.unique(rows, axis=0, return_counts=True)):
            s.add(u, int(c))
        parts.append(s)
    whole = parts[0]
    for p in parts[1:]:
        whole.combine(p)
    centred = x - x.mean(0)
    assert whole.n == 300 and (whole.sums == x.sum(0)).all()
    assert np.abs((whole.vectors * whole.values) @ whole.vectors.T - centred.T @ centred).max() < 1e-8


def brute(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    far = n * x - s
    v = (far.T @ far) / n ** 3 if np.abs(far).max() < 2 ** 24 else far.astype(float).T @ far.astype(float) / float(n) ** 3
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, (far.astype(object) ** 2).sum(1), (far / n) @ q / np.sqrt(e), e / np.trace(v)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = [r.vec_id for r in rows]
    n, deviation, want, explained = brute([r.embedding for r in rows])
    got = sorted(QUERIES["op11_whitening"](spark, SF).collect())
    assert [(r.vec_id, r.component) for r in got] == sorted((i, c) for i in ids for c in range(1, 33))
    order = np.argsort(ids)
    w = np.array([r.whitened for r in got]).reshape(len(ids), 32)
    assert same_up_to_sign(w, want[order], 1e-8)
    assert [r.deviation for r in got[::32]] == [int(deviation[i]) for i in order] and {r.n for r in got} == {n}
    assert np.allclose([r.explained for r in got[:32]], explained, rtol=1e-10)
    cov = np.cov(w.T, bias=True)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-10 and np.abs(cov - np.eye(32)).max() < 1e-10


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, x string, part string"
    rng = np.random.default_rng(3)
    good = rng.standard_normal((40, 5)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1e30] * 5, [1.0, 2.0]]
    rows = [(i, v, "a", "b") for i, v in enumerate(good + good[:7] + [good[0]] * 30)] + [(None, good[1], "", "")] + [(i, v, None, None) for i, v in enumerate(bad)]
    out = whitening.whiten(spark.createDataFrame(rows, schema).repartition(5)).collect()
    kept = [r for r in rows if r[1] is not None and r[1] in good]
    n, deviation, want, explained = brute([r[1] for r in kept])
    assert len(out) == 5 * len(kept) and {r.n for r in out} == {n} == {len(kept)}
    assert sorted(r.deviation for r in out if r.component == 1) == sorted(Decimal(int(v)) for v in deviation)
    assert max(r.identity_error for r in out) < 1e-9
    by = {(r.vec_id, r.component): r.whitened for r in out if r.vec_id is not None and r.vec_id < 40}
    got = np.array([[by[i, c] for c in range(1, 6)] for i in range(40)])
    sign = np.sign((got * want[:40]).sum(0))
    assert np.abs(got - want[:40] * sign).max() < 1e-9
    for few in ([], bad, good[:1], [good[0]] * 9, [[2.0], [2.0]], [[]]):
        df = spark.createDataFrame([(1, v, "", "") for v in few], schema)
        assert whitening.whiten(df).count() == 0
    flat = [[float(i), float(-i), 7.0] for i in range(20)]
    out = whitening.whiten(spark.createDataFrame([(i, v, "", "") for i, v in enumerate(flat)], schema)).collect()
    assert {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-12


def test_large_sums_are_exact():
    x = np.array([[1, 2], [3 << 31, 5]], np.int64)
    s = x.sum(0) * 50
    got = whitening._deviation(x, 100, s)
    assert got == [Decimal(sum(int(100 * a - b) ** 2 for a, b in zip(r.tolist(), s.tolist()))) for r in x]
