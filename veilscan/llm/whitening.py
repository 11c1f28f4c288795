"""Whitening of embeddings by an incremental eigendecomposition.

1. Every partition keeps the eigenpairs of its centred scatter and takes in one
   vector at a time: the scatter of n + m vectors (m copies of a new one) is the
   old one plus n m / (n + m) times the outer square of the vector's distance
   from the mean. The rank-one update solves the secular equation for all roots
   at once, after deflation (directions without a part in the update, equal
   eigenvalues rotated together), and takes the new eigenvectors from the
   recomputed update vector, so that they stay orthogonal.
2. Spectra are combined ``FAN_IN`` at a time: the distance of the means and then
   each eigenpair of the other spectrum are rank-one updates of the first.
3. Two passes over the table finish: a Rayleigh-Ritz step in the basis found
   (the covariance of the projections, centred with the exact mean, summed over
   all rows) gives components and variances to double precision, and the
   covariance of the whitened rows measures what is left.

A spectrum is d * d numbers, whatever the number of rows: that is what goes to
the driver and into tasks.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store

#: Entries become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Spectra that one task combines.
FAN_IN = 16
#: Variance, as a part of the largest, from which on a component exists.
LEAST = 1e-11
_EPS = np.finfo(np.float64).eps


def _secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)), for rising ``d`` and positive ``z2``, and the differences d[j] - root[i].

    Each root is sought as its distance from the nearer of the two poles around
    it, by interpolation with two poles inside a shrinking bracket.
    """
    m, top = len(d), z2.sum()
    gap = np.append(np.diff(d), top)
    index = np.arange(m)
    half = gap / 2
    with np.errstate(all="ignore"):
        beyond = 1 + (z2 / (d - d[:, None] - half[:, None])).sum(1) < 0
        shift = beyond & (index < m - 1)
        origin = index + shift
        apart = d - d[origin][:, None]
        lo = np.where(shift, -half, np.where(beyond, half, 0.0))
        hi = np.where(shift, 0.0, np.where(beyond, gap, half))
        root = (lo + hi) / 2
        lower = np.tri(m, dtype=bool)
        after = np.minimum(index + 1, m - 1)
        open_ = np.ones(m, bool)
        for _ in range(80):
            delta = apart - root[:, None]
            t = z2 / delta
            f = 1 + t.sum(1)
            slope = t / delta
            rise = slope.sum(1)
            open_ &= np.abs(f) > 2 * m * _EPS * (1 + np.abs(t).sum(1))
            if not open_.any():
                break
            lo, hi = np.where(f < 0, root, lo), np.where(f < 0, hi, root)
            here, there = delta[index, index], delta[index, after]
            left = np.where(lower, slope, 0).sum(1)
            c = f - here * left - there * (rise - left)
            a = (here + there) * f - here * there * rise
            b = here * there * f
            s = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - s) / (2 * c), 2 * b / (a + s))
            step[-1] = here[-1] + here[-1] ** 2 * rise[-1] / (f[-1] - here[-1] * rise[-1])
            new = root + step
            inside = (new > lo) & (new < hi)
            new = np.where(inside, new, (lo + hi) / 2)
            open_ &= new != root
            root = np.where(open_, new, root)
        return d[origin] + root, apart - root[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, weight: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (values rising) of vectors diag(values) vectors' + weight v v'."""
    z = vectors.T @ v
    length = np.sqrt(z @ z)
    tol = 4 * _EPS * max(abs(values[-1]), abs(values[0]), weight * length ** 2)
    kept = np.flatnonzero(weight * length * np.abs(z) > tol)
    if not len(kept):
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    d, zk = values[kept], z[kept]
    if len(kept) > 1 and (np.diff(d) * np.abs(zk[1:] * zk[:-1]) <= tol * (zk[1:] ** 2 + zk[:-1] ** 2)).any():
        stay, p = [], int(kept[0])
        for q in kept[1:].tolist():
            r = np.hypot(z[p], z[q])
            c, s = z[q] / r, z[p] / r
            if abs((values[q] - values[p]) * c * s) <= tol:
                z[p], z[q] = 0.0, r
                vectors[:, [p, q]] = vectors[:, [p, q]] @ np.array([[c, s], [-s, c]])
                values[p], values[q] = values[p] * c * c + values[q] * s * s, values[p] * s * s + values[q] * c * c
            else:
                stay.append(p)
            p = q
        kept = np.array([*stay, p])
        kept = kept[np.argsort(values[kept], kind="stable")]
        d, zk = values[kept], z[kept]
    if len(kept) == 1:
        values[kept] = d + weight * zk ** 2
    else:
        roots, delta = _secular_roots(d, weight * zk ** 2)
        m = len(d)
        # the update vector that has these roots exactly
        i, j = np.arange(m)[:, None], np.arange(m)[None, :]
        below = np.where(i < j, d[:, None] - d, np.append(d[1:], 0)[:, None] - d)
        below[-1] = 1
        exact = np.sqrt(np.abs(np.prod(-delta / below, axis=0))) * np.sign(zk)
        turn = (exact / delta).T
        turn /= np.sqrt((turn * turn).sum(0))
        values[kept] = roots
        vectors[:, kept] = vectors[:, kept] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and eigenpairs of the centred scatter of the vectors taken in."""

    def __init__(self, dim: int):
        self.n, self.sums, self.mean = 0, np.zeros(dim, np.int64), np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray, times: int = 1) -> None:
        n = self.n + times
        away = x - OFFSET - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * times / n, away)
        self.mean = self.mean + away * (times / n)
        self.sums = self.sums + x * times
        self.n = n

    def combine(self, other: Spectrum) -> None:
        n = self.n + other.n
        away = other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / n, away)
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, value, vector)
        self.mean = self.mean + away * (other.n / n)
        self.sums, self.n = self.sums + other.sums, n

    def row(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "n": pa.array([self.n], pa.int64()), "sums": pa.array([self.sums.tolist()], pa.list_(pa.int64())),
            **{k: pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for k, x in (("mean", self.mean), ("values", self.values), ("vectors", self.vectors))}})

    @classmethod
    def of(cls, row) -> Spectrum:
        dim = len(row["mean"])
        out = cls(dim)
        out.n, out.sums, out.mean, out.values = row["n"], np.array(row["sums"], np.int64), np.array(row["mean"]), np.array(row["values"])
        # thousands of updates cost the basis some digits
        out.vectors = np.linalg.qr(np.array(row["vectors"]).reshape(dim, dim))[0]
        return out


SPECTRUM = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _spectra(dim: int):
    def run(batches):
        own = Spectrum(dim)
        for batch in batches:
            if batch.num_rows:
                # copies count once, with their number
                for x, times in zip(*np.unique(_matrix(batch.column("x"), dim), axis=0, return_counts=True)):
                    own.add(x, int(times))
        if own.n:
            yield own.row(TaskContext.get().partitionId())
    return run


def _combined(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (-r["n"], r["values"]))
    whole = Spectrum.of(rows[0])
    for r in rows[1:]:
        whole.combine(Spectrum.of(r))
    return pa.Table.from_batches([whole.row(rows[0]["part"])])


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.array(x) for x in table.column("total").to_pylist()], axis=0)
    return pa.table({"part": table.column("part").slice(0, 1), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _folded(store: Store, rows: DataFrame, combine, schema: str):
    """The one row that is left of one row per partition, FAN_IN at a time; None without rows."""
    left = store.save(rows, "partials")
    while left.count() > 1:
        joined = left.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(combine, schema)
        left, old = store.save(joined, "partials"), left
        store.drop(old)
    out = left.first()
    store.drop(left)
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _gram(basis: np.ndarray, n: int, sums: np.ndarray):
    dim, k = basis.shape

    def run(batches):
        total = np.zeros(k * k + k)
        for batch in batches:
            y = _centred(_matrix(batch.column("x"), dim), n, sums) @ basis
            total += np.concatenate(((y.T @ y).ravel(), y.sum(0)))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                          "total": pa.array([total.tolist()], pa.list_(pa.float64()))})
    return run


def _covariance(store: Store, vectors: DataFrame, basis: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance of all rows' projections on the columns of ``basis``."""
    k = basis.shape[1]
    rows = vectors.select("x").mapInArrow(_gram(basis, n, sums), "part long, total array<double>")
    total = np.array(_folded(store, rows, _added, "part long, total array<double>")["total"])
    mean = total[k * k:] / n
    return total[:k * k].reshape(k, k) / n - np.outer(mean, mean)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    far = n * x - sums
    if float(np.abs(far).max(initial=0)) ** 2 * x.shape[1] < 2 ** 62:
        return [Decimal(v) for v in (far * far).sum(1).tolist()]
    exact = [sum(v * v for v in row) for row in far.tolist()]
    return [Decimal(v) if v < 10 ** 38 else None for v in exact]


def _whitened(basis: np.ndarray, n: int, sums: np.ndarray, explained: np.ndarray, error: float):
    dim, k = basis.shape

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            x = _matrix(batch.column("x"), dim)
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                "n": pa.array(np.full(rows * k, n, np.int64)), "deviation": pa.array(_deviation(x, n, sums), pa.decimal128(38, 0)).take(pa.array(each)),
                "whitened": pa.array((_centred(x, n, sums) @ basis).ravel()), "explained": pa.array(np.tile(explained, rows)),
                "identity_error": pa.array(np.full(rows * k, error))})
    return run


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, hold a null or non-finite entry, or one of 2**46 and
    more (no whole number of a double) are dropped. Vectors of one length can be
    compared: the most common length counts (ties: the shorter), others are
    dropped too. Each entry c becomes x = floor(64 c) + 1000000; n, means and
    covariances (divisor n) are of all that remain. Components are numbered by
    falling variance, up to ``components``; a direction without variance is none,
    so equal vectors, one vector and an empty table give no rows. ``deviation``
    is the exact sum of (n x - S)^2 over the entries (decimal; null from 10^38
    on), for sums S, which must stay below 2^63; ``whitened`` the centred vector
    projected on the component over its standard deviation; ``explained`` the
    component's part of all variance; ``identity_error`` the largest entry of
    the measured covariance of all whitened rows minus the identity. Repeated
    ids and rows and null ids count and are returned; other columns are not read.
    """
    store = Store(table.sparkSession, "whitening")
    kind = table.select(id_col).schema[0].dataType.simpleString()
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 46)))
    clean = table.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & usable)
    length = clean.filter(F.size("v") > 0).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if length is None:
        return table.sparkSession.createDataFrame([], schema)
    dim = length["dim"]
    vectors = store.save(clean.filter(F.size("v") == dim).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x")), "vectors")
    whole = Spectrum.of(_folded(store, vectors.select("x").mapInArrow(_spectra(dim), SPECTRUM), _combined, SPECTRUM))
    n, sums = whole.n, whole.sums
    ritz, turn = np.linalg.eigh(_covariance(store, vectors, whole.vectors, n, sums))
    order = np.argsort(-ritz, kind="stable")
    e, basis = ritz[order], np.linalg.qr(whole.vectors @ turn[:, order])[0]
    k = min(components, int((e > LEAST * max(e[0], 0) * dim).sum())) if e[0] > 0 else 0
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    scaled = basis[:, :k] / np.sqrt(e[:k])
    error = float(np.abs(_covariance(store, vectors, scaled, n, sums) - np.eye(k)).max())
    return vectors.mapInArrow(_whitened(scaled, n, sums, e[:k] / e.sum(), error), schema)
