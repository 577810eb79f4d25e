"""Whitening of embeddings with eigenvectors that are found in single precision and refined to double precision.

Entries become whole numbers (floor(SCALE * c)). The fit list holds each distinct vector once. Its covariance is summed by the tasks, from entries centred by
the rounded mean: these are whole numbers, so products and sums are exact while they stay below 2 ** 53, in whatever order tasks end. What the
rounding left of the mean, half a unit at most, is taken off the sum.

The covariance (dimensions squared, whatever the number of rows) gets float32 eigenvectors. Each round of the refinement of Ogita and Aishima is a
few matrix products in extended precision: from R = I - X'X and S = X'AX follow new eigenvalues and a correction of X that squares the error. Eigenvalues
closer than the round's error bound are a cluster: it can't tell their vectors apart, so the small problem X_c'(A - mu I)X_c of the cluster is
solved by itself, with the common part mu taken off first, and the rounds go on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

SCALE = 256
LONGEST = 2**63


def refine(a: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, from float32 vectors by refinement in extended precision."""
    a = np.asarray(a, np.longdouble)
    size = float(np.abs(a).max(initial=0))
    if not len(a) or size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / np.longdouble(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye, eps = np.eye(len(a), dtype=np.longdouble), np.finfo(np.float64).eps
    before = np.inf
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small gap would turn vectors towards each other
        e = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        error = max(float(np.abs(r).max()), float(np.abs(off).max()))
        delta = 2 * (np.linalg.norm(off.astype(float)) + float(np.abs(e).max()) * np.linalg.norm(r.astype(float)))
        if error <= eps / 8 or error >= before / 2 and error <= 16 * eps:
            break
        before = error
        gap = e[None, :] - e[:, None]
        near = np.abs(gap) <= delta
        correction = np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ correction
        x = _split_clusters(a, x, e, delta)
    order = np.argsort(-e, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return (e[order] * np.longdouble(size)).astype(float), x.astype(float)


def clusters(e: np.ndarray, delta: float) -> list[np.ndarray]:
    """Indices of eigenvalues that are chained by distances of delta or less, two or more together."""
    order = np.argsort(e)
    cut = np.flatnonzero(np.diff(e[order]) > delta) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def _split_clusters(a: np.ndarray, x: np.ndarray, e: np.ndarray, delta: float) -> np.ndarray:
    """Within each cluster the basis that makes the matrix diagonal there."""
    x = x.copy()
    for c in clusters(e, delta):
        basis = x[:, c]
        mu = e[c].mean()
        small = basis.T @ (a @ basis - mu * basis)  # the differences alone, so that none of their digits are lost
        small = (small + small.T) / 2
        scale = float(np.abs(small).max())
        if float(np.abs(small - np.diag(np.diag(small))).max()) > np.finfo(float).eps / 8:  # else this basis is as good as any
            x[:, c] = basis @ np.linalg.eigh((small / np.longdouble(scale)).astype(float))[1].astype(np.longdouble)
    return x


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _gram(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)))
        for b in batches:
            y = (_matrix(b["x"]) - centre).astype(float)
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(centre))), "row": pa.array(list(total), pa.list_(pa.float64()))})

    return run


class Whitening:
    """What one fit found: n, sums S (whole numbers), eigenvalues and eigenvectors of the components kept, the trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; a component without variance has none."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])  # x - S/n as whole part and fraction keeps all digits
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((x - whole).astype(float) - rest) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 as a whole number; None where a long can't hold it."""
        n, most = self.n, max([1, *map(abs, self.sums)])
        if len(x) and x.size and (n * int(max(-int(x.min()), int(x.max()), 0)) + most) ** 2 * x.shape[1] < LONGEST:
            y = n * x - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < LONGEST else None for v in exact]


def _moments(fit: Whitening, k: int):
    """Per task: rows, mean and centred products of the whitened vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = fit.whitened(_matrix(b["x"]))
            if not len(w):
                continue
            own = w.mean(0)
            apart = own - mean
            m2 += (w - own).T @ (w - own) + np.outer(apart, apart) * (n * len(w) / (n + len(w)))
            mean, n = mean + apart * (len(w) / (n + len(w))), n + len(w)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": pa.array([mean], pa.list_(pa.float64())), "m2": pa.array([m2.ravel()], pa.list_(pa.float64()))})

    return run


def identity_error(xs: DataFrame, fit: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, over components that have variance."""
    good = np.flatnonzero(fit.values > 0)
    if not len(good):
        return 0.0
    some = Whitening(fit.n, fit.sums, fit.values[good], fit.vectors[:, good], fit.trace)
    k, n = len(good), 0
    mean, m2 = np.zeros(k), np.zeros((k, k))
    for r in xs.mapInArrow(_moments(some, k), "n long, mean array<double>, m2 array<double>").collect():  # a few numbers a task
        apart = np.array(r["mean"]) - mean
        m2 += np.array(r["m2"]).reshape(k, k) + np.outer(apart, apart) * (n * r["n"] / (n + r["n"]))
        mean, n = mean + apart * (r["n"] / (n + r["n"])), n + r["n"]
    return float(np.abs(m2 / n - np.eye(k)).max())


def fit_whitening(xs: DataFrame, components: int) -> Whitening:
    """From a table of distinct vectors x. The driver gets sums by dimension and the covariance, whose size the rows don't change."""
    n, short, long = xs.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n or not long:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    if short != long:
        raise ValueError(f"vectors of {short} and of {long} entries can't be whitened together")
    by_place = xs.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(by_place)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rows = xs.mapInArrow(_gram(centre), "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    v = np.zeros((long, long), np.longdouble)
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        v[r["i"], r["j"]] = r["v"]
    left = np.array([np.longdouble(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)], np.longdouble)
    v = v / n - np.outer(left, left)
    values, vectors = refine(v)
    tiny = values <= max(float(values[0]), 0.0) * long * np.finfo(float).eps
    values = np.where(tiny, 0.0, values)
    return Whitening(n, sums, values[:components], vectors[:, :components], float(np.trace(v)))


def _rows(fit: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, k = _matrix(b["x"]), len(fit.values)
            if not len(x) or not k:
                continue
            w = fit.whitened(x).ravel()
            w = pa.array(w, pa.float64(), mask=np.tile(fit.values <= 0, len(x)))
            of = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_pydict({
                "id": b["id"].take(of), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), "n": pa.array(np.full(len(of), fit.n), pa.int64()),
                "deviation": pa.array(fit.deviation(x), pa.int64()).take(of), "whitened": w,
                "explained": pa.array(np.tile(fit.values / fit.trace if fit.trace else fit.values, len(x)), pa.float64()), "identity_error": pa.array(np.full(len(of), error))})

    return run


def whole_numbers(column: str) -> Column:
    """floor(SCALE * entry) of each entry as a long."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """A row per row and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, or holds null, NaN or infinite entries, are dropped. Each distinct vector counts once in the fit, however often it stands in the
    table; copies all get the same figures. Components without variance (fewer distinct vectors than dimensions, constant entries) have `whitened` null and
    `explained` 0, and `identity_error` leaves them out. Fewer dimensions give fewer components, an empty table no rows; vectors of different
    lengths are an error. A null id is kept; other columns are ignored. `deviation` is null where a long can't hold it.
    """
    fine = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    good = rows.filter(fine).select(F.col(id_col).alias("id"), whole_numbers(vector_col).alias("x"))
    xs, path = written(good.select("x").distinct())
    fit = fit_whitening(xs, components)
    error = identity_error(xs, fit)
    forget(rows.sparkSession, path)
    kind = good.schema["id"].dataType.simpleString()
    out = good.mapInArrow(_rows(fit, error), f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
