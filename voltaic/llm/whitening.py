"""Embedding whitening by incremental eigendecomposition (operator 12).

Entries become integers ``floor(scale * c)``. The fit list holds every distinct integer vector once; mean and covariance
are those of the fit list (divisor n), all rows are whitened with them.

1. Each task walks over its part of the fit list and keeps count, exact sums and the spectrum (eigenvalues and
   eigenvectors) of the part's centred scatter. A vector x is one rank-one update, ``k/(k+1) (x-m)(x-m)'``: its
   eigenvalues are the roots of a secular equation between the old ones, found by rational interpolation with
   brackets; entries of the update that are negligible, and eigenvalues that coincide, are deflated first. Eigenvectors
   come from the Loewner formula, so they stay orthogonal.
2. Spectra are combined ``FAN_IN`` at a time, tree by tree: the other part's eigenpairs and the difference of the two
   means are rank-one updates like a vector. No task holds more than ``FAN_IN`` spectra.
3. Rayleigh-Ritz over the whole fit list: the centred vectors are projected on the combined (re-orthogonalised) basis
   and the projected covariance, summed over all tasks, is diagonalised once more. The basis is complete, so this
   leaves rounding of double precision only, whatever the updates before accumulated.

The driver holds d x d numbers. Dropped are rows whose vector is null or empty, holds null or non-finite entries or has
another length than most vectors (ties: the longer). Integers are held within +-2**40. Repeated rows and ids are
whitened each; the component numbers stop at the dimension. A component without variance (fewer distinct vectors than
components, equal vectors) has null ``whitened``, and null ``explained`` if there is no variance at all;
``identity_error`` is measured over the components with variance (null if there are none). ``deviation`` is null beyond
a long. An empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.llm.centroids import whole
from voltaic.llm.graph import free_names
from voltaic.session import cut_lineage

HELD = 1 << 40
FAN_IN = 16
NO_VARIANCE = 1e-13            # of the trace
EPS = np.finfo(np.float64).eps
_STATE = "part long, n long, sums array<decimal(38,0)>, values array<double>, vectors array<double>"


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (d - x)) = 0`` for ascending distinct ``d`` and positive ``z2``: (nearest pole,
    offset from it) of each root, in the order of ``d``."""
    m = len(d)
    width = np.append(np.diff(d), rho * z2.sum())
    last = np.arange(m) == m - 1
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + rho * (z2 / (d - d[:, None] - width[:, None] / 2)).sum(1)
        left = (middle >= 0) | last
        origin = np.where(left, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
        lo = np.where(left, 0.0, -width / 2)
        hi = np.where(left, np.where(last, width, width / 2), 0.0)
        pole = d - d[origin][:, None]
        below = np.tri(m, dtype=bool)                       # poles up to the root's own
        own, nxt = pole[np.arange(m), np.arange(m)], pole[np.arange(m), np.minimum(np.arange(m) + 1, m - 1)]
        t = (lo + hi) / 2
        for _ in range(80):
            gap = pole - t[:, None]
            term = rho * z2 / gap
            slope = term / gap
            f = 1 + term.sum(1)
            done = (np.abs(f) <= 4 * EPS * m * (1 + np.abs(term).sum(1))) | (hi - lo <= 4 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if done.all():
                break
            lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
            a, b = own - t, nxt - t
            s = np.where(below, slope, 0).sum(1) * a * a
            r = np.where(last, 0.0, np.where(below, 0, slope).sum(1) * b * b)
            c = f - s / a - np.where(last, 0.0, r / b)
            # c + s/(a-x) + r/(b-x) = 0; the last root has one pole only
            p, q = c * (a + b) + s + r, f * a * b
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(last, a + s / c, np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root)))
            new = t + step
            t = np.where(done, t, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
    return origin, t


def rank_one(values: np.ndarray, vectors: np.ndarray, w: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``vectors @ diag(values) @ vectors.T + rho * w w'`` (rho >= 0, values ascending)."""
    z = w @ vectors
    size = float(z @ z)
    if not rho * size > 0:
        return values, vectors
    z, rho = z / np.sqrt(size), rho * size
    tol = 8 * EPS * max(abs(values[0]), abs(values[-1]), rho)
    live = np.flatnonzero(rho * np.abs(z) > tol)
    a, b = live[:-1], live[1:]
    if (np.diff(values[live]) * np.abs(z[a] * z[b]) <= tol * (z[a] ** 2 + z[b] ** 2)).any():
        values, vectors, z, kept = values.copy(), vectors.copy(), z.copy(), []
        i = live[0]
        for j in live[1:]:                                  # equal eigenvalues: turn the pair until one entry is zero
            h = np.hypot(z[i], z[j])
            c, s = z[j] / h, z[i] / h
            if (values[j] - values[i]) * abs(c * s) <= tol:
                vi, vj = vectors[:, i].copy(), vectors[:, j].copy()
                vectors[:, i], vectors[:, j] = c * vi - s * vj, s * vi + c * vj
                low, high = values[i], values[j]
                values[i], values[j] = low * c * c + high * s * s, low * s * s + high * c * c
                z[i], z[j] = 0.0, h
            else:
                kept.append(i)
            i = j
        live = np.array([*kept, i])
        live = live[np.argsort(values[live], kind="stable")]
    if not len(live):
        return values, vectors
    d, zl = values[live], z[live]
    origin, t = secular_roots(d, zl * zl, rho)
    away = (d[:, None] - d[origin]) - t                     # d[i] - root[j]
    away[away == 0] = np.finfo(np.float64).tiny
    apart = d[:, None] - d
    np.fill_diagonal(apart, 1.0)
    apart[apart == 0] = np.finfo(np.float64).tiny
    log = (np.log(np.abs(away)) - np.log(np.abs(apart))).sum(1) / 2
    turn = np.copysign(np.exp(log - log.max()), zl)[:, None] / away
    turn /= np.sqrt((turn * turn).sum(0))
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[live], new_vectors[:, live] = d[origin] + t, vectors[:, live] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


def to_integers(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -HELD, HELD).astype(np.int64)


def _matrix(batch, dim: int, scale: float) -> np.ndarray:
    return to_integers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)


def _pack(dim: int, scale: float):
    """A vector as little-endian integers of 2, 4 or 8 bytes, whatever fits: equal vectors give equal bytes."""
    def run(batches):
        for batch in batches:
            ints = _matrix(batch, dim, scale)
            most = np.abs(ints).max(1)
            packed = np.empty(len(ints), object)
            for lo, hi, kind in ((-1, (1 << 15) - 1, "<i2"), ((1 << 15) - 1, (1 << 31) - 1, "<i4"), ((1 << 31) - 1, HELD, "<i8")):
                at = np.flatnonzero((most > lo) & (most <= hi))
                rows = ints[at].astype(kind)
                packed[at] = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["x"])
    return run


def _unpack(column, dim: int) -> np.ndarray:
    values = column.to_pylist()
    out = np.empty((len(values), dim), np.int64)
    sizes = np.array([len(v) for v in values], np.int64)
    for width in (2, 4, 8):
        at = np.flatnonzero(sizes == dim * width)
        if len(at):
            out[at] = np.frombuffer(b"".join(values[i] for i in at), f"<i{width}").reshape(-1, dim)
    return out


def _state(part: int, n: int, sums: list, values: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [n], "sums": [[Decimal(s) for s in sums]], "values": [values.tolist()],
                         "vectors": [vectors.ravel().tolist()]})


def _spectrum(dim: int):
    def run(batches):
        n, sums, mean = 0, [0] * dim, np.zeros(dim)
        values, vectors = np.zeros(dim), np.eye(dim)
        for batch in batches:
            ints = _unpack(batch.column("x"), dim)
            sums = [a + int(b) for a, b in zip(sums, ints.sum(0))]
            for x in ints.astype(np.float64):
                off = x - mean
                n += 1
                mean = mean + off / n
                values, vectors = rank_one(values, vectors, off, (n - 1) / n)
        if n:
            yield pa.RecordBatch.from_pandas(_state(TaskContext.get().partitionId(), n, sums, values, vectors), _ARROW,
                                             preserve_index=False)
    return run


_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))),
                    ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def _combine(dim: int):
    def run(states: pd.DataFrame) -> pd.DataFrame:
        states = states.sort_values("part")
        n, sums, values, vectors = 0, None, None, None
        for s in states.itertuples():
            if sums is None:
                n, sums = s.n, [int(x) for x in s.sums]
                values, vectors = np.array(s.values), np.array(s.vectors).reshape(dim, dim)
                continue
            theirs = [int(x) for x in s.sums]
            for value, vector in zip(np.array(s.values), np.array(s.vectors).reshape(dim, dim).T):
                values, vectors = rank_one(values, vectors, vector, max(value, 0.0))
            between = np.array([b / s.n - a / n for a, b in zip(sums, theirs)])
            values, vectors = rank_one(values, vectors, between, n * s.n / (n + s.n))
            n, sums = n + s.n, [a + b for a, b in zip(sums, theirs)]
        return _state(int(states["part"].iloc[0]) // FAN_IN, n, sums, values, vectors)
    return run


def _projected(dim: int, mean: np.ndarray, basis: np.ndarray):
    """Sums over the fit list of the projections (at -1 - i) and of their products (at i * columns + j)."""
    def run(batches):
        k = basis.shape[1]
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = (_unpack(batch.column("x"), dim) - mean) @ basis
            first += y.sum(0)
            second += y.T @ y
        at = [*range(-1, -1 - k, -1), *range(k * k)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([*first, *second.ravel()], pa.float64())], names=["at", "s"])
    return run


def _second_moments(fit: DataFrame, dim: int, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of the fit list's centred projections on ``basis``."""
    k = basis.shape[1]
    got = {r["at"]: r["s"] for r in fit.mapInArrow(_projected(dim, mean, basis), "at int, s double")
           .groupBy("at").agg(F.sum("s").alias("s")).collect()}
    first = np.array([got[-1 - i] for i in range(k)]) / n
    second = np.array([got[i] for i in range(k * k)]).reshape(k, k) / n - np.outer(first, first)
    return (second + second.T) / 2


def _deviations(ints: np.ndarray, n: int, sums: list) -> list:
    """Sum over dimensions of (n x - S)**2, exact; null beyond a long."""
    bound = n * int(np.abs(ints).max(initial=0)) + max(abs(s) for s in sums)
    if bound * bound * ints.shape[1] < 1 << 63:
        gap = n * ints - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    gap = n * ints.astype(object) - np.array(sums, object)
    return [s if s < 1 << 63 else None for s in (gap * gap).sum(1)]


def _whiten(dim: int, scale: float, n: int, sums: list, mean: np.ndarray, basis: np.ndarray, live: int, explained: list, error):
    """``basis``: unit eigenvectors over the root of their eigenvalues; the first ``live`` have variance."""
    def run(batches):
        k = len(explained)
        for batch in batches:
            ints = _matrix(batch, dim, scale)
            rows = len(ints)
            white = np.full((rows, k), np.nan)
            white[:, :live] = (ints - mean) @ basis
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                 pa.array([n] * (rows * k), pa.int64()), pa.array(np.repeat(np.array(_deviations(ints, n, sums), object), k), pa.int64()),
                 pa.array(white.ravel(), pa.float64(), from_pandas=True), pa.array(explained * rows, pa.float64()),
                 pa.array([error] * (rows * k), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def spectrum(fit: DataFrame, dim: int) -> tuple[int, list, np.ndarray]:
    """(n, exact sums, complete orthonormal basis near the eigenvectors) of a stored fit list."""
    parts = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = cut_lineage(fit.repartition(parts).mapInArrow(_spectrum(dim), _STATE), "spectra")
    while (top := states.agg(F.max("part")).first()[0]) > 0:
        states = cut_lineage(states.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_combine(dim), _STATE), "spectra")
    state, = states.collect()                                           # d x d numbers
    basis, _ = np.linalg.qr(np.array(state.vectors).reshape(dim, dim))
    return state.n, [int(s) for s in state.sums], basis


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every remaining row and component."""
    spark = vectors.sparkSession
    rest = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = free_names(vectors.select(id_col), *[c.split()[0] for c in rest.split(", ")])
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sizes = (rows.select(F.size("v").alias("d"), whole(F.col("v"), F.size("v")).alias("ok")).where("ok and d > 0").groupBy("d")
             .agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    if not sizes:
        return spark.createDataFrame([], f"id long, {rest}").toDF(id_col, *names)
    dim = sizes[0].d
    rows = rows.where(whole(F.col("v"), dim))
    fit = cut_lineage(rows.select("v").mapInArrow(_pack(dim, scale), "x binary").distinct(), "fit-list")
    n, sums, basis = spectrum(fit, dim)
    mean = np.array([s / n for s in sums])
    ritz, turn = np.linalg.eigh(_second_moments(fit, dim, n, mean, basis))
    found, trace = np.maximum(ritz[::-1], 0.0), max(float(ritz.sum()), 0.0)
    vectors_of = (basis @ turn)[:, ::-1]
    k = min(components, dim)
    live = int((found[:k] > NO_VARIANCE * trace).sum()) if trace > 0 else 0
    lead = vectors_of[:, :live]
    lead = lead * np.sign(lead[np.abs(lead).argmax(0), np.arange(live)]) / np.sqrt(found[:live])
    error = float(np.abs(_second_moments(fit, dim, n, mean, lead) - np.eye(live)).max()) if live else None
    explained = [float(e / trace) if trace > 0 else None for e in found[:k]]
    return rows.mapInArrow(_whiten(dim, scale, n, sums, mean, lead, live, explained, error), f"id long, {rest}").toDF(id_col, *names)
