"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become the longs floor(256 c). The fit list has every distinct vector once; the principal
components are eigenvectors of its covariance V, which is never formed: one pass over the fit
list gives V Q for a block Q of a few dozen vectors, as the sum over tasks of Xc' (Xc Q) with Xc
the centred vectors. A polynomial of the first kind on [0, b], applied by its three-term
recurrence (one pass a degree), damps the spectrum below b, the block's smallest Ritz value; QR
and a Rayleigh-Ritz step follow, until the residuals |V q - e q| are at rounding level.

Only tables of (dimension x block) numbers reach the driver or a task: each task sends one row a
dimension, Spark adds them up by dimension. Sums and deviations are exact integers.

Defined results: rows whose vector is missing, empty, or has an entry that is missing, not
finite or beyond 2^62 when multiplied by 256 are dropped; so are rows whose vector has not the
length of most (of lengths equally frequent, the longest); rows that repeat are all returned and
fitted once; rows without an id are returned without one; components whose eigenvalue is zero
(as many as the fit list's rank falls short of ``components``) have no rows; a deviation beyond a
long is null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialize

SCALE = 256
LARGEST = float(1 << 62)
MOST_LONG = (1 << 63) - 1


def vectors(batch, d: int) -> np.ndarray:
    return pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(-1, d)


def quantised(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows whose vector can be used."""
    v = F.col(vec_col)
    fit = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * SCALE) < LARGEST)
    usable = rows.where(v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, fit))
    return usable.select(F.col(id_col).alias("id"),
                         F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


@dataclass
class FitList:
    """The distinct vectors (a written table) with their number, exact sums and exact trace of V."""

    table: DataFrame
    n: int
    d: int
    sums: list[int]
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def fit_list(rows: DataFrame) -> FitList | None:
    """The fit list of (id, x) rows; None without rows."""
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    d = sizes["d"]
    table = materialize(rows.where(F.size("x") == d).select("x").distinct(), "fit-list")

    def run(batches):
        n, s, q = 0, [0] * d, [0] * d
        for batch in batches:
            x = vectors(batch, d)
            if np.abs(x.astype(float)).max(initial=0) >= 1 << 20:
                x = x.astype(object)
            n += len(x)
            s = [a + int(b) for a, b in zip(s, x.sum(axis=0))]
            q = [a + int(b) for a, b in zip(q, (x * x).sum(axis=0))]
        if n:
            exact = lambda v: pa.array([Decimal(i) for i in v], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), exact([n] * d), exact(s), exact(q)],
                                             ["dim", "n", "s", "q"])

    parts = table.mapInArrow(run, "dim int, n decimal(38,0), s decimal(38,0), q decimal(38,0)")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    found.sort(key=lambda r: r.dim)
    n = int(found[0].n)
    trace = sum(Fraction(n * int(r.q) - int(r.s) ** 2, n * n) for r in found)
    return FitList(table, n, d, [int(r.s) for r in found], float(trace))


def summed(parts: DataFrame, width: int) -> np.ndarray:
    """Rows (dim, v) of every task added up by dimension, as a matrix."""
    each = ", ".join(f"sum(v[{j}])" for j in range(width))
    sums = parts.groupBy("dim").agg(F.expr(f"array({each})").alias("v")).collect()
    return np.array([r.v for r in sorted(sums, key=lambda r: r.dim)])


def matrix_rows(m: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))],
                                      ["dim", "v"])


def covariance_times(fit: FitList, q: np.ndarray) -> np.ndarray:
    """V q by one pass over the fit list."""
    d, mean = fit.d, fit.mean

    def run(batches):
        total = None
        for batch in batches:
            x = vectors(batch, d) - mean
            part = x.T @ (x @ q)
            total = part if total is None else total + part
        if total is not None:
            yield matrix_rows(total)

    return summed(fit.table.mapInArrow(run, "dim int, v array<double>"), q.shape[1]) / fit.n


@dataclass
class Components:
    """Unit eigenvectors (columns) by falling eigenvalue, and what certified them."""

    vectors: np.ndarray
    values: np.ndarray
    residual: float
    passes: int


def rayleigh_ritz(q, y):
    """Ritz values (falling), vectors, and V times the vectors, of the block q with y = V q."""
    t = q.T @ y
    e, w = np.linalg.eigh((t + t.T) / 2)
    w = w[:, ::-1]
    return e[::-1], q @ w, y @ w


def principal_components(times, d: int, components: int, *, block: int = 32, most_passes: int = 2000) -> Components:
    """Leading eigenvectors of the symmetric positive operator ``times`` (block -> block).

    Certified when the residuals are below 2e-15 sqrt(d) of the largest eigenvalue, or below 1e-12
    of it and no longer falling; it is an error if ``most_passes`` are not enough.
    """
    k, m = min(components, d), min(d, max(block, 2 * components))
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((d, m)))[0]
    passes, before = 1, np.inf
    e, q, y = rayleigh_ritz(q, times(q))
    while True:
        worst = np.linalg.norm(y[:, :k] - q[:, :k] * e[:k], axis=0).max() / max(e[0], 1e-300)
        if e[0] <= 0 or worst <= 2e-15 * np.sqrt(d) or worst <= 1e-12 and worst > before / 2:
            return Components(q[:, :k], e[:k], float(worst), passes)
        if passes > most_passes:
            raise RuntimeError(f"residual {worst:.2g} after {passes} passes")
        before = worst
        b = e[-1]
        if b <= 1e-12 * e[0]:              # the block holds the whole range: nothing to damp
            z = y
        else:
            centre = half = b / 2
            ratio = (e[0] - centre) / half
            # beyond this degree the largest eigenvalue would drown the others
            degree = int(np.clip(np.log(1e12) / np.log(ratio + np.sqrt(max(ratio * ratio - 1, 1e-3))), 4, 20))
            sigma = first = half / (e[0] - centre)
            older, z = q, (y - centre * q) * (sigma / half)
            for _ in range(degree - 1):
                newer = 1 / (2 / first - sigma)
                older, z = z, (times(z) - centre * z) * (2 * newer / half) - (sigma * newer) * older
                sigma, passes = newer, passes + 1
        q = np.linalg.qr(z)[0]
        e, q, y = rayleigh_ritz(q, times(q))
        passes += 1


def whitened_covariance(fit: FitList, axes: np.ndarray) -> np.ndarray:
    """Covariance, over the fit list, of the centred vectors projected on ``axes``."""
    d, mean, k = fit.d, fit.mean, axes.shape[1]

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (vectors(batch, d) - mean) @ axes
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield matrix_rows(total)

    found = summed(fit.table.mapInArrow(run, "dim int, v array<double>"), k) / fit.n
    return found[:k] - np.outer(found[k], found[k])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 for every row, exact; None beyond a long."""
    most = n * int(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * x.shape[1] <= MOST_LONG:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [int(v) if v <= MOST_LONG else None for v in (off * off).sum(axis=1)]


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4,
           block: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row for each usable
    vector and component."""
    spark = rows.sparkSession
    usable = quantised(rows, id_col, vec_col)
    schema = usable.select("id").schema.add("component", "integer").add("deviation", "long").add("whitened", "double")
    fit = fit_list(usable)
    found = fit and principal_components(lambda q: covariance_times(fit, q), fit.d, components, block=block)
    kept = [] if found is None else [j for j, e in enumerate(found.values) if e > 1e-12 * found.values[0]]
    if not kept:
        none = spark.createDataFrame([], schema)
        return none.select(F.col("id").alias(id_col), "component", F.lit(0).cast("long").alias("n"), "deviation",
                           "whitened", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    axes = found.vectors[:, kept] / np.sqrt(found.values[kept])
    error = float(np.abs(whitened_covariance(fit, axes) - np.eye(len(kept))).max())
    d, n, mean, sums, k = fit.d, fit.n, fit.mean, fit.sums, len(kept)

    def run(batches):
        for batch in batches:
            x = vectors(batch, d)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(((x - mean) @ axes).ravel())],
                ["id", "component", "deviation", "whitened"])

    share = F.element_at(F.array(*[F.lit(float(e / fit.trace)) for e in found.values[kept]]), F.col("component"))
    return usable.where(F.size("x") == d).mapInArrow(run, schema).select(
        F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"))
