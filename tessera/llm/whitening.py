"""Embedding whitening by shifted CholeskyQR: Gram passes orthogonalise the centred rows, the composed R has the components.

Vectors are whole numbers here, floor(scale * entry), so equal vectors are equal and sums are exact."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, enter, materialize

EPS = np.finfo(float).eps
#: Columns of a Gram matrix that one row of a partial sum holds.
WIDE = 32
#: Most numbers that a task holds of a block of rows.
BLOCK = 1 << 21
#: Passes after which the rows must be orthonormal.
MOST_PASSES = 8


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums `sums`, the components' columns and deviations, and what they explain."""

    n: int
    sums: tuple[int, ...]
    largest: int
    axes: np.ndarray  # dimensions x components, unit columns
    values: np.ndarray  # variance along each
    explained: np.ndarray
    error: float  # largest entry of the whitened rows' covariance minus the identity
    passes: int


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of every entry in double precision; beyond a long's range it stands at the range's end."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _slices(batches, dims: int):
    """Batches of at most BLOCK numbers, so that the memory of a task doesn't grow with the dimensions."""
    size = max(1, BLOCK // max(1, dims))
    for b in batches:
        for lo in range(0, b.num_rows, size):
            yield b.slice(lo, size)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n with one rounding: whole parts are subtracted as whole numbers."""
    base = [s // n for s in sums]
    rest = np.array([(s - b * n) / n for s, b in zip(sums, base)])
    if all(abs(b) < 1 << 61 for b in base) and (not x.size or (x.max() < 1 << 61 and x.min() > -(1 << 61))):
        return (x - np.array(base, dtype=np.int64)) - rest
    return (x.astype(object) - np.array(base, dtype=object)).astype(float) - rest


def _solve(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Q with Q @ upper = rows, column after column."""
    q = np.empty_like(rows)
    for j in range(rows.shape[1]):
        q[:, j] = (rows[:, j] - q[:, :j] @ upper[:j, j]) / upper[j, j]
    return q


def totals(fit: DataFrame, dims: int) -> tuple[int, tuple[int, ...], int]:
    """Number of rows, exact sum of each dimension, largest absolute entry.  A task sums the high and low halves of its
    numbers apart, so nothing overflows; the tasks' sums are added by dimension."""

    def run(batches):
        enter("whitening")
        n, high, low, most = 0, np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64), 0
        for b in _slices(batches, dims):
            x = _matrix(b.column("x"), dims)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            if x.size:
                most = max(most, int(x.max()), -int(x.min()))
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "high": pa.array(high), "low": pa.array(low), "most": pa.array([Decimal(most)] * dims, pa.decimal128(38, 0))})

    part = fit.mapInArrow(run, "dim int, n bigint, high bigint, low bigint, most decimal(38,0)")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = part.groupBy("dim").agg(F.sum("n").alias("n"), (exact("high") * F.lit(1 << 32).cast("decimal(11,0)") + exact("low")).cast("decimal(38,0)").alias("s"), F.max("most").alias("most")).collect()  # a row a dimension
    by = {r.dim: r for r in rows}
    return (by[0].n if by else 0), tuple(int(by[j].s) for j in range(dims)) if by else (), max([int(r.most) for r in rows], default=0)


def gram(fit: DataFrame, dims: int, n: int, sums: tuple[int, ...], step) -> np.ndarray:
    """Sum over all rows of q q', q = step(centred rows): each task adds up its own, the tasks' sums meet by entry."""
    wide = step(np.zeros((0, dims))).shape[1]

    def run(batches):
        enter("whitening")
        total, seen = np.zeros((wide, wide)), False
        for b in _slices(batches, dims):
            q = step(_centred(_matrix(b.column("x"), dims), n, sums))
            total += q.T @ q
            seen = True
        if seen:
            i, j = np.divmod(np.arange(wide * -(-wide // WIDE)), -(-wide // WIDE))
            padded = np.zeros((wide, -(-wide // WIDE) * WIDE))
            padded[:, :wide] = total
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(padded.reshape(-1, WIDE).tolist(), pa.list_(pa.float64()))})

    part = fit.mapInArrow(run, "i int, j int, v array<double>")
    rows = part.groupBy("i", "j").agg(*(F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(WIDE))).collect()  # the matrix, once
    out = np.zeros((wide, -(-wide // WIDE) * WIDE))
    for r in rows:
        out[r.i, r.j * WIDE : (r.j + 1) * WIDE] = r[2:]
    return (out[:, :wide] + out[:, :wide].T) / 2


def _open(eigenvalues: np.ndarray) -> bool:
    """Whether some direction is neither orthonormal yet nor without variance."""
    return bool(((np.abs(eigenvalues - 1) > 1e-13 * len(eigenvalues)) & (eigenvalues > 1e-10)).any())


def _factor(g: np.ndarray, least: float) -> np.ndarray:
    """Upper R with R'R = g + shift; the shift starts at `least` and grows until the factor exists."""
    shift = least
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, EPS * max(np.trace(g), np.finfo(float).tiny))


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", scale: int = 256, components: int = 4) -> Whitening | None:
    """Whitening of the distinct whole vectors of `vectors`; None where none is usable.

    Each pass takes the centred rows through the triangular solves of the factors found so far and sums their Gram
    matrix.  The first factor is shifted by as much as rounding may have cost, so it exists for dependent columns too; the
    later ones take out what the shift left, until the rows are orthonormal.  R is the product of the factors, and the
    singular vectors of R are those of the rows.  The driver holds matrices of dimensions x dimensions, never rows."""
    x = vectors.filter(usable(F.col(vector_col))).select(whole(F.col(vector_col), scale).alias("x"))
    dims = x.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return None
    width = F.lit(dims)
    padded = F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), width - F.size("x"))))
    fit = materialize(x.select(padded.alias("x")).distinct(), "whitening-rows")  # copies meet inside each task first
    try:
        n, sums, largest = totals(fit, dims)
        factors: list[np.ndarray] = []

        def through(rows: np.ndarray) -> np.ndarray:
            for r in factors:
                rows = _solve(rows, r)
            return rows

        while len(factors) < MOST_PASSES:
            g = gram(fit, dims, n, sums, through)
            size = float(np.linalg.norm(g, 2))
            if not size or not np.isfinite(size):
                break
            if len(factors) > 1 and not _open(np.linalg.eigvalsh(g)):
                break
            factors.append(_factor(g, 11 * (dims * min(n, 1 << 20) + dims * (dims + 1)) * EPS / 2 * size if not factors else 0.0))
        r = np.eye(dims)
        for f in factors:
            r = f @ r
        _, sigma, axes = np.linalg.svd(r) if factors else (None, np.zeros(dims), np.eye(dims))
        values = sigma**2 / n
        kept = min(components, int((values > dims * EPS * values[0]).sum()) if values[0] > 0 else 0)
        axes = axes[:kept].T
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
        found = Whitening(n, sums, largest, axes, values[:kept], values[:kept] / values.sum() if kept else values[:0], 0.0, len(factors))
        if kept:
            cov = gram(fit, dims, n, sums, lambda rows: rows @ (axes / np.sqrt(values[:kept]))) / n
            found = Whitening(**{**found.__dict__, "error": float(np.abs(cov - np.eye(kept)).max())})
        return found
    finally:
        discard(fit)


def whiten(vectors: DataFrame, model: Whitening | None, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = 256) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error of every usable row and component.

    Rows whose vector is null or holds a null or a non-finite entry are left out; repeated rows and null ids are rows like
    others; columns of other names are ignored.  Vectors shorter than the longest end in zeros.  Components without
    variance don't exist: fewer than four rows apart, or equal ones, give fewer components or none.  Components of equal
    variance are any orthogonal ones, the same for all rows.  `deviation` is decimal where it may not fit a long, and null
    where it does not fit 38 digits."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    dims = len(model.sums) if model else 0
    small = bool(model) and dims * (2 * model.n * max(1, model.largest)) ** 2 < 1 << 62
    schema = f"`{id_col}` {id_type}, component int, n bigint, deviation {'bigint' if small or not model else 'decimal(38,0)'}, whitened double, explained double, identity_error double"
    rows = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), whole(F.col(vector_col), scale).alias("x"))
    if not model or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k, sums = len(model.values), np.array(model.sums, dtype=np.int64 if small else object)

    def run(batches):
        enter("whitening")
        for b in _slices(batches, dims):
            x = _matrix(b.column("x"), dims)
            off = x * model.n - sums if small else x.astype(object) * model.n - sums
            far = (off * off).sum(axis=1)
            if not small:
                far = [Decimal(int(v)) if abs(int(v)) < 10**38 else None for v in far]
            white = _centred(x, model.n, model.sums) @ (model.axes / np.sqrt(model.values))
            m = len(x)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(np.repeat(far, k), pa.int64()) if small else pa.array([v for v in far for _ in range(k)], pa.decimal128(38, 0)), pa.array(white.reshape(-1)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.error))], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
