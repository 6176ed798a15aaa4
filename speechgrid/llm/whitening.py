"""Whitening of vectors by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

The covariance matrix is never formed. All the method asks of the data is the product of the covariance with a few vectors: each
task centres its rows exactly, multiplies, and hands on one partial sum a partition; the sums are added up by a second stage, and
the driver sees one small block. What the driver holds is a subspace of at most ``most_space`` vectors and its product.

From the subspace come the Ritz pairs and, as the products of its basis are kept, their residuals without another pass. For every
leading pair that has not settled, the projected correction equation is solved by a few steps of MINRES; the equations step side by
side, so that a step is one pass for all of them. Whatever is multiplied joins the subspace, the corrections being combinations of it, so
that no direction is multiplied twice; beyond ``most_space`` vectors the leading Ritz vectors and the corrections alone stay. Settled vectors are locked: they leave the equations and are projected out of the others. The
method ends when the residual of every component, measured by a pass of its own, is within rounding of the largest eigenvalue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SAFE = 1 << 62


def _valid(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the lists of this size that hold finite numbers alone."""
    at = np.flatnonzero(pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == size)
    flat = (column if len(at) == len(column) else column.take(pa.array(at))).flatten()
    values = (flat.fill_null(float("nan")) if flat.null_count else flat).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)
    good = np.isfinite(values).all(axis=1)
    return (at, values) if good.all() else (at[good], values[good])


def grid(values: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """``floor(scale * value) + shift`` as 64-bit integers; what such an integer cannot hold raises."""
    x = np.floor(values * scale)
    if x.size and not np.abs(x).max() < _SAFE:
        raise OverflowError("an entry is too large for a 64-bit integer")
    return x.astype(np.int64) + shift


def _centred(x: np.ndarray, n: int, sums: list[int], far: int) -> np.ndarray:
    """``n * x - S``, exact: as 64-bit integers where the largest |x| (``far``) shows that they hold it, else as Python's."""
    small = n * far + max(map(abs, sums), default=0) < _SAFE
    s = np.array(sums, dtype=np.int64 if small else object)
    return (x if small else x.astype(object)) * n - s


def _parts(size: int, make: Callable[[np.ndarray], np.ndarray]):
    """A mapInArrow function: the sum over a task's rows of ``make(values)``, as rows ``i, v``; nothing from an empty task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = make(_valid(b.column(0).slice(k, 4096), size)[1])
                total = part if total is None else total + part
        if total is not None:
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat)], names=["i", "v"])
    return run


def _total(vectors: DataFrame, size: int, make: Callable[[np.ndarray], np.ndarray], many: int) -> np.ndarray:
    """The sum over all rows of ``make(values)``, an array of ``many`` numbers: partial sums a partition, added up by position."""
    got = vectors.select("v").mapInArrow(_parts(size, make), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(many)
    for r in got:
        out[r.i] = r.v
    return out


class Covariance:
    """The covariance of all vectors (divisor n), known by its products alone; ``passes`` counts them."""

    def __init__(self, vectors: DataFrame, size: int, scale: int, shift: int):
        self.vectors, self.size, self.scale, self.shift, self.passes = vectors, size, scale, shift, 0
        self.n, self.sums, self.far = self._sums()

    def _sums(self) -> tuple[int, list[int], int]:
        size, scale, shift = self.size, self.scale, self.shift

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, far, sums = 0, 0, [0] * size
            for b in batches:
                for k in range(0, b.num_rows, 4096):
                    x = grid(_valid(b.column(0).slice(k, 4096), size)[1], scale, shift)
                    top = int(np.abs(x).max(initial=0))
                    x = x if top < _SAFE >> 12 else x.astype(object)
                    n, far, sums = n + len(x), max(far, top), [a + int(s) for a, s in zip(sums, x.sum(axis=0), strict=True)]
            if n:
                whole = pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([far]), whole], names=["n", "far", "s"])

        parts = self.vectors.select("v").mapInArrow(run, "n long, far long, s array<decimal(38,0)>")
        rows = parts.select("n", "far", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("s").alias("s")).collect()
        self.passes += 1
        if not rows:
            return 0, [0] * size, 0
        return rows[0].n, [int(r.s) for r in sorted(rows, key=lambda r: r.i)], rows[0].far

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """The function from values to ``x - S/n``."""
        n, sums, far, scale, shift = self.n, self.sums, self.far, self.scale, self.shift
        return lambda values: (_centred(grid(values, scale, shift), n, sums, far) / n).astype(np.float64)

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``block``: one pass."""
        centre = self.centre()

        def make(values: np.ndarray) -> np.ndarray:
            y = centre(values)
            return y.T @ (y @ block)

        self.passes += 1
        return _total(self.vectors, self.size, make, block.size).reshape(block.shape) / self.n

    def trace(self) -> float:
        centre = self.centre()
        self.passes += 1
        return float(_total(self.vectors, self.size, lambda values: (centre(values) ** 2).sum(axis=0), self.size).sum()) / self.n


def _against(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The block without its part in the orthonormal basis; twice is enough."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def corrections(times: Callable[[np.ndarray], np.ndarray], values: np.ndarray, vectors: np.ndarray, residuals: np.ndarray, locked: np.ndarray,
                steps: int, enough: float = 1e-12) -> np.ndarray:
    """Approximate solutions t of ``(I - QQ')(A - value)(I - QQ') t = -residual`` with Q the locked vectors and the pair's own.

    One MINRES recurrence a column, all in step: a step is one product ``times`` of a block. It ends after ``steps`` of them or when
    every equation's residual is down by ``enough``."""
    many = len(values)
    own = [np.column_stack((locked, vectors[:, i])) for i in range(many)]

    def project(block: np.ndarray) -> np.ndarray:
        return np.column_stack([_against(block[:, i:i + 1], own[i]) for i in range(many)])

    v = project(-residuals)
    beta = np.linalg.norm(v, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v = v / first
    zero = np.zeros_like(v)
    before, d1, d2, t = (zero,) * 4
    one, nil = np.ones(many), np.zeros(many)
    c1, s1, c2, s2, eta, beta_now = one, nil, one, nil, beta, nil
    for _ in range(steps):
        w = project(times(v)) - v * values
        alpha = (v * w).sum(axis=0)
        w = project(w - v * alpha - before * beta_now)
        beta_next = np.linalg.norm(w, axis=0)
        # the last two Givens rotations act on the new column of the tridiagonal matrix
        r3 = s2 * beta_now
        r2 = c2 * c1 * beta_now + s1 * alpha
        r1 = c1 * alpha - s1 * c2 * beta_now
        r0 = np.hypot(r1, beta_next)
        live = r0 > 0
        r0 = np.where(live, r0, 1.0)
        c, s = np.where(live, r1 / r0, 1.0), np.where(live, beta_next / r0, 0.0)
        d = np.where(live, (v - r2 * d1 - r3 * d2) / r0, 0.0)
        t = t + c * eta * d
        eta = -s * eta
        c2, s2, c1, s1 = c1, s1, c, s
        d2, d1 = d1, d
        before, v, beta_now = v, w / np.where(beta_next > 0, beta_next, 1.0), beta_next
        if (np.abs(eta) <= enough * first).all():
            break
    return t


class Space:
    """An orthonormal basis and its product with the operator, each column multiplied once: a pass is only for new directions."""

    def __init__(self, of: Callable[[np.ndarray], np.ndarray], start: np.ndarray):
        self.of, self.basis, self.image = of, start[:, :0], start[:, :0]
        self.times(start)

    def times(self, block: np.ndarray) -> np.ndarray:
        """The operator times the columns of ``block``, which join the space."""
        old = self.basis.shape[1]
        for v in block.T:
            full = np.linalg.norm(v)
            v = _against(v[:, None], self.basis)[:, 0]
            if (length := np.linalg.norm(v)) > 1e-8 * full and self.basis.shape[1] < len(v):
                v = _against(v[:, None] / length, self.basis)
                self.basis = np.column_stack((self.basis, v / np.linalg.norm(v)))
        if self.basis.shape[1] > old:
            self.image = np.column_stack((self.image, self.of(self.basis[:, old:])))
        return self.image @ (self.basis.T @ block)

    def ritz(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ritz values, falling, Ritz vectors and their products."""
        h = self.basis.T @ self.image
        e, y = np.linalg.eigh((h + h.T) / 2)
        return e[::-1], self.basis @ y[:, ::-1], self.image @ y[:, ::-1]

    def shrink(self, block: np.ndarray) -> None:
        """Only what the columns of ``block`` span stays; all of it lies in the space."""
        c = np.linalg.qr(self.basis.T @ block)[0]
        self.basis, self.image = self.basis @ c, self.image @ c


def leading(times: Callable[[np.ndarray], np.ndarray], size: int, many: int, steps: int = 3, guard: int = 4, most_space: int = 256, rounds: int = 200, seed: int = 7,
            within: float = 64 * 2.0 ** -52) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` largest eigenvalues, falling, of a symmetric positive semidefinite operator, and unit eigenvectors as columns, with
    residuals at most ``within`` times the largest; more than ``rounds`` rounds raise. Of equal eigenvalues any basis is given."""
    many = min(many, size)
    kept = min(size, many + guard)
    space = Space(times, np.random.default_rng(seed).standard_normal((size, kept)))
    for _ in range(rounds):
        e, ritz, made = space.ritz()
        residuals = made[:, :many] - ritz[:, :many] * e[:many]
        bound = within * max(e[0], np.finfo(float).tiny)
        settled = np.linalg.norm(residuals, axis=0) <= bound
        if settled.all() or len(e) == size:
            # measured by a pass of its own, not by the kept products
            space = Space(times, ritz[:, :kept])
            e, ritz, made = space.ritz()
            residuals = made[:, :many] - ritz[:, :many] * e[:many]
            settled = np.linalg.norm(residuals, axis=0) <= bound
            if settled.all():
                return e[:many], ritz[:, :many]
        open_ = np.flatnonzero(~settled)
        t = corrections(space.times, e[open_], ritz[:, open_], residuals[:, open_], ritz[:, :many][:, settled], steps)
        if space.basis.shape[1] > max(most_space, kept + many):
            space.shrink(np.column_stack((ritz[:, :kept], t / np.linalg.norm(t, axis=0).clip(np.finfo(float).tiny))))
    raise RuntimeError("the eigenvectors did not settle")


def deviations(t: np.ndarray) -> pa.Array:
    """Row sums of the squares of ``n * x - S``, exact, as decimals of 38 digits; a longer one raises."""
    top = max(abs(int(t.max(initial=0))), abs(int(t.min(initial=0))))
    if top * top * max(1, t.shape[1]) < 1 << 63:
        return pa.array((t.astype(np.int64) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(x)) for x in (t.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))


def vectors_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``vec_id, v`` and the commonest length of the vectors (of equally common ones the longest; 0 without any). Vectors of other
    lengths and with entries that are no finite numbers are left out by the tasks, batch by batch."""
    kind = vectors.schema[vector_col].dataType.elementType
    v = F.col(vector_col) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    size = rows.filter("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows, 0 if size is None else size.d


def _whiten(centre: Callable[[np.ndarray], np.ndarray], turned: np.ndarray, exact: Callable[[np.ndarray], np.ndarray], n: int, shares: list[float], error: float, size: int):
    many = turned.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                some = b.slice(k, 4096)
                at, values = _valid(some.column(1), size)
                rows, each = len(at), np.repeat(np.arange(len(at)), many)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)), pa.array(np.full(rows * many, n)),
                     deviations(exact(values)).take(pa.array(each)), pa.array((centre(values) @ turned).reshape(-1)), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * many, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each usable vector and leading component.

    Entries become ``x = floor(scale * c) + shift``. Over the ``n`` usable rows with sums S: ``deviation`` (decimal) is the exact sum
    over dimensions of ``(n x - S)^2``; ``whitened`` is ``x - S/n`` along the component's unit eigenvector (its largest entry is
    positive) over the root of its eigenvalue; ``explained`` is the eigenvalue's share of the trace; ``identity_error`` the largest
    absolute entry of the whitened rows' covariance minus the identity, from passes of its own.

    Vectors that are null, empty, of another length than the commonest, or hold null or non-finite entries take no part. A null id is
    kept. Repeated rows count each. Components without variance (eigenvalue within rounding of zero) are left out, so fewer rows than
    ``components`` can carry, or equal vectors alone, give fewer or none; of equal eigenvalues any basis is given. Other columns are
    ignored. No rows give no rows. An entry whose x no 64-bit integer holds raises."""
    rows, size = vectors_of(vectors, id_col, vector_col)
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not size:
        return vectors.sparkSession.createDataFrame([], out)
    of = Covariance(rows, size, scale, shift)
    if not of.n:
        return vectors.sparkSession.createDataFrame([], out)
    e, u = leading(of.times, size, components)
    trace = of.trace()
    good = e > 64 * 2.0 ** -52 * max(e[0], 0.0)
    e, u = e[good], u[:, good]
    if not len(e):
        return vectors.sparkSession.createDataFrame([], out)
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    turned, centre, many = u / np.sqrt(e), of.centre(), len(e)
    n, sums, far = of.n, of.sums, of.far
    mean = _total(rows, size, lambda values: (centre(values) @ turned).sum(axis=0), many) / n

    def spread(values: np.ndarray) -> np.ndarray:
        w = centre(values) @ turned - mean
        return w.T @ w

    error = float(np.abs(_total(rows, size, spread, many * many).reshape(many, many) / n - np.eye(many)).max())
    return rows.mapInArrow(_whiten(centre, turned, lambda values: _centred(grid(values, scale, shift), n, sums, far), n, [float(x / trace) for x in e], error, size), out)
