"""Embedding whitening by shifted Cholesky QR.

Entries become integers ``floor(64 c) + 1000000``; the offset cancels in every
centred value, so sums and products are taken of ``floor(64 c)`` and are exact.

1. Gram pass: each task adds up its vectors and their products in integers,
   tasks are merged in a few, and the driver holds one d x d matrix per vector
   length. ``n G - S S'`` is the centred Gram matrix times n, without rounding.
   Columns that depend on earlier ones are found exactly (elimination modulo
   two primes) and are left out of the factorisation.
2. Shifted Cholesky: R1 is the factor of the Gram matrix plus a small shift, so
   it exists however ill-conditioned the columns are. (The usual shift also
   covers rounding in the sum over n rows; the sum is exact here.)
3. Orthogonalisation passes: every task solves its centred rows against the
   triangular factors so far, one after another, and adds up the Gram matrix of
   the result; its Cholesky factor joins the list until that matrix is within
   ``CLOSE`` of the identity. R is the product of the factors; the columns left
   out follow from R and the exact Gram matrix.
4. The singular value decomposition of R (r x d) gives components (right
   singular vectors) and eigenvalues s^2 / n; the largest entry of a component
   is positive.
5. A last Gram pass measures the covariance of the whitened rows.

What reaches the driver are d x d sums from ``MERGERS`` tasks; what travels to
the executors are d x d factors. No row is collected or shuffled.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite
entry are left out; a null id is kept (it is a row of the fit); repeated rows
count each time; vectors of each length are a fit of their own; entries beyond
2^62 are held there; components of variance zero do not exist, so rows have as
many components as the rank, ``top`` at most (equal vectors: none); an empty
table gives an empty result; other columns are not read. ``deviation`` is a
decimal and null if beyond 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, tidy

TOP = 32
#: Tasks that merge the sums of all tasks.
MERGERS = 16
#: Largest entry of Gram minus identity after which one more factor suffices.
CLOSE = 1e-6
MAX_PASSES = 12
_EDGE = float(1 << 62)
_LIMB = 40
_PRIMES = (2147483647, 2147483629)


def whole_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(64 x) as float64 matrix) of usable rows, by length."""
    vec = batch.column("vec")
    length = np.asarray(vec.value_lengths().fill_null(0)).astype(np.int64)
    value = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes nan
    first = np.cumsum(length) - length
    for dim in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == dim)
        table = value[first[at][:, None] + np.arange(dim)]
        ok = np.isfinite(table).all(axis=1)
        if ok.any():
            with np.errstate(over="ignore"):
                yield at[ok], np.clip(np.floor(64.0 * table[ok]), -_EDGE, _EDGE)


def _ints(y: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers."""
    return np.array([[int(x) for x in row] for row in y.tolist()], dtype=object).reshape(y.shape)


def exact_sums(y: np.ndarray) -> np.ndarray:
    """(d + 1) x d integers: the sum of the rows over the sum of their products."""
    worst = float(np.abs(y).max(initial=1.0)) ** 2 * len(y)
    if worst < 2.0**53:
        return np.vstack((y.sum(axis=0), y.T @ y)).astype(np.int64)
    whole = _ints(y) if worst >= 2.0**62 else y.astype(np.int64)
    return np.vstack((whole.sum(axis=0), whole.T.dot(whole)))


def _limbs(a: np.ndarray) -> np.ndarray:
    """Three signed 64-bit arrays whose weighted sum (2^40, 2^80) is ``a``."""
    mask = (1 << _LIMB) - 1
    if a.dtype != object:
        return np.stack((a & mask, a >> _LIMB, np.zeros_like(a)))
    return np.stack([x.astype(np.int64) for x in (a & mask, (a >> _LIMB) & mask, a >> (2 * _LIMB))])


def _whole(limbs: np.ndarray) -> np.ndarray:
    low, mid, high = (x.astype(object) for x in limbs)
    return low + (mid << _LIMB) + (high << (2 * _LIMB))


def _out(dim: int, n: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([data.tobytes()], pa.binary())],
        names=["dim", "n", "data"])


_PART = "dim int, n long, data binary"


def _summed(per_block: Callable[[int, np.ndarray], np.ndarray | None]):
    """A batch function that adds up ``per_block`` over the vectors of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for at, y in whole_vectors(batch):
                part = per_block(y.shape[1], y)
                if part is None:
                    continue
                held = total.setdefault(y.shape[1], [0, np.zeros_like(part)])
                held[0] += len(at)
                held[1] += part
        for dim, (n, data) in total.items():
            yield _out(dim, n, data)
    return run


def _merge(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for dim, n, raw in zip(*(batch.column(c) for c in ("dim", "n", "data"))):
                part = np.frombuffer(raw.as_py(), kind)
                held = total.setdefault(dim.as_py(), [0, np.zeros(len(part), kind)])
                held[0] += n.as_py()
                held[1] = held[1] + part
        for dim, (n, data) in total.items():
            yield _out(dim, n, data)
    return run


def gram_pass(rows: DataFrame, per_block, kind: type) -> dict[int, tuple[int, np.ndarray]]:
    """length -> (vectors, sum of ``per_block`` over them): one scan, and sums of
    ``MERGERS`` tasks at the driver."""
    parts = rows.mapInArrow(tidy(_summed(per_block)), _PART).repartition(MERGERS).mapInArrow(_merge(kind), _PART)
    found: dict[int, list] = {}
    for r in sorted(parts.collect(), key=lambda r: (r.dim, bytes(r.data))):
        held = found.setdefault(r.dim, [0, 0])
        held[0] += r.n
        held[1] = held[1] + np.frombuffer(bytes(r.data), kind)
    return {dim: (n, data) for dim, (n, data) in found.items()}


def independent_columns(gram: np.ndarray) -> list[int]:
    """Columns of an integer Gram matrix that do not depend on earlier ones."""
    best: list[int] = []
    for p in _PRIMES:
        m, row, found = (gram % p).astype(np.int64), 0, []
        for col in range(m.shape[1]):
            lead = np.flatnonzero(m[row:, col])
            if not len(lead):
                continue
            m[[row, row + lead[0]]] = m[[row + lead[0], row]]
            factor = m[row + 1:, col] * pow(int(m[row, col]), -1, p) % p
            m[row + 1:, col:] = (m[row + 1:, col:] - factor[:, None] * m[row, col:] % p) % p
            row += 1
            found.append(col)
        best = max(best, found, key=len)
    return best


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``a`` times the inverse of the upper triangular ``r``, column by column."""
    q = np.empty_like(a)
    for j in range(r.shape[0]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def factor(gram: np.ndarray, trace: float) -> np.ndarray:
    """Upper Cholesky factor, of the matrix plus a shift where it has none."""
    d = len(gram)
    shift = 11.0 * d * (d + 1) * np.finfo(float).eps / 2 * trace
    for k in range(60):
        try:
            return np.linalg.cholesky(gram + (0.0 if k == 0 else shift * 4.0**(k - 1)) * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
    raise ArithmeticError("no Cholesky factor: the Gram matrix is not finite")


class Fit:
    """Sums, factors and components of the vectors of one length."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.total = n, sums[0]
        self.gram = n * sums[1:] - np.outer(self.total, self.total)  # n times the centred Gram matrix, exact
        self.columns = independent_columns(self.gram)
        inner = np.array([[int(x) / n for x in row] for row in self.gram], dtype=np.float64)
        self.trace = sum(int(self.gram[i, i]) for i in range(len(inner))) / n
        self.inner, self.factors, self.done = inner, [], not self.columns
        self.components = np.zeros((len(inner), 0))
        self.values = np.zeros(0)
        if self.columns:
            d = len(self.columns)
            some = inner[np.ix_(self.columns, self.columns)]
            shift = 11.0 * d * (d + 1) * np.finfo(float).eps / 2 * self.trace
            self.factors.append(factor(some + shift * np.eye(d), self.trace))

    def scaled(self, y: np.ndarray) -> np.ndarray:
        """n y - S, exact whole numbers."""
        top = float(np.abs(y).max(initial=0.0)) * self.n + float(max(abs(int(s)) for s in self.total))
        if top < 2.0**62:
            return y.astype(np.int64) * self.n - self.total.astype(np.int64)
        return _ints(y) * self.n - self.total

    def centred(self, y: np.ndarray) -> np.ndarray:
        return (self.scaled(y) / self.n).astype(np.float64)

    def orthogonal(self, y: np.ndarray) -> np.ndarray:
        q = self.centred(y)[:, self.columns]
        for r in self.factors:
            q = solve_rows(q, r)
        return q

    def add(self, gram: np.ndarray) -> None:
        gram = gram.reshape(len(self.columns), -1)
        self.factors.append(factor(gram, float(np.trace(gram))))
        self.done = float(np.abs(gram - np.eye(len(gram))).max()) <= CLOSE

    def decompose(self, top: int) -> None:
        if not self.columns:
            return
        r = self.factors[0]
        for f in self.factors[1:]:
            r = f @ r
        # Q'A of every column: R' (Q'A) = A_selected' A, from the exact Gram matrix
        whole = np.linalg.solve(r.T, self.inner[self.columns])
        whole[:, self.columns] = r
        _, s, vt = np.linalg.svd(whole, full_matrices=False)
        k = min(top, len(s))
        vt = vt[:k]
        lead = np.abs(vt).argmax(axis=1)
        self.components = (vt * np.sign(vt[np.arange(k), lead])[:, None]).T
        self.values = s[:k] ** 2 / self.n

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ self.components / np.sqrt(self.values)

    def deviations(self, y: np.ndarray) -> list[str]:
        """Sum over the dimensions of (n y - S)^2, exact, as decimal text."""
        d = self.scaled(y)
        if d.dtype != object and d.shape[1] <= 64 and (not d.size or int(np.abs(d).max()) < 1 << 56):
            high, low = d >> 28, d & ((1 << 28) - 1)
            parts = zip((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(),
                        (low * low).sum(axis=1).tolist())
            return [str((a << 56) + (b << 29) + c) for a, b, c in parts]
        return [str(sum(int(x) * int(x) for x in row)) for row in d.tolist()]


def fit(rows: DataFrame, top: int) -> dict[int, Fit]:
    """length -> fit of the vectors of that length."""
    sums = gram_pass(rows, lambda dim, y: _limbs(exact_sums(y)), np.int64)
    fits = {dim: Fit(n, _whole(data.reshape(3, dim + 1, dim))) for dim, (n, data) in sums.items()}
    for _ in range(MAX_PASSES):
        open_ = {dim: f for dim, f in fits.items() if not f.done}
        if not open_:
            break

        def product(dim: int, y: np.ndarray, open_=open_) -> np.ndarray | None:
            if dim not in open_:
                return None
            q = open_[dim].orthogonal(y)
            return q.T @ q

        for dim, (_, gram) in gram_pass(rows, product, np.float64).items():
            fits[dim].add(gram)
    for f in fits.values():
        f.decompose(top)
    return fits


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """length -> largest entry of the whitened rows' covariance minus identity."""
    some = {dim: f for dim, f in fits.items() if len(f.values)}

    def product(dim: int, y: np.ndarray) -> np.ndarray | None:
        if dim not in some:
            return None
        z = some[dim].whitened(y)
        return np.vstack((z.sum(axis=0), z.T @ z))

    out = {}
    for dim, (n, data) in (gram_pass(rows, product, np.float64) if some else {}).items():
        data = data.reshape(len(some[dim].values) + 1, -1)
        mean = data[0] / n
        out[dim] = float(np.abs(data[1:] / n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return out


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", top: int = TOP) -> DataFrame:
    """vec_id, dim, component, n, deviation, whitened, explained, identity_error."""
    rows = small_batches(vectors).selectExpr(f"cast(`{vec_id}` as bigint) as id", f"`{embedding}` as vec")
    fits = fit(rows, top)
    errors = identity_errors(rows, fits)
    share = {dim: (f.values * f.n / f.trace).tolist() if f.trace else [] for dim, f in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, y in whole_vectors(batch):
                dim, f = y.shape[1], fits[y.shape[1]]
                if not len(f.values):
                    continue
                z = f.whitened(y)
                edge = pa.array(np.arange(len(at) + 1) * z.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array([dim] * len(at), pa.int32()),
                     pa.array([f.n] * len(at), pa.int64()), pa.array(f.deviations(y), pa.string()),
                     pa.ListArray.from_arrays(edge, pa.array(z.ravel(), pa.float64())),
                     pa.ListArray.from_arrays(edge, pa.array(np.tile(share[dim], len(at)), pa.float64())),
                     pa.array([errors[dim]] * len(at), pa.float64())],
                    names=["vec_id", "dim", "n", "deviation", "z", "share", "identity_error"])

    wide = rows.mapInArrow(tidy(run), "vec_id long, dim int, n long, deviation string, z array<double>, "
                                      "share array<double>, identity_error double")
    return (wide.select("*", F.posexplode(F.arrays_zip("z", "share")).alias("pos", "of"))
            .selectExpr("vec_id", "dim", "pos + 1 as component", "n", "try_cast(deviation as decimal(38, 0)) as deviation",
                        "of.z as whitened", "of.share as explained", "identity_error"))
