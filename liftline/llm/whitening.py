"""Embedding whitening by QDWH spectral divide-and-conquer.

The covariance is gathered in whole numbers, so it is the same however the rows are dealt
out. Its size is fixed by the dimension of the vectors. There it is split: the polar factor
of the shifted covariance, found by dynamically weighted Halley steps, is +1 on the
eigenvectors above the shift and -1 below, which gives projectors to two invariant
subspaces; each is split again until one dimension is left. The components, a matrix of
dimension by components, go to all tasks with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32

_EPS = np.finfo(float).eps
_LONG = 2**63


def usable_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` (array of double) of the rows that can be fitted.

    Left out: null vectors, empty ones, those with null or non-finite entries or entries so
    large that their whole number is no long, and vectors of another length than most (of
    lengths that are equally frequent the largest).
    """
    vectors = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    bound = float(_LONG // SCALE // 2)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))
    vectors = vectors.where("vector is not null").where(F.size("vector") > 0).where(fine)
    lengths = vectors.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return vectors.where(F.size("vector") == (most[0].length if most else 0))


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """Entries as long, without the offset."""
    lists = batch.column("vector")
    if len(lists) == 0:
        return np.zeros((0, 0), np.int64)
    return np.floor(lists.flatten().to_numpy() * SCALE).astype(np.int64).reshape(len(lists), -1)


def _exact_gram(y: np.ndarray) -> np.ndarray:
    """Sums of products of columns as Python numbers.

    Products of doubles are exact up to 2 ** 53, so rows are taken in runs whose sums stay below.
    """
    most = int(np.abs(y).max(initial=0))
    if most >= 2**26:
        wide = y.astype(object)
        return wide.T.dot(wide)
    run = max(1, 2**53 // max(1, most * most))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), run):
        part = y[start : start + run].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _totals(rows: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> dict[int, int]:
    """Adds up the arrays of whole numbers that ``sums`` gives for the rows of a batch.

    Each task adds its own batches first and sends one row per entry.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(_whole(batch))
                total = part if total is None else total + part
        if total is not None:
            values = [str(v) for v in total.ravel().tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["entry", "value"])

    each = rows.select("vector").mapInArrow(partial, "entry int, value string")
    added = each.groupBy("entry").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return {r.entry: int(r.value) for r in added.collect()}


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH steps.

    Early steps, with large weights, are done by QR of stacked matrices; later ones by an
    inverse of a well-conditioned matrix.
    """
    size = np.linalg.norm(a)
    x = a / size
    # No singular value of a matrix that can be told from a singular one is smaller.
    low, one = _EPS, np.eye(len(a))
    for _ in range(60):
        square = low * low
        root = np.cbrt(4 * (1 - square) / (square * square))
        p = math.sqrt(1 + root) + 0.5 * math.sqrt(max(0.0, 8 - 4 * root + 8 * (2 - square) / (square * math.sqrt(1 + root))))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            base, _ = np.linalg.qr(np.vstack([math.sqrt(r) * x, one]))
            top, bottom = base[: len(a)], base[len(a) :]
            new = (q / r) * x + (p - q / r) / math.sqrt(r) * (top @ bottom.T)
        else:
            new = (q / r) * x + (p - q / r) * np.linalg.solve(one + r * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 10 * _EPS and moved < len(a) * 100 * _EPS:
            break
    return x


def _orthonormal(p: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` columns that span the range of a projector."""
    base, _ = np.linalg.qr(p @ rng.standard_normal((len(p), k)))
    base, _ = np.linalg.qr(p @ base)
    return base


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first k columns belong to the larger eigenvalues.

    None if the matrix is a multiple of the identity up to rounding. The mean of the
    eigenvalues lies between them; where it hits one, shifts near it are tried.
    """
    n, middle = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - middle * np.eye(n)) / math.sqrt(n)
    if spread <= n * _EPS * max(abs(middle), np.linalg.norm(a) / math.sqrt(n)):
        return None
    best = None
    for step in (0.0, 0.05, -0.05, 0.11, -0.11, 0.23, -0.23, 0.37, -0.37):
        projector = (polar(a - (middle + step * spread) * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        base = np.hstack([_orthonormal(projector, k, rng), _orthonormal(np.eye(n) - projector, n - k, rng)])
        base, _ = np.linalg.qr(base)
        rest = np.abs(base[:, :k].T @ a @ base[:, k:]).max()
        if best is None or rest < best[0]:
            best = (rest, base, k)
        if rest <= 100 * n * _EPS * np.linalg.norm(a):
            break
    return None if best is None else (best[1], best[2])


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    rng = np.random.default_rng(20240501)
    found, todo = [], [(np.eye(len(a)), a)]
    while todo:
        base, part = todo.pop()
        split = _split(part, rng) if len(part) > 1 else None
        if split is None:
            found.append(base)
            continue
        turn, k = split
        for columns in (turn[:, :k], turn[:, k:]):
            below = columns.T @ part @ columns
            todo.append((base @ columns, (below + below.T) / 2))
    x = np.hstack(found)
    for _ in range(2):
        x = _refined(a, x)
    # The nearest orthonormal columns, to second order.
    x = x @ (3 * np.eye(len(a)) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def _refined(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step of iterative refinement of all eigenvectors at once (Ogita and Aishima)."""
    off = np.eye(len(a)) - x.T @ x
    inner = x.T @ a @ x
    values = np.diag(inner) / (1 - np.diag(off))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= 2 * (np.linalg.norm(inner - np.diag(values)) + np.linalg.norm(a) * np.linalg.norm(off)) + len(a) * _EPS * np.abs(values).max(initial=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.where(near, off / 2, (inner + values[None, :] * off) / gap)
    return x + x @ step


@dataclass(frozen=True)
class Whitening:
    """What the tasks need: bounded by the dimension, whatever the number of rows."""

    n: int
    sums: list[int]  # per dimension, of entries without the offset
    values: np.ndarray  # eigenvalues of the components
    vectors: np.ndarray  # dimension x components
    trace: float

    def pivot(self) -> np.ndarray:
        """The mean as whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def rest(self) -> list[int]:
        """Sums of the entries without the pivot."""
        return [s - self.n * p for s, p in zip(self.sums, self.pivot().tolist(), strict=True)]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """``y`` has entries without the offset."""
        mean = np.array([r / self.n for r in self.rest()])
        return ((y - self.pivot()).astype(np.float64) - mean) @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learns from all rows of :func:`usable_vectors`; None if there are none.

    Sums first, then products of entries less the rounded mean. What reaches the driver are
    sums per dimension and pair of dimensions. Components of eigenvalue zero, up to
    rounding, are left out, as they cannot be scaled: n vectors have fewer than n.
    """
    given = _totals(rows, lambda y: np.append(y.astype(object).sum(axis=0), len(y)))
    if not given:
        return None
    dims = len(given) - 1
    start = Whitening(given[dims], [given[d] for d in range(dims)], np.ones(0), np.ones((dims, 0)), 0.0)
    n, pivot, rest = start.n, start.pivot(), start.rest()
    upper = np.triu_indices(dims)
    products = _totals(rows, lambda y: _exact_gram(y - pivot)[upper])
    cov = np.zeros((dims, dims))
    for entry, (i, j) in enumerate(zip(*(u.tolist() for u in upper), strict=True)):
        cov[i, j] = cov[j, i] = (n * products[entry] - rest[i] * rest[j]) / (n * n)
    values, vectors = eigenvectors(cov)
    kept = np.flatnonzero(values > dims * _EPS * max(values[0], 0))[:components]
    return Whitening(n, start.sums, values[kept], vectors[:, kept], float(np.trace(cov)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity.

    Measured over all rows. Sums are rounded to 2 ** -40 per task and added as whole numbers,
    so that their order does not matter.
    """
    k, unit = len(model.values), 2.0**40

    def sums(y: np.ndarray) -> np.ndarray:
        w = model.whitened(y)
        parts = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()]) * unit
        return np.array([round(v) for v in parts.tolist()], object)

    found = _totals(rows, sums)
    total = np.array([found[i] / unit / model.n for i in range(k + k * k)])
    mean, cov = total[:k], total[k:].reshape(k, k)
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id``, ``deviation``, ``whitened`` (array, by component) of :func:`usable_vectors`.

    ``deviation`` is the sum over dimensions of (n x - S) ** 2, exact; null where no long
    holds it. Rows that repeat a vec_id, or have none, are judged one by one.
    """
    n, pivot, rest = model.n, model.pivot(), model.rest()

    def deviations(y: np.ndarray) -> list[int | None]:
        reach = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
        if reach * reach * y.shape[1] < _LONG:
            apart = n * y - np.array(rest, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = n * y.astype(object) - np.array(rest, object)
        return [d if d < _LONG else None for d in (apart * apart).sum(axis=1).tolist()]

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _whole(batch)
                w = model.whitened(y)
                offsets = np.arange(len(y) + 1, dtype=np.int32) * w.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(y - pivot), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    schema = S.StructType(
        [
            rows.schema["vec_id"],
            S.StructField("deviation", S.LongType()),
            S.StructField("whitened", S.ArrayType(S.DoubleType())),
        ]
    )
    return rows.mapInArrow(white, schema)


def whitened_rows(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vec_id``, ``embedding`` and component, from the largest.

    An entry c counts as floor(64 c) + 1,000,000. ``whitened`` is the row less the mean,
    projected on the component, over the root of its eigenvalue; ``explained`` the
    eigenvalue's share of the trace; ``n``, ``identity_error`` are the same for all rows.
    Which rows are usable, see :func:`usable_vectors`. No usable row, or no variance, gives an
    empty result. More columns are ignored.
    """
    rows = usable_vectors(embeddings)
    model = fit(rows, components)
    kind = rows.schema["vec_id"].dataType
    if model is None or not len(model.values):
        empty = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(identity_error(rows, model)).alias("identity_error"),
    )
