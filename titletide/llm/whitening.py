"""Whitens embeddings along their leading principal components.

The covariance is summed where the vectors lie, from values whose integer mean part is taken off before anything is
multiplied; a matrix of dimensions x dimensions is all that moves, however many vectors there are. That matrix is brought
to tridiagonal form by Householder reflections, its leading eigenvalues are bisected by Sturm counts, and inverse
iteration gives the components, made orthogonal inside clusters of close eigenvalues. The components, as many numbers as
a few vectors, go to every task with the projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide.session import stored

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
SLICE = 4096  # vectors that are multiplied at once
EPS = np.finfo(np.float64).eps
LARGEST = 2.0 ** 62  # of an entry times the scale
SCHEMA = "vec_id long, deviation long, whitened array<double>"


# --- eigenvalues and components of one symmetric matrix ---------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """(diagonal, next diagonal, unit reflectors) of Q^T A Q; reflector k acts on the rows after k."""
    a = np.array(matrix, dtype=np.float64)
    reflectors: list[np.ndarray | None] = []
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        below = np.linalg.norm(x[1:])
        if below == 0:
            reflectors.append(None)
            continue
        target = -np.copysign(np.hypot(x[0], below), x[0])
        x[0] -= target
        x /= np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        moved = rest @ x
        moved -= (x @ moved) * x
        rest -= 2 * (np.outer(x, moved) + np.outer(moved, x))
        a[k + 1, k] = target
        reflectors.append(x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def counts_below(diagonal: np.ndarray, beside: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each shift."""
    tiny = np.finfo(np.float64).tiny * max(1.0, float((beside ** 2).max(initial=0.0)))
    pivot = diagonal[0] - shifts
    found = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - beside[i - 1] ** 2 / pivot
        found += pivot < 0
    return found


def leading_eigenvalues(diagonal: np.ndarray, beside: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` largest eigenvalues in falling order, each bisected until no double lies between its bounds."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(beside)
    reach[1:] += np.abs(beside)
    slack = 2 * n * EPS * float(np.abs(diagonal).max() + reach.max()) + np.finfo(np.float64).tiny
    low = np.full(wanted, (diagonal - reach).min() - slack)
    high = np.full(wanted, (diagonal + reach).max() + slack)
    rank = n - 1 - np.arange(wanted)  # eigenvalue j is the one with n - 1 - j below it
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        up = counts_below(diagonal, beside, middle) <= rank
        low, high = np.where(up, middle, low), np.where(up, high, middle)


def solved(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift) x = right, by elimination with row exchanges; pivots smaller than ``least`` count as that."""
    n = len(diagonal)
    main, first, second = (diagonal - shift).tolist(), [*beside.tolist(), 0.0], [0.0] * n
    lower, x = beside.tolist(), right.tolist()
    for i in range(n - 1):
        if abs(lower[i]) > abs(main[i]):
            factor = main[i] / lower[i]
            main[i], first[i], second[i], main[i + 1], first[i + 1] = (
                lower[i], main[i + 1], first[i + 1], first[i] - factor * main[i + 1], -factor * first[i + 1])
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(main[i]) < least:
                main[i] = least
            factor = lower[i] / main[i]
            main[i + 1] -= factor * first[i]
            x[i + 1] -= factor * x[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(n - 1, -1, -1):
        rest = x[i]
        if i + 1 < n:
            rest -= first[i] * x[i + 1]
        if i + 2 < n:
            rest -= second[i] * x[i + 2]
        x[i] = rest / main[i]
    return np.array(x)


def inverse_iteration(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as rows, of eigenvalues in falling order. Vectors of eigenvalues that follow each other within
    a thousandth of the matrix's size are made orthogonal to each other in every step."""
    n = len(diagonal)
    size = max(float(np.abs(diagonal).max() + 2 * np.abs(beside).max(initial=0.0)), np.finfo(np.float64).tiny)
    draw = np.random.default_rng(n)
    out = np.zeros((len(values), n))
    start, shift = 0, np.inf
    for j, value in enumerate(values):
        if j == 0 or values[j - 1] - value > 1e-3 * size:
            start = j
        shift = min(float(value), shift - 2 * EPS * size) if j > start else float(value)  # equal values: shifts apart
        vector = draw.uniform(-1, 1, n)
        for step in range(12):
            vector = solved(diagonal, beside, shift, vector / np.abs(vector).max(), EPS * size)
            for _ in range(2):  # twice is enough
                vector /= np.linalg.norm(vector)
                for other in out[start:j]:
                    vector -= (other @ vector) * other
            vector /= np.linalg.norm(vector)
            product = diagonal * vector
            product[:-1] += beside * vector[1:]
            product[1:] += beside * vector[:-1]
            if step and np.linalg.norm(product - value * vector) <= 16 * np.sqrt(n) * EPS * size:
                break
        else:
            raise ArithmeticError(f"component {j + 1} does not settle")
        out[j] = vector
    return out


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues in falling order, unit eigenvectors as rows) of a symmetric matrix; each vector's largest entry is
    positive. Values that rounding cannot tell from zero are left out."""
    size = float(np.abs(matrix).max(initial=0.0))
    if size == 0:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diagonal, beside, reflectors = tridiagonal(matrix / size)
    values = leading_eigenvalues(diagonal, beside, min(wanted, len(matrix)))
    values = values[values > 8 * len(matrix) * EPS * values[0]]
    vectors = inverse_iteration(diagonal, beside, values)
    for k in range(len(reflectors) - 1, -1, -1):
        if reflectors[k] is not None:
            vectors[:, k + 1:] -= 2 * np.outer(vectors[:, k + 1:] @ reflectors[k], reflectors[k])
    largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return values * size, vectors * np.sign(largest)[:, None]


# --- the same over all vectors ----------------------------------------------------------------------------------------

def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _slices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            part = batch.slice(low, SLICE)
            yield part, _matrix(part.column("x"), dimensions)


def _sums(dimensions: int):
    """One row of a partition: how many vectors, and their exact sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimensions
        for _, x in _slices(batches, dimensions):
            n += len(x)
            high, low = x >> 31, x & ((1 << 31) - 1)  # parts whose sums over a slice fit
            total = [t + (int(h) << 31) + int(b) for t, h, b in zip(total, high.sum(axis=0), low.sum(axis=0))]
        if n:
            sums = pa.array([[Decimal(t) for t in total]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), sums], names=["n", "sums"])
    return run


class Centre:
    """The exact mean of the fit list: its whole part and what is left, as n-ths."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        whole, left = zip(*(divmod(s, n) for s in sums))
        self.whole, self.left = np.array(whole, dtype=np.int64), np.array([r / n for r in left])
        self.parts = np.array(left, dtype=object)

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the difference of integers is exact, and one rounding follows."""
        return (x - self.whole).astype(np.float64) - self.left

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exact; null where it does not fit a long."""
        steps = x - self.whole
        largest = max(abs(int(steps.max(initial=0))), abs(int(steps.min(initial=0)))) + 1
        if (self.n * largest) ** 2 * len(self.whole) < 1 << 63:
            apart = steps * self.n - self.parts.astype(np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = steps.astype(object) * self.n - self.parts
        return [d if d < 1 << 63 else None for d in (apart * apart).sum(axis=1).tolist()]


def _products(centre: Centre, onto: np.ndarray | None = None):
    """Rows (row, values) of a partition's sum of products of centred vectors, projected first where ``onto`` says so."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _slices(batches, len(centre.whole)):
            y = centre.off(x)
            y = y if onto is None else y @ onto
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
                                             names=["row", "values"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of one number, which follow each other, without holding them."""
    now, total, rows, sums = None, None, [], []
    for batch in batches:
        for row, values in zip(batch.column("row").to_pylist(), _matrix(batch.column("values"), len(batch.column("values")[0]))):
            if row != now:
                if now is not None:
                    rows.append(now)
                    sums.append(total)
                now, total = row, values.copy()
            else:
                total += values
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*rows, now], pa.int32()), pa.array([*sums, total], pa.list_(pa.float64()))],
                                         names=["row", "values"])


def mean_products(fit: DataFrame, centre: Centre, onto: np.ndarray | None = None) -> np.ndarray:
    """The covariance of the fit list, or of its projections. A task sends one matrix and reads at least so many vectors
    that the matrices are a small part of what was read."""
    size = len(centre.whole)
    tasks = max(1, min(centre.n // (32 * size), 4096))
    parts = fit.coalesce(tasks).mapInArrow(_products(centre, onto), "row int, values array<double>")
    rows = parts.repartition(min(tasks, size), "row").sortWithinPartitions("row").mapInArrow(_added, "row int, values array<double>")
    found = {r["row"]: r["values"] for r in rows.toLocalIterator()}  # dimensions x dimensions numbers
    matrix = np.array([found[i] for i in range(len(found))]) / centre.n
    return (matrix + matrix.T) / 2


def _project(centre: Centre, onto: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, len(centre.whole)):
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(centre.deviations(x), pa.int64()), pa.array(list(centre.off(x) @ onto), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"])
    return run


def _stepped(vector: Column, scale: int, offset: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long"))


def whitened_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
                     scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null, empty, or hold an entry that is null, not finite or, times the scale, beyond 2^62 are dropped.
    The components are fitted to every different vector once, so copies weigh nothing, and every row is projected,
    copies and rows without an id included. Vectors of different lengths are fitted apart, each length by itself.
    Components whose eigenvalue rounding cannot tell from zero are not returned, so equal vectors alone give no rows, as
    does an empty table. A deviation that does not fit a long is null. Of the two signs of a component the one whose
    largest entry is positive is taken.
    """
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    read = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST / scale))
    rows = read.where(F.coalesce((F.size("vector") > 0) & ~bad, F.lit(False))).select("vec_id", _stepped(F.col("vector"), scale, offset).alias("x"))
    fit = stored(rows.select("x").dropDuplicates(), "whitening-fit")
    out = None
    for (dimensions,) in fit.select(F.size("x")).distinct().collect():  # a row for each length of vectors
        mine, wanted = fit.where(F.size("x") == dimensions), rows.where(F.size("x") == dimensions)
        sums = mine.mapInArrow(_sums(dimensions), "n long, sums array<decimal(38,0)>")
        places = sums.select("n", F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum("n"), F.sum("s")).collect()
        places.sort()
        centre = Centre(places[0][1], [int(p[2]) for p in places])
        covariance = mean_products(mine, centre)
        values, vectors = leading_components(covariance, components)
        if not len(values):
            continue
        onto = np.ascontiguousarray((vectors / np.sqrt(values)[:, None]).T)
        identity_error = float(np.abs(mean_products(mine, centre, onto) - np.eye(len(values))).max())
        explained = F.array(*(F.lit(float(v)) for v in values / np.trace(covariance)))
        placed = wanted.mapInArrow(_project(centre, onto), SCHEMA).select(
            "vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("place", "both"))
        part = placed.select(
            "vec_id", (F.col("place") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation",
            F.col("both.whitened").alias("whitened"), F.col("both.explained").alias("explained"),
            F.lit(identity_error).alias("identity_error"))
        out = part if out is None else out.unionByName(part)
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return spark.createDataFrame([], empty) if out is None else out
