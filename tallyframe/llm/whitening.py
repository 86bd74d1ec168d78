"""Whitening of vectors by shifted CholeskyQR.

Principal components of n rows come from the QR factors of the centred rows, not from an
eigenproblem of their covariance: the rows' Gram matrix, shifted so that rounding cannot make it
indefinite, has a Cholesky factor R; the rows are multiplied by its inverse (triangular solves)
and a new Gram matrix is taken, until the rows are orthonormal. The factors multiply to the R of
a QR factorisation of the rows, and its singular values and right singular vectors are those of
the rows.

Every Gram pass is one scan: each task sums d x d products of its rows, the cells of these sums
are added by Spark, and only d (d + 1) / 2 numbers come to the driver. No pass stores rows; the
next one solves its way through all factors so far.
"""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import written

#: Gram passes at most. Three suffice for any rows whose condition double precision can hold; more help rows that lack rank.
PASSES = 6
#: Once Gram minus identity is this small, its own factor takes the rest away to double precision.
NEAR = 1e-3
#: Rows that a task solves at once.
BLOCK = 4096


def finite(vec: Column) -> Column:
    """Whether a vector is not NULL and has no NULL, NaN or infinite entry."""
    return vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The vectors of the first column as matrices of at most ``BLOCK`` rows, in the column's own type."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.column(0).slice(at, BLOCK)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def cell_sums(rows: DataFrame, vec: str, sums_of: Callable[[Iterator[np.ndarray]], np.ndarray | None], kind: str) -> np.ndarray:
    """Sums over all rows, cell by cell, of the arrays that ``sums_of`` makes of each task's blocks.

    As many numbers as one such array has come to the driver, however many rows or tasks.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums_of(blocks(batches))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    cells = rows.select(vec).mapInArrow(task, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    found = sorted((r["cell"], r["value"]) for r in cells.collect())
    return np.array([v for _, v in found], dtype=np.int64 if kind == "long" else np.float64)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows x inverse(factor) for an upper triangular factor, by forward substitution, column by column."""
    out = np.empty(rows.shape, order="F")
    for j in range(factor.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(rows: DataFrame, vec: str, mean: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows after the solves through ``factors``."""
    d = len(mean)
    upper = np.triu_indices(d)

    def sums_of(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in parts:
            q = x - mean
            for factor in factors:
                q = solved(q, factor)
            total = q.T @ q if total is None else total + q.T @ q
        return None if total is None else total[upper]

    out = np.zeros((d, d))
    out[upper] = cell_sums(rows, vec, sums_of, "double")
    return out + np.triu(out, 1).T


def cholesky(square: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular factor of the matrix plus a multiple of the identity, doubled until one exists."""
    while True:
        try:
            return np.linalg.cholesky(square + shift * np.eye(len(square))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 2, float(np.trace(square)) * np.finfo(float).eps)


@dataclass
class Whitening:
    """What is known of the fitted rows: their number, exact sums, and components by falling variance."""

    n: int
    sums: np.ndarray
    #: Variance along each component that has any, and the components as rows (unit length, either sign).
    values: np.ndarray
    components: np.ndarray
    #: Sum of the variances of all dimensions.
    total: float

    def column(self, vec: Column, first: int) -> Column:
        """Centred, projected on each of the ``first`` components and over its standard deviation, as array<double>."""
        mean = self.sums / max(self.n, 1)
        to = (self.components[:first] / np.sqrt(self.values[:first])[:, None]).T

        @F.arrow_udf("array<double>")
        def whitened(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
                out = (x - mean) @ to if len(x) else np.empty((0, to.shape[1]))
                ends = np.arange(len(x) + 1, dtype=np.int32) * to.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return whitened(vec)


def usable(rows: DataFrame, id_col: str, vec_col: str, vector: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, vec): the rows whose vector is finite and as long as most are, written once for the passes.

    ``vector`` may turn the vector into another array of numbers. Of equally frequent lengths the
    longest counts; empty vectors are left out.
    """
    kept = rows.filter(finite(F.col(vec_col)) & (F.size(vec_col) > 0)).select(
        F.col(id_col).alias("id"), (vector(F.col(vec_col)) if vector else F.transform(vec_col, lambda c: c.cast("double"))).alias("vec"),
    )
    kept = written(kept, "whitening")
    lengths = kept.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return kept.filter(F.size("vec") == lengths[0]["d"]) if lengths else kept


def fit(rows: DataFrame, vec: str = "vec") -> Whitening | None:
    """Components of all rows, whose vectors must be finite and of one length (see ``usable``); None without rows.

    The covariance has divisor n and is centred before multiplying. Sums of whole numbers are
    exact. Components without variance beyond rounding are not returned: equal rows, or a single
    one, have none.
    """
    whole = rows.schema[vec].dataType.elementType.typeName() in ("byte", "short", "integer", "long")

    def sums_of(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in parts:
            here = np.append(x.sum(axis=0, dtype=np.int64 if whole else np.float64), len(x))
            total = here if total is None else total + here
        return total

    sums = cell_sums(rows, vec, sums_of, "long" if whole else "double")
    if not len(sums):
        return None
    n, sums = int(sums[-1]), sums[:-1]
    d, mean, eps = len(sums), sums / sums.dtype.type(n), np.finfo(float).eps
    factors, total = [], 0.0
    for k in range(PASSES):
        square = gram(rows, vec, mean, factors)
        if k == 0:
            total = float(np.trace(square)) / n
            if total <= 0:
                return Whitening(n, sums, np.zeros(0), np.zeros((0, d)), 0.0)
        near = np.abs(square - np.eye(d)).max() <= NEAR
        # the first factor is shifted by what rounding of the products can amount to
        factors.append(cholesky(square, 0.0 if k else 11 * (n * d + d * (d + 1)) * eps / 2 * float(np.linalg.norm(square, 2))))
        if near:
            break
    r = factors[0]
    for factor in factors[1:]:
        r = factor @ r
    _, sizes, components = np.linalg.svd(r)
    values = sizes ** 2 / n
    real = values > values[0] * (d * eps)
    return Whitening(n, sums, values[real], components[real], total)


def identity_error(rows: DataFrame, whitened: str) -> float:
    """Largest absolute entry of the covariance of whitened rows minus the identity; one more Gram pass."""
    first = rows.select(F.size(whitened).alias("d")).limit(1).collect()
    d = first[0]["d"] if first else 0
    if not d:
        return 0.0

    def sums_of(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in parts:
            here = np.concatenate([(x.T @ x).ravel(), x.sum(axis=0), [len(x)]])
            total = here if total is None else total + here
        return total

    sums = cell_sums(rows, whitened, sums_of, "double")
    n, mean = sums[-1], sums[d * d : -1] / sums[-1]
    return float(np.abs(sums[: d * d].reshape(d, d) / n - np.outer(mean, mean) - np.eye(d)).max())


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", vector: Callable[[Column], Column] | None = None) -> tuple[DataFrame, Whitening | None]:
    """(id, ``vec``, ``whitened`` array<double>) of every usable row, and the fitted ``Whitening``.

    Rows with a NULL vector, with NULL or non-finite entries, an empty vector or another length
    than most are left out, of the fit too. NULL and repeated ids keep a row each. Fewer
    components come out where the rows have fewer with variance. Other columns are not read; an
    empty table gives no rows and no model. ``vector`` is applied to each vector first.
    """
    kept = usable(rows, id_col, vec_col, vector)
    model = fit(kept)
    out = kept.withColumn("whitened", model.column(F.col("vec"), components) if model and len(model.values) else F.array().cast("array<double>"))
    return out.withColumnRenamed("id", id_col), model
