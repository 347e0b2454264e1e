"""Whitening of embeddings by shifted Cholesky QR.

The distinct integer vectors, centred, are a tall matrix A that is never formed. Each Gram pass
reads the rows, solves them against the triangular factors found so far, and sums the products of
columns; the Cholesky factor of the sum (shifted, so that it exists whatever the condition of A)
is the next factor. When the rows are close to orthonormal, the root of the last Gram matrix closes
the product, A = Q R with orthonormal Q, and the singular value decomposition of the small R gives
components and variances without squaring the condition number.

A pass sends a triangle of dimensions squared from each task, added up by cell; the driver holds
factors of dimensions squared, whatever the number of rows.

Null, ragged, tied and repeated rows: vectors that are null, empty, or hold null, non-finite
or too large entries (256-fold beyond 2**53) are left out. The dimension is that of most of the
remaining rows (the smallest of equally frequent ones); rows of another dimension are left out too.
Repeated vectors count once in the fit and each row gets its result. Equal variances are numbered
in the order of the decomposition. A component without variance (its eigenvalue below 1e-12 of the
trace) whitens to null and isn't part of ``identity_error``; a fit of one vector has only such.
``deviation`` is null where a long can't hold it. An empty table gives no rows. Other columns of
any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import written

SCALE = 256
LARGEST = float(2**53)
#: Eigenvalues below this part of the trace count as none.
NO_VARIANCE = 1e-12
#: Gram passes at most; each shifted one multiplies a small singular value by 1e4 or more.
PASSES = 8


@dataclass(frozen=True)
class Whitening:
    """What the fit leaves: sizes of dimensions squared at most."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray  # dimensions x components
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float
    gram_passes: int


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x, the vector as whole 256ths, of the rows that take part."""
    scaled = F.transform(F.col("v"), lambda c: c.cast("double") * SCALE)

    def unusable(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)

    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v IS NOT NULL AND size(v) > 0")
    usable = rows.select("id", scaled.alias("s")).where(~F.exists("s", unusable))
    x = usable.select("id", F.transform("s", lambda c: F.floor(c)).alias("x"))
    dims = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return x.where(F.size("x") == (dims["d"] if dims else 0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def dimension_sums(fit: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sums of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), len(batch.column("x")[0]))
                low, high = int(x.min()), int(x.max())
                safe = max(-low, high) * len(x) < 2**62
                part = [int(v) for v in (x.sum(axis=0) if safe else x.astype(object).sum(axis=0))]
                rows, sums = rows + len(x), part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array([rows] * len(sums), pa.int64()), pa.array([str(s) for s in sums])], ["dim", "rows", "total"]
            )

    parts = fit.select("x").mapInArrow(partial, "dim int, rows bigint, total string")
    found = parts.groupBy("dim").agg(F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return (found[0]["rows"] if found else 0), tuple(int(r["total"]) for r in found)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``factor``, by forward substitution."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def cell_sums(fit: DataFrame, size: int, work) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all rows of y and of the products of each two entries of y = ``work(x)``; partial sums per task, added up by cell."""
    upper = np.triu_indices(size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, totals = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                x = batch.column("x").slice(start, 8192)
                y = work(matrix(x, len(x[0])))
                products += y.T @ y
                totals += y.sum(axis=0)
        values = np.concatenate([totals, products[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "value"])

    parts = fit.select("x").mapInArrow(partial, "cell bigint, value double")
    cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    values = np.zeros(size + len(upper[0]))
    values[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    products = np.zeros((size, size))
    products[upper] = values[size:]
    return values[:size], products + np.triu(products, 1).T


def upper_factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Cholesky factor R of R'R = gram + shift; the shift covers the rounding of the sums, taken over at most 2**20 rows one after the other."""
    d = len(gram)
    shift = 11 * (min(n, 2**20) * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
    if not shifted:
        return np.linalg.cholesky(gram).T
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 100


def triangular(fit: DataFrame, n: int, mean: np.ndarray) -> tuple[np.ndarray, float, int]:
    """R with R'R = A'A of the centred rows A, the trace of A'A, and the Gram passes it took."""
    d = len(mean)
    factors: list[np.ndarray] = []
    trace = 0.0
    for step in range(PASSES):
        held = list(factors)

        def work(x, held=held):
            y = x - mean
            for factor in held:
                y = solved(y, factor)
            return y

        _, gram = cell_sums(fit, d, work)
        if step == 0:
            trace = float(np.trace(gram))
            if trace == 0:
                return np.zeros((d, d)), 0.0, 1
        values, vectors = np.linalg.eigh(gram)
        live = values > 1e-10
        close = step > 0 and np.abs(values[live] - 1).max(initial=0) < 0.5
        if close and step >= (2 if live.all() else 3) or step == PASSES - 1:
            root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
            for factor in reversed(factors):
                root = root @ factor
            return root, trace, step + 1
        factors.append(upper_factor(gram, n, shifted=step == 0 or values[0] < 1e-3))
    raise AssertionError("not reached")


def fit_whitening(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Fit over the distinct x of ``vectors`` (``quantised``); None without rows."""
    fit = written(vectors.select("x").distinct(), "whitening-distinct")
    n, sums = dimension_sums(fit)
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    r, trace, passes = triangular(fit, n, mean)
    _, singular, rows = np.linalg.svd(r)
    count = min(components, len(sums))
    axes, variances = rows[:count].T, singular[:count] ** 2 / n
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(count)] < 0, -1.0, 1.0)
    explained = variances / (trace / n) if trace else np.zeros(count)
    live = explained > NO_VARIANCE
    variances = np.where(live, variances, 0.0)
    error = 0.0
    if live.any():
        projector = axes[:, live] / np.sqrt(variances[live])
        totals, products = cell_sums(fit, int(live.sum()), lambda x: (x - mean) @ projector)
        centre = totals / n
        error = float(np.abs(products / n - np.outer(centre, centre) - np.eye(int(live.sum()))).max())
    return Whitening(n, sums, axes, variances, explained, error, passes)


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation and the whitened components (null without variance) of every row of ``vectors``."""
    n, sums = model.n, model.sums
    mean = np.array([s / n for s in sums])
    live = model.variances > 0
    divisor = np.sqrt(np.where(live, model.variances, 1.0))
    largest = max(abs(s) for s in sums)

    def deviations(x: np.ndarray) -> list[int | None]:
        bound = n * max(-int(x.min()), int(x.max())) + largest
        if bound * bound * len(sums) < 2**63:
            return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                x = matrix(part.column("x"), len(sums))
                projected = (x - mean) @ model.axes / divisor
                mask = np.broadcast_to(~live, projected.shape)
                flat = pa.array(projected.ravel(), mask=mask.ravel())
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(live), flat)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(deviations(x), pa.int64()), lists], ["id", "deviation", "whitened"])

    return vectors.mapInArrow(work, f"id {vectors.schema['id'].dataType.simpleString()}, deviation bigint, whitened array<double>")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row per usable row of ``df`` and component: id, component, n, deviation, whitened, explained, identity_error."""
    vectors = quantised(df, id_col, vector_col)
    model = fit_whitening(vectors, components)
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    rows = whitened(vectors, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
