"""Whitening of embeddings: principal components of the whole table, scaled to unit variance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes the integer floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: Greatest absolute value of SCALE * c: up to here the integers are exact as doubles.
MOST = float(1 << 52)
#: Refinements at most; they converge quadratically, so from 32 bits three or four do.
ROUNDS = 12


class Whitening(NamedTuple):
    """n vectors of the fit list, the sums of their integers by dimension, eigenvalues of the covariance in falling order,
    the matrix that projects a centred vector to whitened components (undefined ones are NaN), and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    project: np.ndarray
    trace: float


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One Ogita-Aishima step: (better eigenvectors of a, the largest entry of the correction that was made).

    Off the diagonal, pairs of eigenvalues further apart than the bound on their error get the first-order correction;
    nearer ones are only made orthogonal, and each run of them is then solved by itself: the matrix, shifted by their
    mean and projected on their vectors, is small where they are close, so its own eigenvectors tell them apart.
    """
    lost = np.eye(len(a), dtype=a.dtype) - x.T @ x
    inner = x.T @ (a @ x)
    inner = (inner + inner.T) / 2  # else rounding, divided by small gaps, would cost orthogonality
    values = np.diag(inner) / (1 - np.diag(lost))
    norm = lambda m: float(np.sqrt((m * m).sum()))
    bound = 2 * (norm(inner - np.diag(values)) + norm(a) * norm(lost))
    gaps = values[None, :] - values[:, None]
    far = np.abs(gaps) > bound
    step = np.where(far, (inner + values[None, :] * lost) / np.where(far, gaps, 1), lost / 2)
    x = x + x @ step
    order = np.argsort(-values)
    runs = np.split(order, np.flatnonzero(-np.diff(values[order]) > bound) + 1)
    for run in (r for r in runs if len(r) > 1):
        own = x[:, run]
        part = own.T @ (a @ own) - values[run].mean() * (own.T @ own)
        size = np.abs(part).max()
        if size > 0:
            x[:, run] = own @ np.linalg.eigh(((part + part.T) / (2 * size)).astype(np.float64))[1].astype(a.dtype)
    return x, float(np.abs(step).max())


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues in falling order, unit eigenvectors as columns) of a symmetric matrix.

    A solver in 32 bits gives first vectors; matrix products in numpy's longdouble correct them until the corrections
    no longer shrink. Equal eigenvalues get some orthonormal basis of their space.
    """
    size = np.abs(a).max(initial=0.0)
    if not size > 0:
        return np.zeros(len(a)), np.eye(len(a))
    high = a.astype(np.longdouble) / size
    x, before = np.linalg.eigh(high.astype(np.float32))[1].astype(np.longdouble), np.inf
    for _ in range(ROUNDS):
        x, change = corrected(high, x)
        if change < 1e-18 or change < 1e-9 and change > before / 2:
            break
        before = change
    x = x / np.sqrt((x * x).sum(0))
    values = (x * (high @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def usable(table: DataFrame, vector_col: str, id_col: str | None = None) -> DataFrame:
    """Columns id (if asked for) and v: the rows whose vector is neither null nor holds null or non-finite entries."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return table.where(v.isNotNull() & ~bad).select(*([F.col(id_col).alias("id")] if id_col else []), v.alias("v"))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """The integers of equally long vectors, one row each, as int64."""
    scaled = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
    if scaled.size and np.abs(scaled).max() > MOST:
        raise OverflowError(f"entries beyond {MOST / SCALE:.3g} have no exact integer")
    return scaled.astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n as doubles, through the whole part of the mean, so that nothing large is subtracted from something large."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    return (x - np.array(whole, np.int64)) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over the dimensions of (n * x - S)^2, exact; an error where it exceeds 64 bits."""
    whole = [s // n for s in sums]
    y, rest = x - np.array(whole, np.int64), [s - w * n for s, w in zip(sums, whole, strict=True)]
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    if len(sums) * most * most < 1 << 63:
        apart = n * y - np.array(rest, np.int64)
        return (apart * apart).sum(1)
    exact = [sum((n * int(e) - r) ** 2 for e, r in zip(row, rest, strict=True)) for row in y]
    if max(exact) >= 1 << 63:
        raise OverflowError("a deviation exceeds 64 bits")
    return np.array(exact, np.int64)


def summed(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the matrix that `of` makes of a block of integers. A task sends one matrix, the cells of
    all are added up by a shuffle, and the driver gets one matrix, whose size only the dimensions decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            block = of(integers(batch.column(0), width))
            total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "entries"])

    parts = rows.select("v").mapInArrow(run, "i int, entries array<double>")
    cells = parts.select("i", F.posexplode("entries").alias("j", "entry")).groupBy("i", "j").agg(F.sum("entry").alias("entry"))
    lines = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "entry"))).alias("cells"))
    return np.array([line for _, line in sorted((r.i, r.line) for r in lines.select("i", F.col("cells.entry").alias("line")).collect())])


def fit(table: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors of the most frequent length (of equally frequent ones the greatest), or None
    where there are none. The covariance has divisor n and is summed from centred integers in doubles.

    Components whose eigenvalue isn't above the rounding of the greatest have no variance to divide by: NaN.
    """
    good = usable(table, vector_col)
    lengths = good.where(F.size("v") > 0).groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    if first is None:
        return None
    width, n = first.width, first.n
    good = good.where(F.size("v") == width)
    entry = F.floor(F.col("c") * SCALE).cast("long") + OFFSET
    by = good.select(F.posexplode("v").alias("at", "c")).groupBy("at").agg(F.sum(entry).alias("total")).collect()
    sums = [total for _, total in sorted((r["at"], r.total) for r in by)]

    def products(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums)
        return z.T @ z

    covariance = summed(good, width, products) / n
    values, vectors = eigen((covariance + covariance.T) / 2)
    varies = values > max(0.0, values[0]) * width * np.finfo(np.float64).eps
    project = np.where(varies, vectors / np.sqrt(np.where(varies, values, 1)), np.nan)
    return Whitening(n, sums, values, project, float(np.trace(covariance)))


def identity_error(table: DataFrame, model: Whitening, components: int = COMPONENTS, vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened components' covariance over the fit list, less the identity; of components
    without variance there is none."""
    width = len(model.sums)
    project = model.project[:, :components]
    project = project[:, ~np.isnan(project[0])]
    if not project.shape[1]:
        return None

    def products(x: np.ndarray) -> np.ndarray:
        w = centred(x, model.n, model.sums) @ project
        return np.vstack([w.T @ w, w.sum(0)])

    total = summed(usable(table, vector_col).where(F.size("v") == width), width, products) / model.n
    covariance = total[:-1] - np.outer(total[-1], total[-1])
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component (from 1, by falling eigenvalue): id, component, n, deviation (the sum of
    (n * x - S)^2), whitened, explained (eigenvalue by trace), identity_error (one value).

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, as are vectors of another than the
    most frequent length. Equal vectors have equal results, and repeated rows are fitted and returned as often as they
    stand there. Where a component has no variance (too few or equal vectors), whitened is null, and so is explained where
    nothing varies. Fewer dimensions than `components` give that many. Ids are of any type and may be null. Entries beyond
    2^52 / 64, or a deviation beyond 64 bits, are an error. An empty table gives an empty result; other columns are ignored.
    """
    id_type = table.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(table, vector_col)
    if model is None:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error = identity_error(table, model, components, vector_col)
    n, sums, width = model.n, model.sums, len(model.sums)
    project = model.project[:, :components]
    k = project.shape[1]
    explained = model.values[:k] / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), width)
            rows = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                pa.array(np.repeat(deviations(x, n, sums), k)), pa.array((centred(x, n, sums) @ project).ravel(), from_pandas=True), pa.array(np.tile(explained, rows), from_pandas=True),
                pa.array([error] * (rows * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = usable(table, vector_col, id_col).where(F.size("v") == width)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
