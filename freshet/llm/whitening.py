"""Whitening of embeddings by shifted CholeskyQR.

The centred rows Y are never gathered: a pass over them sums a small Gram matrix in each task, and Spark adds the tasks'
matrices entry by entry. Its Cholesky factor R turns the rows into Q = Y R^-1, by a triangular solve in each task, and the
next pass takes the Gram matrix of Q. The first factor is of the Gram matrix plus a shift, so that it exists however ill
conditioned the rows are; the passes after it make Q orthonormal to rounding. Y = Q R, with R the product of all factors,
has the singular values and right singular vectors of R, whose squares over n are the covariance's eigenvalues: they come
to working precision without the covariance's squared condition number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE, OFFSET = 1024, 100_000
#: x below this in size stands exactly in a double; rows beyond it count as not finite.
LARGEST = 1 << 52
#: Gram passes at most; three or four are enough unless rows are linearly dependent.
PASSES = 8
UNIT = np.finfo(np.float64).eps / 2
#: Rows that are worked on at a time in a task.
BLOCK = 8192


@dataclass
class Fit:
    """n rows with per-dimension sums; factors R1, R2, ... of the passes; eigenvalues, falling, and unit vectors as columns."""

    n: int
    sums: list[int]
    factors: list[np.ndarray]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vector: str) -> Column:
    """Whether a vector is not null and all its entries are finite, and small enough for exact x."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * SCALE) >= LARGEST - OFFSET - 1))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of rows of d numbers as int64 x."""
    c = np.asarray(column.flatten(), np.float64).reshape(len(column), d)
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: int64 where that holds it, else Python integers."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (differences(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum of squares of n * x - S of each row; None where a long can't hold it."""
    far = differences(x, n, sums)
    top = int(np.abs(far).max(initial=0))
    if far.dtype == object or top * top * far.shape[1] >= 1 << 63:
        far = far.astype(object)
        return [v if v < 1 << 63 else None for v in (far * far).sum(axis=1).tolist()]
    return (far * far).sum(axis=1).tolist()


def solve_upper(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q with q r = y, r upper triangular: a column after the other."""
    q = np.empty_like(y)
    for j in range(y.shape[1]):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(rows: DataFrame, vector: str, d: int, turn: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The Gram matrix (width x width) of turn(x) over all rows: a partial sum a task, added up by Spark entry by entry."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                y = turn(matrix(batch.column(0).slice(at, BLOCK), d))
                total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(total[upper])], ["k", "v"])

    found = rows.select(vector).mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out, flat = np.zeros((width, width)), np.zeros(len(upper[0]))
    for k, v in found:
        flat[k] = v
    out[upper] = flat
    return out + np.triu(out, 1).T


def dimension_sums(rows: DataFrame, vector: str, d: int) -> tuple[int, list[int]]:
    """How many rows there are and the exact sum of x in each dimension, carried in two halves so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & (1 << 26) - 1).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["k", "n", "high", "low"])

    found = rows.select(vector).mapInArrow(run, "k int, n long, high long, low long").groupBy("k").agg(F.sum("n"), F.sum("high"), F.sum("low")).orderBy("k").collect()
    return (found[0][1] if found else 0), [(r[2] << 26) + r[3] for r in found]


def shifted(g: np.ndarray, n: int) -> np.ndarray:
    """The upper Cholesky factor of g plus the shift that makes it positive definite in spite of rounding."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * UNIT * max(np.trace(g), np.finfo(float).tiny)
    return np.linalg.cholesky(g + shift * np.eye(d)).T


def fit(rows: DataFrame, vector: str, d: int) -> Fit | None:
    """Eigenvalues and eigenvectors of the covariance of all rows' x; None if there is no row."""
    n, sums = dimension_sums(rows, vector, d)
    if not n:
        return None
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        q = centred(x, n, sums)
        for r in factors:
            q = solve_upper(q, r)
        return q

    trace = 0.0
    for turn in range(PASSES):
        g = gram(rows, vector, d, orthogonal, d)
        if not turn:
            trace = float(np.trace(g)) / n
            if trace == 0:
                return Fit(n, sums, [], np.zeros(d), np.eye(d), 0.0)
        elif np.abs(g - np.eye(d)).max() < 64 * d * UNIT:
            break
        try:
            r = shifted(g, n) if not turn else np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:  # rows that depend on each other linearly
            r = shifted(g, n)
        factors.append(r)
    whole = np.eye(d)
    for r in factors:
        whole = r @ whole
    _, singular, right = np.linalg.svd(whole)
    singular[singular <= 16 * d * UNIT * singular[0]] = 0
    vectors = right.T
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(d)]
    return Fit(n, sums, factors, singular**2 / n, vectors * np.where(top < 0, -1.0, 1.0), trace)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """Whitened coordinates of every usable row: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null, NaN, infinite entry or one whose x leaves a double's exact integers
    take no part, nor do rows that are not of the commonest length (the longer of two as common). Repeated rows, and rows
    of one key or of none, each count and each come out. Components are at most as many as dimensions. One without variance
    has whitened null and explained 0, and is left out of identity_error; deviation is null where a long can't hold it. An
    empty table gives no rows; further columns are ignored.

    The statistics are made while the DataFrame is built: rows are read once for their length, once for sums, three or four
    times for Gram matrices, once for identity_error. What reaches the driver is d * (d + 1) / 2 numbers a pass.
    """
    kind = rows.schema[key].dataType.simpleString()
    good = rows.select(F.col(key), F.col(vector)).where(usable(vector))
    sizes = good.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not sizes:
        return rows.sparkSession.createDataFrame([], schema)
    d = sizes[0]["d"]
    good = good.where(F.size(vector) == d)
    found = fit(good, vector, d)
    some = min(components, d)
    values, vectors = found.values[:some], found.vectors[:, :some]
    alive = values > 0
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, values, 1)), 0.0)
    explained = values / found.trace if found.trace else np.zeros(some)
    n, sums = found.n, found.sums

    def whitened(x: np.ndarray) -> np.ndarray:
        return centred(x, n, sums) @ vectors * scale

    covariance = gram(good, vector, d, whitened, some) / n  # x is centred exactly, so this is too
    error = float(np.abs(covariance - np.eye(some))[np.ix_(alive, alive)].max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column(1), d)
                m = len(x)
                of = pa.array(np.repeat(np.arange(m), some))
                w = whitened(x).ravel()
                columns = [part.column(0).take(of), pa.array(np.tile(np.arange(1, some + 1), m), pa.int32()), pa.array(np.full(m * some, n)), pa.array(deviations(x, n, sums), pa.int64()).take(of)]
                columns += [pa.array(w, mask=np.tile(~alive, m)), pa.array(np.tile(explained, m)), pa.array(np.full(m * some, error))]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
