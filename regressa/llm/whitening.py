"""Embedding whitening with refined eigenvectors.

Vectors become integers, so their sums and the sums of the centred products are exact: blocks of
rows are multiplied as doubles small enough to be exact, tasks add them as integers, and Spark adds
the tasks' numbers as decimals. The covariance is that sum divided once. Its eigenvectors are found
in float32 and corrected by the iteration of Ogita and Aishima (2018): each step forms the defects
of orthogonality and of diagonality by matrix products in higher precision and takes a first-order
correction, which doubles the correct digits. Where eigenvalues lie too close for that step, the
cluster is solved by itself (Ogita and Aishima, 2019): the matrix, shifted by the cluster's mean and
restricted to its span, is a small problem of its own with well-separated eigenvalues, which this
module refines in the same way.

What reaches the driver is one number a dimension and one a pair of dimensions, whatever the number
of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.llm.common import quoted

#: Scale and shift of the integers, components returned, bits of a limb, rows multiplied at once.
SCALE, SHIFT, COMPONENTS, LIMB, ROWS = 64, 1_000_000, 32, 20, 8_192
#: Precision of the refinement: 64 bits where the platform has them, else doubles.
HIGH = np.longdouble
# Beyond this the shifted integer would leave 64 bits; such entries are held at the limit.
_FAR = float((1 << 62) - SHIFT)


# ---- eigenvectors ---------------------------------------------------------------------------

def refined_eigenvectors(a: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, both in
    ``HIGH`` precision and good to double precision. Vectors of equal eigenvalues are one
    orthonormal basis of their space."""
    d = len(a)
    a = np.asarray(a, HIGH)
    scale = np.abs(a).max(initial=0)
    if d < 2 or scale == 0:
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(d, dtype=HIGH)[:, order]
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    eps, eye = float(np.finfo(np.float64).eps), np.eye(d, dtype=HIGH)
    last, solved = np.inf, False
    for _ in range(24):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        # Gaps below this size do not separate: the float64 norms bound the defects' own.
        near = 2 * (np.linalg.norm(off.astype(float), 2) + np.linalg.norm(r.astype(float), 2))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        size = float(np.abs(e).max())
        if size < eps / 4:
            break
        # Where the step no longer shrinks, what is left are clusters.
        if size >= last / 2 and not solved:
            x, last, solved = _solve_clusters(a, x, value, max(near, 16 * eps), depth), np.inf, True
        else:
            last = size
    x = _solve_clusters(a, x, value, near, depth)
    r = eye - x.T @ x
    x = x + x @ (r / 2)
    value = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    x = x / np.sqrt(np.einsum("ij,ij->j", x, x))
    order = np.argsort(-value, kind="stable")
    return value[order] * scale, x[:, order]


def _clusters(value: np.ndarray, near: float) -> list[np.ndarray]:
    """Indices of runs of two or more eigenvalues whose neighbours are within ``near``."""
    order = np.argsort(value)
    cuts = np.flatnonzero(np.diff(value[order]) > near) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _solve_clusters(a: np.ndarray, x: np.ndarray, value: np.ndarray, near: float,
                    depth: int) -> np.ndarray:
    """``x`` with the vectors of each cluster turned within their span by a sub-solve."""
    x = x.copy()
    for g in _clusters(value, near) if depth < 4 else ():
        part = np.linalg.qr(x[:, g].astype(float))[0].astype(HIGH)
        part = part + part @ ((np.eye(len(g), dtype=HIGH) - part.T @ part) / 2)
        shift = value[g].mean()
        # Shifting first keeps the digits in which the cluster's eigenvalues differ.
        small = part.T @ (a @ part - shift * part)
        x[:, g] = part @ refined_eigenvectors((small + small.T) / 2, depth + 1)[1]
    return x


# ---- exact sums -----------------------------------------------------------------------------

def _integers(batch: pa.RecordBatch, d: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer vectors of the rows that count."""
    vectors = batch.column("v")
    full = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(vectors), d), False)
    ids, vectors = batch.column("vec_id").filter(full), vectors.filter(full)
    c = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    good = np.isfinite(c).all(axis=1)  # a null entry reads as NaN
    with np.errstate(over="ignore"):
        x = np.floor(np.clip(SCALE * c[good], -_FAR, _FAR)).astype(np.int64) + SHIFT
    return ids.filter(pa.array(good)), x


def exact_products(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` as Python integers. Entries are split into limbs of 20 bits, so that the product
    of any two limbs over ``ROWS`` rows is exact in doubles."""
    d = x.shape[1]
    out = np.zeros((d, d), object)
    for start in range(0, len(x), ROWS):
        rest, limbs = x[start:start + ROWS], []
        while True:
            if np.abs(rest).max(initial=0) < 1 << LIMB:
                limbs.append(rest.astype(float))
                break
            limbs.append((rest & ((1 << LIMB) - 1)).astype(float))
            rest = rest >> LIMB
        for i, left in enumerate(limbs):
            for j, right in enumerate(limbs):
                out += (left.T @ right).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def _totals(parts: DataFrame) -> dict[int, int]:
    """Sums of the tasks' numbers, added on the executors; ``high`` counts units of 2 ** 60."""
    cols = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    return {r["k"]: (int(r["high"]) << 60) + int(r["low"])
            for r in parts.groupBy("k").agg(*cols).collect()}


def _summed(thin: DataFrame, d: int, numbers: Callable[[np.ndarray], list[int]]) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            x = _integers(batch, d)[1]
            if len(x):
                new = numbers(x)
                total = [a + b for a, b in zip(total, new, strict=True)] if total else new
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()),
             pa.array([str(t >> 60) for t in total], pa.string()),
             pa.array([str(t & ((1 << 60) - 1)) for t in total], pa.string())],
            names=["k", "high", "low"])

    return _totals(thin.mapInArrow(run, "k int, high string, low string"))


def _doubles(thin: DataFrame, d: int, numbers: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x = _integers(batch, d)[1]
            if len(x):
                total = total + numbers(x)
        flat = np.ravel(total) if np.ndim(total) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)],
                                         names=["k", "v"])

    rows = thin.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["k"])])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each
    remaining vector and component, by falling eigenvalue from 1.

    Vectors that are null or hold null or non-finite entries are dropped. Vectors of another length
    than most have no common space: of the lengths present the one of most rows counts (ties: the
    longer) and the others are dropped as well. Components without variance do not exist: there are
    at most as many as the covariance has rank, so equal vectors, a single one and an empty table
    give no rows. Repeated rows count as often as they occur, null ids are kept; further columns are
    ignored. A deviation that does not fit into 64 bits is null.
    """
    spark = vectors.sparkSession
    schema = ("vec_id {}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double").format(vectors.schema[id_col].dataType.simpleString())
    thin = vectors.select(F.col(quoted(id_col)).alias("vec_id"), F.col(quoted(vector_col)).alias("v"))
    valid = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (
        F.abs(c) == float("inf")))
    lengths = thin.where(valid).groupBy(F.size("v").alias("d")).count().where("d > 0")
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    d = most["d"]
    got = _summed(thin, d, lambda x: [len(x), *(int(s) for s in x.astype(object).sum(axis=0))]
                  if np.abs(x).max() > 1 << 40 else [len(x), *x.sum(axis=0).tolist()])
    n, sums = got[0], [got[i + 1] for i in range(d)]
    # Centred at the integer next to the mean, exactly; the rest is below one half.
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    upper = np.triu_indices(d)
    got = _summed(thin, d, lambda x: exact_products(x - centre)[upper].tolist())
    cov = np.zeros((d, d), HIGH)
    for k, (i, j) in enumerate(zip(*upper, strict=True)):
        cov[i, j] = cov[j, i] = _ratio(n * got[k] - rest[i] * rest[j], n * n)
    value, vector = refined_eigenvectors(cov)
    trace = np.trace(cov)
    rank = int((value > trace * d * np.finfo(np.float64).eps).sum())
    top = min(components, rank)
    if top == 0:
        return spark.createDataFrame([], schema)
    explained = (value[:top] / trace).astype(float)
    onto = (vector[:, :top] / np.sqrt(value[:top])).astype(float)
    shift = np.array([float(_ratio(r, n)) for r in rest])

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - shift) @ onto

    mean = _doubles(thin, d, lambda x: project(x).sum(axis=0)) / n
    square = _doubles(thin, d, lambda x: (lambda w: w.T @ w)(project(x) - mean)) / n
    error = float(np.abs(square.reshape(top, top) - np.eye(top)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                ids, x = _integers(whole.slice(start, ROWS), d)
                if not len(x):
                    continue
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(m), top))),
                    pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * top, n)),
                    pa.array([v for v in deviations(x - centre, n, rest) for _ in range(top)],
                             pa.int64()),
                    pa.array(project(x).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * top, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                           "identity_error"])

    return thin.mapInArrow(run, schema)


def deviations(x: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - rest) ** 2 of centred rows, exact; None beyond 64 bits."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, rest))
    if largest * largest * x.shape[1] < 1 << 63:
        z = n * x - np.array(rest, np.int64)
        return (z * z).sum(axis=1).tolist()
    sums = [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in x.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def _ratio(a: int, b: int) -> np.longdouble:
    """``a / b`` of integers of any size in ``HIGH`` precision."""
    whole, part = divmod(abs(a), b)
    high = HIGH(whole >> 32) * HIGH(1 << 32) + HIGH(whole & 0xFFFFFFFF)
    high += HIGH((part << 32) // b) / HIGH(1 << 32) + HIGH(
        (((part << 32) % b) << 32) // b) / HIGH(1 << 32) / HIGH(1 << 32)
    return -high if a < 0 else high
