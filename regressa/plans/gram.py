"""The linear family (M1-M4) from sums of products: one pass for all models, folds and penalties.

A pass over the training rows yields, for every fold, the number of rows, the means and the centred
products of features and label. Leaving a fold out is a subtraction, so each of the k training sets of
a cross-validation, for every model and every penalty of a grid, is solved on the driver from these
small matrices; so are the scores of the held-out folds, as squared errors are sums of products, too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regressa.functions.columns import col

FAMILY = ("linear", "ridge", "lasso", "elastic_net")
#: Features up to which a task's products stay small (a matrix a fold); wider frames are fitted by
#: Spark's own solvers, a pass a fit.
MAX_FEATURES = 256
#: Metrics that the sums of products give.
METRICS = ("r2", "explained_variance", "rmse", "neg_mean_squared_error",
           "neg_root_mean_squared_error")
#: Sweeps of the coordinate descent, and the change (of the largest coefficient) that ends it.
SWEEPS, CHANGE = 20_000, 1e-13


@dataclass
class Moments:
    """Rows, means and centred products of (features..., label)."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def without(self, part: Moments) -> Moments:
        n = self.n - part.n
        if n <= 0:
            return Moments(0.0, np.zeros_like(self.mean), np.zeros_like(self.cross))
        mean = (self.n * self.mean - part.n * part.mean) / n
        gap = mean - part.mean
        return Moments(n, mean, self.cross - part.cross - n * part.n / self.n * np.outer(gap, gap))

    def plus(self, part: Moments) -> Moments:
        n = self.n + part.n
        if n == 0:
            return self
        gap = self.mean - part.mean
        return Moments(n, (self.n * self.mean + part.n * part.mean) / n,
                       self.cross + part.cross + self.n * part.n / n * np.outer(gap, gap))


def _values(features) -> list[Column]:
    """Plain feature columns as doubles; a missing value is NaN, as in an assembled vector."""
    return [F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in features]


def fold_moments(train: DataFrame, features: str | Sequence[str], label: str, width: int,
                 fold: str | None = "fold") -> dict[int, Moments]:
    """Moments of each fold's rows (of all rows, as fold 0, without a fold column); ``features`` is
    an assembled vector or a list of columns. Rows without a
    label are left out. Sums are taken around the overall means, so that large offsets cost no
    digits; the driver gets a matrix a fold."""
    x = vector_to_array(F.col(features)) if isinstance(features, str) else F.array(*_values(features))
    rows = train.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                        x.alias("x"), F.col(label).cast("double").alias("y")) \
        .where("y IS NOT NULL AND fold IS NOT NULL")
    means = rows.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)], F.avg("y")).alias("m")).first()["m"]
    if means[-1] is None:
        return {}
    centre = np.array(means, float)
    size = width + 1
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            z = np.column_stack([x, batch.column("y").to_numpy()]) - centre
            of = batch.column("fold").to_numpy()
            for f in np.unique(of).tolist():
                part = z[of == f]
                new = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part)[upper]])
                total[f] = total[f] + new if f in total else new
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(keys, np.int32), 1 + size + len(upper[0]))),
             pa.array(np.tile(np.arange(1 + size + len(upper[0]), dtype=np.int32), len(keys))),
             pa.array(np.concatenate([total[f] for f in keys]) if keys else np.zeros(0))],
            names=["fold", "k", "v"])

    found = rows.mapInArrow(sums, "fold int, k int, v double").groupBy("fold", "k").agg(F.sum("v").alias("v"))
    flat: dict[int, np.ndarray] = {}
    for r in found.collect():
        flat.setdefault(r["fold"], np.zeros(1 + size + len(upper[0])))[r["k"]] = r["v"]
    out = {}
    for f, v in sorted(flat.items()):
        cross = np.zeros((size, size))
        cross[upper] = v[1 + size:]
        cross = cross + np.triu(cross, 1).T
        s = v[1:1 + size]
        out[f] = Moments(v[0], centre + s / v[0], cross - np.outer(s, s) / v[0])
    return out


def solve(m: Moments, name: str, hp: dict) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of one model; parameters as the reference gives them."""
    a, c = m.cross[:-1, :-1] / m.n, m.cross[:-1, -1] / m.n
    alpha = float(hp.get("alpha", 1.0))
    if name == "linear":
        w = np.linalg.lstsq(a, c, rcond=None)[0]
    elif name == "ridge":
        w = np.linalg.lstsq(a + alpha / m.n * np.eye(len(a)), c, rcond=None)[0]
    else:
        share = 1.0 if name == "lasso" else float(hp.get("l1_ratio", 0.5))
        w = _descent(a, c, alpha * share, alpha * (1.0 - share))
    return w, float(m.mean[-1] - m.mean[:-1] @ w)


def _descent(a: np.ndarray, c: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Minimises w'aw / 2 - c'w + l1 |w| + l2 |w|^2 / 2, one coordinate after the other."""
    w, rest = np.zeros(len(c)), c.copy()
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(c)):
            curve = a[j, j] + l2
            if curve <= 0:
                continue
            pull = rest[j] + a[j, j] * w[j]
            new = math.copysign(max(abs(pull) - l1, 0.0), pull) / curve
            if new != w[j]:
                rest -= a[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved <= CHANGE * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def score(m: Moments, w: np.ndarray, intercept: float, metric: str) -> float:
    """A metric of the model on the rows behind ``m``."""
    spread = float(m.cross[-1, -1])
    scatter = spread - 2 * float(w @ m.cross[:-1, -1]) + float(w @ m.cross[:-1, :-1] @ w)
    off = float(m.mean[-1] - intercept - m.mean[:-1] @ w)
    rss = max(scatter, 0.0) + m.n * off * off
    if metric in ("r2", "explained_variance"):
        part = rss if metric == "r2" else max(scatter, 0.0)
        if spread > 0:
            return 1.0 - part / spread
        return 1.0 if part <= 1e-20 * m.n * max(1.0, m.mean[-1] ** 2) else 0.0
    mse = rss / m.n
    return {"rmse": math.sqrt(mse), "neg_mean_squared_error": -mse,
            "neg_root_mean_squared_error": -math.sqrt(mse)}[metric]


def total(folds: dict[int, Moments]) -> Moments:
    parts = list(folds.values())
    out = parts[0]
    for p in parts[1:]:
        out = out.plus(p)
    return out


def cross_val_scores(folds: dict[int, Moments], name: str, hp: dict, metric: str) -> list[float]:
    """A1 from the moments: the score of each held-out fold, in order."""
    whole = total(folds)
    return [score(m, *solve(whole.without(m), name, hp), metric) for _, m in sorted(folds.items())]


@dataclass
class LinearModel:
    """A fitted linear model; ``transform`` adds the prediction from assembled features or columns."""

    coefficients: DenseVector
    intercept: float

    def transform(self, df: DataFrame, features: str | Sequence[str] = "features",
                  name: str = "prediction") -> DataFrame:
        if not isinstance(features, str):  # plain columns
            dot = F.lit(0.0)
            for v, c in zip(_values(features), self.coefficients, strict=True):
                dot = dot + v * F.lit(float(c))
            return df.withColumn(name, dot + F.lit(self.intercept))
        products = F.zip_with(vector_to_array(F.col(features)), F.array(
            *[F.lit(float(c)) for c in self.coefficients]), lambda x, c: x * c)
        dot = F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
        return df.withColumn(name, dot + F.lit(self.intercept))


def fit(m: Moments, name: str, hp: dict) -> LinearModel:
    w, intercept = solve(m, name, hp)
    return LinearModel(DenseVector(w), intercept)
