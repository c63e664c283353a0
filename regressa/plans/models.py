"""Estimators (M1-M8) and the fitted preprocessing pipeline.

Linear models, forests and boosting are Spark ML estimators on an assembled
feature vector. The support-vector regressor has no MLlib counterpart; it is
built from random Fourier features (Rahimi and Recht, 2007) and an
epsilon-insensitive linear fit whose gradient is summed over partitions each
iteration (the same driver-loop shape as MLlib's own iterative solvers).

Parameter mapping to the reference's estimators (alpha = 1):
  ridge        regParam = alpha * sd_pop(y) / n, elasticNetParam = 0, normal solver
  lasso        regParam = alpha, elasticNetParam = 1
  elastic_net  L1 = alpha * l1_ratio, L2 = alpha * (1 - l1_ratio) * sd_pop(y);
               regParam = L1 + L2, elasticNetParam = L1 / (L1 + L2)
  (all four with the normal-equation solver: one pass over the data.)
  (standardization off: features are already scaled by the fitted scaler.)
Deliberate deviations: tuning covers the whole pipeline (scaler included);
boosted trees are MLlib's binned trees (statistical, not bitwise, parity), fitted
on rows that are counted by their bins (``plans/boosting.py``). The forest grows without a depth limit in ``plans/forest.py``; only over sparse
one-hot vectors is it MLlib's, with at most 30 levels.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from regressa import messages as M
from regressa.config import RegressionParams
from pyspark.sql.types import BooleanType

from regressa.functions.columns import (categorical_columns, col, normalise_nan, numeric_columns,
                                        role_of)
from regressa.operators import clean, encode
from regressa.plans import boosting, forest

# Levels of MLlib's trees, used for a forest over sparse one-hot vectors.
MLLIB_MAX_DEPTH = 30
# Levels of partial trees between two checkpoints of the rows' nodes (MLlib).
NODE_CHECKPOINTS = 10
# Split candidates of a feature (MLlib's ``maxBins``; ``max_bins`` overrides it).
DEFAULT_MAX_BINS = 32
# Columns up to which the linear family is solved from the normal equations in
# one pass (MLlib's limit); wider inputs are solved iteratively.
NORMAL_SOLVER_MAX_FEATURES = 4096
FEATURES = "features"
LABEL = "y"
PREDICTION = "prediction"
# Names that the prepared frame uses itself; a feature of such a name gets a suffix.
RESERVED = {FEATURES, LABEL, PREDICTION, "fold", "is_test", "row_key"}


def internal_name(c: str) -> str:
    return c + "__feature" if c in RESERVED else c


def feature_frame(df: DataFrame, feats, others=()) -> DataFrame:
    """Features under their internal names: booleans as 0/1, NaN as null. A
    type without a meaning as a feature (dates, arrays, ...) is an error."""
    odd = [c for c in feats if role_of(df.schema[c].dataType) == "other"
           and not isinstance(df.schema[c].dataType, BooleanType)]
    if odd:
        raise ValueError(f"columns {odd} are neither numbers, strings nor booleans: convert them "
                         "or leave them out of the features")
    out = df.select(*[(col(c).cast("int") if isinstance(df.schema[c].dataType, BooleanType)
                       else col(c)).alias(internal_name(c)) for c in feats], *others)
    return normalise_nan(out)


# --------------------------------------------------------------------------
# Preprocessing fitted on the training rows
# --------------------------------------------------------------------------

@dataclass
class Preprocessor:
    target: str | None
    input_features: list
    fill: clean.FillModel | None
    drop_nulls: bool
    encoder: object | None
    scaler: encode.ScalerModel | None
    feature_names: list
    steps: list = field(default_factory=list)
    target_mean: float | None = None
    target_std: float | None = None
    vector_scales: dict = field(default_factory=dict)

    def vector_columns(self) -> list[str]:
        wide = isinstance(self.encoder, encode.MixedOneHotModel)
        return self.encoder.vector_columns() if wide else []

    def position_names(self) -> list[str]:
        """A name for each position of the assembled features."""
        vectors = self.vector_columns()
        return [n for c in self.feature_names
                for n in (self.encoder.names_of(c) if c in vectors else [c])]

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        """Features (numeric, in ``feature_names`` order), ``y`` when the target
        is present, plus ``keep`` columns (keys) passed through."""
        keep = [c for c in keep if c in df.columns]
        cols = [c for c in self.input_features if c in df.columns]
        has_y = self.target is not None and self.target in df.columns
        base = feature_frame(df, cols, [*[col(c) for c in keep], *(
            [col(self.target).cast("double").alias(LABEL)] if has_y else [])])
        if self.drop_nulls:
            base = base.na.drop(subset=[internal_name(c) for c in cols])
        if self.fill is not None:
            base = self.fill.transform(base, spare=True)
        if self.encoder is not None:
            base = self.encoder.transform(base)
        # Columns the batch lacks (unseen dummies) become 0.
        vectors = self.vector_columns()
        out = base.select(*[col(c) for c in keep], *[
            self._sized(c) if c in vectors else col(c).cast("double").alias(c)
            if c in base.columns else F.lit(0.0).alias(c) for c in self.feature_names],
                          *([F.col(LABEL)] if has_y else []))
        if self.scaler is not None:
            out = encode.scale_vectors(self.scaler.transform(out), self.vector_scales)
            out = out.select(*[self._sized(c) if c in vectors else col(c) for c in out.columns])
        return out

    def _sized(self, c: str):
        # The size of a vector column, which the assembler asks for.
        size = self.encoder.wide.widths[c.removesuffix("_onehot")] - 1
        return col(c).alias(c, metadata={"ml_attr": {"num_attrs": size}})


def fit_preprocessor(train: DataFrame, target: str, params: RegressionParams,
                     features=None, scale: bool | None = None) -> Preprocessor:
    """Fill (median / mode, or drop), encode categoricals, then scale: every
    statistic is fitted on ``train`` only. Rows with a null target are left
    out of fitting."""
    feats = list(features) if features else [c for c in train.columns if c != target]
    given = feats
    label = "__target"
    data = feature_frame(train, feats, [col(target).cast("double").alias(label)]) \
        .where(F.col(label).isNotNull())
    feats, target_name, target = [internal_name(c) for c in feats], target, label
    steps = []
    fill, drop = None, False
    if params.handle_missing == "drop":
        drop = True
        data = data.na.drop(subset=feats)
        steps.append(M.STEP_DROPPED)
    else:
        fill = clean.fit_impute(data, target, spare=True)
        data = fill.transform(data)
        steps += fill.steps
    inputs = data.drop(target)
    cats = categorical_columns(inputs)
    encoder = None
    if cats:
        if params.encode_categorical in ("onehot", "one_hot_encoding"):
            encoder = encode.fit_one_hot_any(data, cats)
            steps.append(M.STEP_ONE_HOT.format(k=len(cats)))
        elif params.encode_categorical in ("label", "label_encoding"):
            encoder = encode.fit_label(data, cats)
            steps += [M.STEP_LABEL.format(column=c) for c in cats]
        else:
            encoder = encode.fit_target(data, cats, target, params.target_smoothing)
            steps += [f"Target encoded '{c}'" for c in cats]
    numeric = numeric_columns(inputs)
    if isinstance(encoder, (encode.OneHotModel, encode.MixedOneHotModel)):
        names = [c for c in feats if c not in cats] + encoder.output_columns()
        names = [c for c in names if c in numeric or c in encoder.output_columns()]
    else:
        names = [c for c in feats if c in numeric or c in cats]
    pre = Preprocessor(target_name, given, fill, drop, encoder, None, names, steps)
    stats = data.agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    pre.target_mean, pre.target_std = stats["m"], stats["s"]
    if scale if scale is not None else params.scale_features:
        ready, vectors = pre.transform(train), pre.vector_columns()
        pre.scaler = encode.fit_scaler(ready, [c for c in names if c not in vectors])
        pre.vector_scales = encode.fit_vector_scales(ready, vectors) if vectors else {}
    return pre


def assemble(df: DataFrame, feature_names) -> DataFrame:
    # Positional copies: a category value in a name may hold any character.
    copies = {f"__f{i}": col(c) for i, c in enumerate(feature_names)}
    return VectorAssembler(inputCols=list(copies), outputCol=FEATURES, handleInvalid="keep") \
        .transform(df.withColumns(copies)).drop(*copies)


# --------------------------------------------------------------------------
# M7: support vector regression through random Fourier features
# --------------------------------------------------------------------------

#: Rows mapped at once, rows of a kept block, and blocks that a task reads in a step.
MAPPED_ROWS, BLOCK_ROWS, TASK_BLOCKS = 256, 8_192, 1_024
# Pi in two parts (whole multiples of the first are exact), and cos(x) in powers of x^2 up to pi/4.
_PI = float.fromhex("0x1.921fb544p+1")
_PI_REST = math.pi - _PI + 1.2246467991473532e-16
_COS = [(-1.0) ** i / math.factorial(2 * i) for i in range(9)]
# cos(pi v) in powers of v^2 for v from -1/2 to 1/2: the polynomial through its values at nine Chebyshev nodes.
_COS_PI = [float.fromhex(c) for c in (
    "0x1.0p+0", "-0x1.3bd3cc9be45dbp+2", "0x1.03c1f081b5992p+2", "-0x1.55d3c7e3bfbdfp+0", "0x1.e1f5068139776p-3",
    "-0x1.a6d1efc8822ccp-6", "0x1.f9d2543f36a63p-10", "-0x1.b69576a1fe612p-14", "0x1.1678a149f953dp-18")]


def cosines(t: np.ndarray) -> np.ndarray:
    """cos(t) within a few units of the last place, by whole-array steps in place of ``t``: about a
    third of the time that ``np.cos`` takes in double precision."""
    if not t.size:
        return t
    k = np.rint(t * (1.0 / math.pi))
    if not max(k.max(), -k.min()) < 2 ** 20:  # far out or not a number
        return np.cos(t)
    r = k * _PI
    t -= r
    t -= np.multiply(k, _PI_REST, out=r)
    t *= 0.5
    t *= t
    r.fill(_COS[-1])
    for c in _COS[-2::-1]:
        r *= t
        r += c
    r *= r  # cos(2a) = 2 cos(a)^2 - 1
    r *= 2.0
    r -= 1.0
    k *= 0.5
    k -= np.floor(k, out=t)
    r *= 1.0 - 4.0 * k  # odd multiples of pi turn the sign
    return r


def squared_cosines(x1: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """cos(pi v)^2 of v = ``x1 @ turns``, so that cos(2 pi v) is twice that less 1; within a few units of the
    last place, by about half the array steps of ``cosines``."""
    v = x1 @ turns
    out = np.rint(v)
    v -= out
    v *= v
    np.multiply(v, _COS_PI[-1], out=out)
    out += _COS_PI[-2]
    for c in _COS_PI[-3::-1]:
        out *= v
        out += c
    out *= out
    return out


@dataclass
class SvrModel:
    feature_names: list
    kernel: str
    omega: np.ndarray | None
    phase: np.ndarray | None
    coef: np.ndarray
    intercept: float
    converged: bool = False

    def _map(self, x: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return x
        return math.sqrt(2.0 / self.omega.shape[1]) * cosines(x @ self.omega + self.phase)

    def _mapped(self, x: np.ndarray):
        """``(from, to, features)`` of few rows at a time, so that the features stay in the cache."""
        for a in range(0, len(x), MAPPED_ROWS):
            yield a, a + MAPPED_ROWS, self._map(x[a:a + MAPPED_ROWS])

    def transform(self, df: DataFrame) -> DataFrame:
        model = self
        names = list(self.feature_names)

        @F.pandas_udf(DoubleType())
        def _predict(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype="float64") for c in cols])
            return pd.Series(np.concatenate([np.zeros(0), *(
                z @ model.coef + model.intercept for _, _, z in model._mapped(x))]))

        return df.withColumn(PREDICTION, _predict(*[col(c) for c in names]))

    @property
    def coefficients(self):
        return self.coef if self.kernel == "linear" else None


def _one_array(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(values)], pa.array(values))], names=["s"])


def _summed(parts: DataFrame, name: str, size: int) -> np.ndarray:
    """Sum of the partitions' arrays, element by element on the executors: the
    driver gets ``size`` numbers however many partitions there are."""
    out = np.zeros(size)
    rows = parts.select(F.posexplode(name).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    for r in rows.collect():
        out[r["i"]] = r["v"]
    return out


def _evenly(blocks: RDD, rows: int) -> RDD:
    """The blocks dealt by turns, as many to each partition: one a core, more where these would be large."""
    cores = blocks.context.defaultParallelism
    parts = cores * max(1, -(-rows // (cores * TASK_BLOCKS * BLOCK_ROWS)))
    return blocks.zipWithIndex().map(lambda b: (b[1], b[0])).partitionBy(parts, int).values()


def fit_svr(train: DataFrame, feature_names, C: float = 1.0, epsilon: float = 0.1,
            kernel: str = "rbf", gamma: float | None = None, n_components: int = 100,
            iterations: int = 200, seed: int = 42, lr: float = 0.01, tol: float = 1e-4,
            patience: int = 20) -> SvrModel:
    """Minimise ``C * sum(max(0, |y - f(x)| - eps)) + ||w||^2 / 2``.

    Warm start from the ridge solution in feature space (one pass of
    per-partition Gram blocks), then full-batch Adam steps on the
    epsilon-insensitive loss, until the best objective has improved by less
    than ``tol`` of itself over ``patience`` steps (``converged``) or
    ``iterations`` steps are done. Each step is one Spark job of a stage with a
    task a core (more on large inputs), over blocks of rows that are packed and
    dealt evenly once; the driver receives ``n_components + 2`` numbers from each task."""
    given = list(feature_names)
    if wide := [c for c in given if isinstance(train.schema[c].dataType, VectorUDT)]:
        raise ValueError(f"the SVR takes no vector columns: {wide}")
    p = len(given)
    names = [f"f{i}" for i in range(p)]
    data = train.select(*[col(c).alias(k) for c, k in zip(given, names)], LABEL) \
        .where(F.col(LABEL).isNotNull())
    width = p + 1

    def pack(batches):
        held, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
                rows += batch.num_rows
            if held and (batch is None or rows >= BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["b"])
                held, rows = [], 0

    blocks = data.mapInArrow(pack, "b binary")

    def unpacked(batches):
        for batch in batches:
            for b in batch.column("b"):
                block = np.frombuffer(b.as_buffer()).reshape(-1, width)
                yield np.ascontiguousarray(block[:, :p]), block[:, p]

    def in_columns(row):
        """The features with a column of ones, then the labels."""
        block = np.frombuffer(row[0]).reshape(-1, width)
        return np.column_stack([block[:, :p], np.ones(len(block))]).tobytes() + block[:, p].tobytes()

    n = data.count()
    rng = np.random.default_rng(seed)
    if kernel == "linear":
        omega = phase = None
        dim = p
    else:
        if gamma is None:
            # 'scale': 1 / (n_features * Var(X)) over all feature values.
            mom = data.agg(*[F.struct(F.avg(c).alias("m"), F.avg(F.col(c) * F.col(c)).alias("q"))
                             .alias(f"c{i}") for i, c in enumerate(names)]).first()
            ms = np.array([mom[f"c{i}"]["m"] for i in range(p)])
            qs = np.array([mom[f"c{i}"]["q"] for i in range(p)])
            var = float(qs.mean() - ms.mean() ** 2)
            gamma = 1.0 / (p * var) if var > 0 else 1.0
        omega = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(p, n_components))
        phase = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
        dim = n_components
    model = SvrModel(given, kernel, omega, phase, np.zeros(dim), 0.0)
    # Warm start: ridge least squares in feature space, (Z'Z + I/C) w = Z'y with
    # an unpenalised intercept. One pass: every partition returns its
    # (dim+1)^2 Gram block and Z'y; the small system is solved on the driver.
    snap0 = SvrModel(names, kernel, omega, phase, np.zeros(dim), 0.0)

    def gram(batches, snap=snap0):
        a = np.zeros((dim + 1, dim + 1))
        b = np.zeros(dim + 1)
        for x, y in unpacked(batches):
            for i, j, z in snap._mapped(x):
                z1 = np.column_stack([z, np.ones(len(z))])
                a += z1.T @ z1
                b += z1.T @ y[i:j]
        yield _one_array(np.concatenate([a.ravel(), b]))

    sums = _summed(blocks.mapInArrow(gram, "s array<double>"), "s", (dim + 1) * (dim + 2))
    a, b = sums[:(dim + 1) ** 2].reshape(dim + 1, dim + 1), sums[(dim + 1) ** 2:]
    reg = np.eye(dim + 1) / max(C, 1e-12)
    reg[dim, dim] = 0.0
    sol = np.linalg.lstsq(a + reg, b, rcond=None)[0]
    model.coef, model.intercept = sol[:dim], float(sol[dim])
    m1 = np.zeros(dim + 1)
    m2 = np.zeros(dim + 1)
    b1, b2 = 0.9, 0.999
    scale_y = float(data.agg(F.stddev_pop(LABEL).alias("s")).first()["s"] or 1.0)
    best = (float("inf"), model.coef.copy(), model.intercept)
    history: list[float] = []
    # A feature is ``twice`` times its raw value less ``less``; rows keep raw values only while they are mapped.
    turns, twice, less = None, 1.0, 0.0
    if kernel != "linear":
        less = math.sqrt(2.0 / dim)
        turns, twice = np.vstack([omega, phase]) / (2.0 * math.pi), 2.0 * less
    kept = _evenly(blocks.rdd.map(in_columns), n).persist(StorageLevel.MEMORY_AND_DISK)
    for t in range(1, iterations + 2):
        snap = SvrModel(names, kernel, None, None, model.coef.copy(), model.intercept)

        def partial(held, snap=snap):
            g, loss = np.zeros(dim + 1), 0.0
            coef, intercept = twice * snap.coef, snap.intercept - less * float(snap.coef.sum())
            for b in held:
                n = len(b) // (8 * (width + 1))
                x1, y = np.frombuffer(b, count=n * width).reshape(n, width), np.frombuffer(b, offset=8 * n * width)
                for i in range(0, n, MAPPED_ROWS):
                    j = i + MAPPED_ROWS
                    q = x1[i:j, :p] if turns is None else squared_cosines(x1[i:j], turns)
                    r = y[i:j] - (q @ coef + intercept)
                    s = np.where(np.abs(r) > epsilon, -np.sign(r), 0.0)
                    loss += float(np.maximum(np.abs(r) - epsilon, 0.0).sum())
                    g[:dim] += s @ q
                    g[dim] += s.sum()
            g[:dim] = twice * g[:dim] - less * g[dim]
            yield np.append(g, loss)

        sums = kept.mapPartitions(partial).reduce(np.add)
        objective = C * sums[-1] + 0.5 * float(snap.coef @ snap.coef)
        if objective < best[0]:
            best = (objective, snap.coef.copy(), snap.intercept)
        history.append(best[0])
        if len(history) > patience and history[-1 - patience] - best[0] <= tol * abs(best[0]):
            model.converged = True
            break
        if t > iterations:
            break
        grad = C * sums[:-1] / max(n, 1)
        grad[:dim] += model.coef / max(n, 1)
        m1 = b1 * m1 + (1 - b1) * grad
        m2 = b2 * m2 + (1 - b2) * grad * grad
        step = lr * scale_y * (m1 / (1 - b1 ** t)) / (np.sqrt(m2 / (1 - b2 ** t)) + 1e-12)
        model.coef = model.coef - step[:dim]
        model.intercept = float(model.intercept - step[dim])
    # Keep the best iterate seen (subgradient steps are not monotone).
    model.coef, model.intercept = best[1], float(best[2])
    kept.unpersist()
    return model


# --------------------------------------------------------------------------
# M1-M6 via Spark ML, M8 model choice
# --------------------------------------------------------------------------

@dataclass
class FittedModel:
    name: str
    feature_names: list
    model: object
    params: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``; input holds the feature columns."""
        if isinstance(self.model, SvrModel):
            return self.model.transform(df)
        if isinstance(self.model, forest.ForestModel):
            x = forest.feature_array(df, FEATURES, self.feature_names)
            return self.model.transform(df, x, PREDICTION)
        if isinstance(self.model, boosting.BoostedModel):
            return self.model.transform(df, forest.feature_array(df, FEATURES, self.feature_names))
        if FEATURES in df.columns:  # assembled once for several models
            return self.model.transform(df)
        return self.model.transform(assemble(df, self.feature_names)).drop(FEATURES)

    def importances(self):
        """I1 source: (vector, method) or (None, None)."""
        m = self.model
        shares = getattr(m, "featureImportances", None)  # a forest sums them up on every call
        if shares is not None:
            return shares.toArray(), "Tree-based Feature Importance"
        if isinstance(m, SvrModel):
            c = m.coefficients
            return (None, None) if c is None else (np.abs(c), "Coefficient Magnitude")
        if hasattr(m, "coefficients"):
            return np.abs(m.coefficients.toArray()), "Coefficient Magnitude"
        return None, None


def label_moments(train: DataFrame) -> dict:
    r = train.agg(F.count(LABEL).alias("n"), F.stddev_pop(LABEL).alias("sp"),
                  F.stddev_samp(LABEL).alias("ss")).first()
    return {"n": r["n"], "sd_pop": r["sp"] or 0.0, "sd_samp": r["ss"] or 0.0}


def _memory_mb(value: str) -> int:
    v = value.strip().lower()
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    if v and v[-1] == "b":
        v = v[:-1]
    if v and v[-1] in units:
        return int(float(v[:-1]) * units[v[-1]])
    return int(int(v) / (1024 * 1024))


def tree_memory_budget_mb(spark) -> int:
    """``maxMemoryInMB`` for tree learners: a quarter of the heap share of one
    concurrent task (driver heap / cores in local mode, executor heap /
    executor cores on a cluster), between 16 and 256 MB."""
    conf = spark.sparkContext.getConf()
    if spark.sparkContext.master.startswith("local"):
        heap = _memory_mb(conf.get("spark.driver.memory", "1g"))
        tasks = spark.sparkContext.defaultParallelism
    else:
        heap = _memory_mb(conf.get("spark.executor.memory", "1g"))
        tasks = int(conf.get("spark.executor.cores", "1"))
    return int(max(16, min(256, heap / max(tasks, 1) / 4)))


def build_estimator(name: str, hp: dict, moments: dict, seed: int = 42,
                    tree_memory_mb: int = 256, width: int = 0):
    """Spark ML estimator for a model name and reference-style hyper-parameters;
    ``width`` features."""
    n = max(moments["n"], 1)
    # The iterative solver works on a label divided by its sample deviation, the
    # normal one by its population deviation; penalties are scaled to match.
    solver = "normal" if width <= NORMAL_SOLVER_MAX_FEATURES else "l-bfgs"
    sd = moments.get("sd_pop" if solver == "normal" else "sd_samp", 0.0)
    lin = dict(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION,
               standardization=False, fitIntercept=True, solver=solver)
    exact = dict(maxIter=1000, tol=1e-10)
    if name == "linear":
        return LinearRegression(regParam=0.0, **lin, **exact)
    if name == "ridge":
        alpha = float(hp.get("alpha", 1.0))
        return LinearRegression(regParam=alpha * sd / n, elasticNetParam=0.0, **lin, **exact)
    # Lasso and elastic net also use the normal-equation solver: one pass
    # aggregates the p x p Gram matrix, then OWL-QN runs on the driver over it,
    # so the number of passes over the data does not grow with iterations.
    if name == "lasso":
        alpha = float(hp.get("alpha", 1.0))
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, **lin, **exact)
    if name == "elastic_net":
        alpha = float(hp.get("alpha", 1.0))
        l1r = float(hp.get("l1_ratio", 0.5))
        l1 = alpha * l1r
        l2 = alpha * (1 - l1r) * sd
        reg = l1 + l2
        return LinearRegression(regParam=reg, elasticNetParam=(l1 / reg) if reg > 0 else 0.0,
                                **lin, **exact)
    tree = dict(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, seed=seed,
                maxMemoryInMB=tree_memory_mb, maxBins=int(hp.get("max_bins", DEFAULT_MAX_BINS)))
    if name == "random_forest":
        depth = hp.get("max_depth")
        return RandomForestRegressor(
            numTrees=int(hp.get("n_estimators", 100)),
            maxDepth=MLLIB_MAX_DEPTH if depth is None else min(int(depth), MLLIB_MAX_DEPTH),
            minInstancesPerNode=int(hp.get("min_samples_leaf", 1)), cacheNodeIds=True,
            checkpointInterval=NODE_CHECKPOINTS,
            featureSubsetStrategy=hp.get("max_features") or "all", **tree)
    if name == "gradient_boosting":
        return GBTRegressor(
            maxIter=int(hp.get("n_estimators", 100)), stepSize=float(hp.get("learning_rate", 0.1)),
            maxDepth=int(hp.get("max_depth", 3)),
            subsamplingRate=float(hp.get("subsample", 1.0)), **tree)
    raise ValueError(f"no Spark ML estimator for {name!r}")


def fit_random_forest(rows: DataFrame, feature_names, hp: dict, seed: int) -> forest.ForestModel:
    """M5 with the reference's parameters: no depth limit, a split looks at all features unless
    ``max_features`` is 'sqrt' or 'log2'."""
    p = len(feature_names)
    looks = {"sqrt": max(1, math.isqrt(p)), "log2": max(1, int(math.log2(max(p, 1))))}
    how = forest.Growth(max_depth=hp.get("max_depth"),
                        min_samples_split=int(hp.get("min_samples_split", 2)),
                        min_samples_leaf=int(hp.get("min_samples_leaf", 1)),
                        max_features=looks.get(hp.get("max_features")), seed=seed)
    return forest.fit_forest(rows, forest.feature_array(rows, FEATURES, feature_names), F.col(LABEL),
                             p, int(hp.get("n_estimators", 100)), how)


def dealt(rows: DataFrame, feature_names) -> DataFrame:
    """Trees draw their samples by partition: deal the rows by their content to
    spark.sql.shuffle.partitions, so that a fit does not depend on the cores."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, LABEL, *[col(c) for c in feature_names])


def fit_boosting(rows: DataFrame, feature_names, hp: dict, seed: int) -> boosting.BoostedModel | None:
    """M6 on rows counted by their bins. None where MLlib takes the rows themselves: stages that draw
    rows, sparse vectors, and rows that it refuses (none at all, or values that are not finite)."""
    if float(hp.get("subsample", 1.0)) < 1.0 or not feature_names or any(
            isinstance(rows.schema[c].dataType, VectorUDT) for c in feature_names if c in rows.columns):
        return None
    return boosting.fit(rows, lambda: dealt(rows, feature_names),
                        lambda df: forest.feature_array(df, FEATURES, feature_names), F.col(LABEL),
                        len(feature_names), int(hp.get("max_bins", DEFAULT_MAX_BINS)), seed,
                        lambda **more: build_estimator("gradient_boosting", hp, {"n": 1}, seed, tree_memory_budget_mb(
                            rows.sparkSession)).setParams(**more))


def fit_model(name: str, train: DataFrame, feature_names, hp: dict | None = None,
              seed: int = 42) -> FittedModel:
    """Fit one model on a frame holding the feature columns and ``y``."""
    hp = dict(hp or {})
    if name == "svr":
        m = fit_svr(train, feature_names, C=float(hp.get("C", 1.0)),
                    epsilon=float(hp.get("epsilon", 0.1)), kernel=hp.get("kernel", "rbf"),
                    seed=seed, iterations=int(hp.get("iterations", 200)))
        return FittedModel(name, list(feature_names), m, hp)
    rows = train.where(F.col(LABEL).isNotNull())
    if name == "random_forest" and not any(
            isinstance(train.schema[c].dataType, VectorUDT) for c in feature_names):
        return FittedModel(name, list(feature_names),
                           fit_random_forest(rows, feature_names, hp, seed), hp)
    if name == "gradient_boosting" and (m := fit_boosting(rows, feature_names, hp, seed)):
        return FittedModel(name, list(feature_names), m, hp)
    if name in ("random_forest", "gradient_boosting"):
        rows = dealt(rows, feature_names)
    data = rows if FEATURES in rows.columns else assemble(rows, feature_names)
    # Only the quadratic penalties are scaled by the label's deviation.
    moments = label_moments(train) if name in ("ridge", "elastic_net") else {"n": 1}
    est = build_estimator(name, hp, moments, seed,
                          tree_memory_budget_mb(train.sparkSession),
                          data.schema[FEATURES].metadata.get("ml_attr", {}).get(
                              "num_attrs", len(feature_names)))
    return FittedModel(name, list(feature_names), est.fit(data), hp)


def choose_models(params: RegressionParams) -> list[str]:
    """M8: the configured subset, in the reference's order."""
    from regressa.config import ALL_MODELS

    return [m for m in ALL_MODELS if m in params.models_to_include]
