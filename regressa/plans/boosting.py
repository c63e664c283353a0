"""Gradient boosting (M6) over rows counted by their bins.

MLlib's trees see a row only through the bins of its features, cut at a few thresholds that are fixed
before the first tree. Rows of the same bins therefore get the same prediction at every stage, and
their squared errors differ from that of their mean label by a constant that no split changes. One pass
counts the rows of each combination of bins; the stages, some hundred passes, then read one weighted row
a combination. There are never more of these than rows, and far fewer where the rows are many.

The thresholds are those that MLlib takes itself: from all rows, or from its sample of them beyond
10,000 (or the squared number of bins).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows from which MLlib takes the thresholds, at least.
SAMPLE_ROWS = 10_000
#: Combinations of bins that make a further task worth its start, and those that one task holds at most.
LEAST_ROWS, MOST_ROWS = 5_000, 250_000
#: The largest ``maxBins`` whose square MLlib still counts in 32 bits.
MOST_BINS = 46_340


# --------------------------------------------------------------------------
# Thresholds
# --------------------------------------------------------------------------

def sample_rows(max_bins: int) -> int:
    return max(max_bins * max_bins, SAMPLE_ROWS)


def thresholds(values: np.ndarray, counts: np.ndarray, expected: float, splits: int) -> np.ndarray:
    """At most ``splits`` cuts between the distinct ``values`` other than zero (``counts`` rows each) as
    MLlib places them: zeros are the rows that lack up to the ``expected`` number; where there are too
    many values, a cut lies next to each multiple of an even share of the rows."""
    order = np.argsort(values)
    values, counts = values[order], counts[order].astype(float)
    zeros = expected - counts.sum()
    if zeros > np.finfo(float).eps * counts.sum() * 100:
        at = int(np.searchsorted(values, 0.0))
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= splits:
        return np.unique(middles)
    stride = expected / (splits + 1)
    upto, target, cuts = np.cumsum(counts), stride, []
    for i, middle in enumerate(middles.tolist()):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            cuts.append(middle)
            target += stride
    return np.unique(cuts)


def find_thresholds(rows: DataFrame, width: int, expected: float, splits: int) -> list[list[float]]:
    """Cuts of each feature of ``x``; the features are spread over tasks, and only the cuts reach the driver."""
    def cut(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        cuts = thresholds(own["v"].to_numpy(), own["n"].to_numpy(), expected, splits)
        return pd.DataFrame({"f": [key[0]], "cuts": [cuts.tolist()]})

    found = rows.select(F.posexplode("x").alias("f", "v")).where("v != 0").groupBy("f", "v") \
        .agg(F.count(F.lit(1)).alias("n")).groupBy("f").applyInPandas(cut, "f int, cuts array<double>")
    out: list[list[float]] = [[] for _ in range(width)]
    for r in found.collect():
        out[r["f"]] = list(r["cuts"])
    return out


def drawn(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The rows that MLlib draws for its thresholds: ``RDD.sample`` of the JVM with its seed."""
    spark = rows.sparkSession
    draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    some = rows._jdf.javaRDD().sample(False, fraction, draw)
    return DataFrame(spark._jsparkSession.createDataFrame(some, rows._jdf.schema()), spark)


# --------------------------------------------------------------------------
# Fit
# --------------------------------------------------------------------------

def with_bins(df: DataFrame, x: Column, cuts: list[list[float]]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column a feature: the number of its bin from 1 on (a value on a cut lies below it,
    a missing one above all)."""
    names = [f"__bin{i}" for i in range(len(cuts))]
    cut = [i for i, c in enumerate(cuts) if c]
    out = df.withColumns({f"__x{i}": x[i] for i in cut})
    if cut:
        edges = [[-math.inf, *np.nextafter(cuts[i], math.inf).tolist(), math.inf] for i in cut]
        out = Bucketizer(inputCols=[f"__x{i}" for i in cut], outputCols=[names[i] for i in cut],
                         splitsArray=edges, handleInvalid="keep").transform(out)
    return out.drop(*[f"__x{i}" for i in cut]).withColumns(
        {n: F.col(n) + 1.0 if c else F.lit(1.0) for n, c in zip(names, cuts, strict=True)}), names


def counted(rows: DataFrame, x: Column, y: Column, cuts: list[list[float]]) -> tuple[DataFrame, list[str]]:
    """(bins, ``y`` their mean label, ``n`` rows), and a row without weight for every bin, so that MLlib
    finds exactly ``cuts`` between the bins."""
    binned, names = with_bins(rows.select(x.alias("x"), y.cast("double").alias("y")), F.col("x"), cuts)
    groups = binned.groupBy(*names).agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    most = max(len(c) for c in cuts) + 1
    every = rows.sparkSession.range(1, most + 1).select(
        *[F.least("id", F.lit(len(c) + 1)).cast("double").alias(n) for n, c in zip(names, cuts, strict=True)],
        F.lit(0.0).alias("y"), F.lit(0.0).alias("n"))
    return groups.unionByName(every), names


def fit(rows: DataFrame, dealt: Callable[[], DataFrame], x_of: Callable[[DataFrame], Column], y: Column,
        width: int, max_bins: int, seed: int, estimator: Callable[..., GBTRegressor]) -> BoostedModel | None:
    """Boosted trees on ``rows``; ``dealt`` gives them in the partitions that MLlib's sample is drawn
    from, ``x_of`` a frame's features as an array<double> of ``width``. ``estimator`` makes MLlib's
    learner with further parameters. None where there are no rows, or values that are not finite."""
    spark, x = rows.sparkSession, x_of(rows)
    odd = F.exists(F.concat(x, F.array(y.cast("double"))), lambda v: F.isnan(v) | (F.abs(v) == math.inf))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(odd), F.lit(False)).alias("odd")).first()
    n = seen["n"]
    if not n or seen["odd"]:
        return None
    bins = min(max_bins, n)
    share = min(1.0, sample_rows(bins) / n)
    some = rows.select(x.alias("x"))
    if share < 1.0:
        some = dealt()
        some = drawn(some.select(x_of(some).alias("x")), share, seed)
    cuts = find_thresholds(some, width, share * n, bins - 1)
    held, names = counted(rows, x, y, cuts)
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        groups = held.count()
        tasks = max(min(spark.sparkContext.defaultParallelism, groups // LEAST_ROWS + 1), groups // MOST_ROWS)
        data = VectorAssembler(inputCols=names, outputCol="features").transform(held.repartition(tasks, *names))
        # With so many bins MLlib looks at all rows for its cuts; a side without rows is no side.
        learner = estimator(featuresCol="features", labelCol="y", weightCol="n", minWeightFractionPerNode=min(0.25, 0.5 / n),
                            maxBins=max(max_bins, min(MOST_BINS, math.isqrt(groups) + 1)))
        return BoostedModel(cuts, learner.fit(data))
    finally:
        held.unpersist()


# --------------------------------------------------------------------------
# The fitted model
# --------------------------------------------------------------------------

@dataclass
class BoostedModel:
    """MLlib's trees over the numbers of bins, and the cuts between the bins of each feature."""

    cuts: list[list[float]]
    trees: GBTRegressionModel

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (the name that Spark's models use)
        return self.trees.featureImportances

    def transform(self, df: DataFrame, x: Column) -> DataFrame:
        """``df`` with the trees' prediction; ``x`` as in the fit."""
        binned, names = with_bins(df, x, self.cuts)
        vector = "__bins"
        assembled = VectorAssembler(inputCols=names, outputCol=vector).transform(binned)
        return self.trees.copy({self.trees.featuresCol: vector}).transform(assembled).drop(vector, *names)
