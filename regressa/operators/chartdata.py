"""Chart data (G1-G7): the numbers behind the reference's plots. Drawing is
out of scope; every function returns a DataFrame a plotting tool can read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.functions.stats import norm_ppf_sql
from regressa.operators.ranking import with_row_number

# Model complexity scores of the reference's comparison chart,
# keyed here by the internal model names; any other model scores 5.
COMPLEXITY = {
    "linear": 1, "ridge": 2, "lasso": 2, "elastic_net": 3, "svr": 5,
    "random_forest": 8, "gradient_boosting": 9,
}
DEFAULT_COMPLEXITY = 5
HIST_BINS = 30


def residual_histogram(pred: DataFrame, y: str = "y", p: str = "prediction",
                       bins: int = HIST_BINS) -> DataFrame:
    """G1: equal-width histogram of residuals over [min, max]; the maximum
    falls in the last bin. Rows ``(bin, lower, upper, count)`` for non-empty
    bins; one scan for the range, one grouped count."""
    r = pred.select((F.col(y) - F.col(p)).alias("r")).where(F.col("r").isNotNull())
    rng = r.agg(F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    if lo is None:
        return r.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.lit(bins), F.floor((F.col("r") - F.lit(lo)) / F.lit(width)).cast("int") + 1)
    counts = r.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
                         (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"), "count")


def qq_points(pred: DataFrame, key_cols, y: str = "y", p: str = "prediction") -> DataFrame:
    """Sorted residuals against normal quantiles at
    ``linspace(0.01, 0.99, n)``: rows ``(i, theoretical, sample)``."""
    r = pred.select(*key_cols, (F.col(y) - F.col(p)).alias("sample")).where(
        F.col("sample").isNotNull())
    n = r.count()
    ranked = with_row_number(r, ["sample", *key_cols], name="i")
    # Double literals: Spark reads 0.98 as a DECIMAL, which would round.
    prob = (f"(CAST(0.01 AS DOUBLE) + CAST(0.98 AS DOUBLE) * (i - 1) / {max(n - 1, 1)})"
            if n > 1 else "CAST(0.01 AS DOUBLE)")
    return ranked.select("i", F.expr(norm_ppf_sql(prob)).alias("theoretical"), "sample")


def standardized_residuals(pred: DataFrame, key_cols, y: str = "y",
                           p: str = "prediction") -> DataFrame:
    """``residual / std(residual)`` (ddof 1), with the fitted values; the
    scalar std is computed once and applied as a literal."""
    r = F.col(y) - F.col(p)
    sd = pred.agg(F.stddev_samp(r).alias("s")).first()["s"]
    return pred.select(*key_cols, F.col(p).alias("prediction"),
                       F.try_divide(r, F.lit(sd)).alias("std_residual"))


def predicted_vs_actual(pred: DataFrame, key_cols, y: str = "y",
                        p: str = "prediction") -> DataFrame:
    """``(key, actual, predicted, abs_error)`` rows."""
    return pred.select(*key_cols, F.col(y).alias("actual"), F.col(p).alias("predicted"),
                       F.abs(F.col(y) - F.col(p)).alias("abs_error"))


def identity_line(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """G4 reference line end points: ``(lo, hi)`` over actual and predicted."""
    return pred.agg(F.least(F.min(y), F.min(p)).alias("lo"),
                    F.greatest(F.max(y), F.max(p)).alias("hi"))


def complexity_vs_r2(comparison: DataFrame) -> DataFrame:
    """``(Model, complexity, test_r2, test_rmse)``."""
    m = F.create_map(*[x for k, v in COMPLEXITY.items() for x in (F.lit(k), F.lit(v))])
    return comparison.select(
        "Model", F.coalesce(m[F.col("Model")], F.lit(DEFAULT_COMPLEXITY)).alias("complexity"),
        "test_r2", "test_rmse")


def cv_error_bars(comparison: DataFrame) -> DataFrame:
    """``cv_mean`` with ``cv_mean -/+ cv_std``."""
    return comparison.select("Model", "cv_mean", (F.col("cv_mean") - F.col("cv_std")).alias("low"),
                             (F.col("cv_mean") + F.col("cv_std")).alias("high"))


def prediction_range(pred: DataFrame, p: str = "prediction") -> DataFrame:
    """``(min, max)`` of the predictions (zero-line extent)."""
    return pred.agg(F.min(p).alias("min"), F.max(p).alias("max"))
