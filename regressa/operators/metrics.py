"""Evaluation and ranking (A1-A8): metrics are one aggregation over
``(y, prediction)`` rows, optionally per group (fold, model, batch, bin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metric names whose plain value is an error.
LOWER_IS_BETTER = {"rmse", "mae", "mape"}
COMPARISON_COLUMNS = ["Model", "cv_mean", "cv_std", "test_r2", "test_rmse", "test_mae",
                      "test_mape"]


def metric_aggs(y: str = "y", p: str = "prediction", only=None) -> list[Column]:
    """n, r2, rmse, mae, mape (x100) and the count of zero targets.

    R2 uses ``var_pop(y) * n`` as the total sum of squares (a stable central
    moment, no ``sum(y^2) - sum(y)^2 / n`` cancellation); a constant target
    gives 1 when the fit is perfect, else 0. MAPE divides by y with
    ``try_divide``; a zero target makes it +inf, as in the reference."""
    yc, pc = F.col(y), F.col(p)
    err = yc - pc
    sse = F.sum(err * err)
    sst = F.var_pop(yc) * F.count(yc)
    r2 = (F.when(sst > 0, F.lit(1.0) - sse / sst)
          .when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    zeros = F.count_if(yc == 0)
    mape = F.when(zeros > 0, F.lit(float("inf"))).otherwise(
        F.avg(F.abs(F.try_divide(err, yc))) * 100)
    named = {
        "n": F.count(F.lit(1)),
        "r2": r2,
        "rmse": F.sqrt(F.avg(err * err)),
        "mae": F.avg(F.abs(err)),
        "mape": mape,
        "zero_targets": zeros,
    }
    return [c.alias(k) for k, c in named.items() if only is None or k in only]


def regression_metrics(pred: DataFrame, y: str = "y", p: str = "prediction",
                       group_cols=()) -> DataFrame:
    """A2-A5 (per group when ``group_cols``): rows ``(*groups, n, r2, rmse,
    mae, mape, zero_targets)``; rows with a null y or prediction are skipped."""
    data = pred.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    if group_cols:
        return data.groupBy(*group_cols).agg(*metric_aggs(y, p))
    return data.agg(*metric_aggs(y, p))


def metrics_dict(pred: DataFrame, y: str = "y", p: str = "prediction") -> dict:
    r = regression_metrics(pred, y, p).first()
    return {"test_r2": r["r2"], "test_rmse": r["rmse"], "test_mae": r["mae"],
            "test_mape": r["mape"], "n": r["n"]}


def cv_score_frame(pred_by_fold: DataFrame, metric: str = "r2", y: str = "y",
                   p: str = "prediction", fold: str = "fold") -> DataFrame:
    """A1 building block: the chosen metric per held-out fold, one grouped
    aggregation over the out-of-fold predictions of all folds."""
    if metric == "explained_variance":
        rest = F.col(y) - F.col(p)
        ratio = F.try_divide(F.var_pop(rest), F.var_pop(y))
        return pred_by_fold.where(rest.isNotNull()).groupBy(fold).agg(
            F.coalesce(1.0 - ratio, F.when(F.var_pop(rest) == 0, 1.0).otherwise(0.0)).alias("score"))
    m = regression_metrics(pred_by_fold, y, p, group_cols=[fold])
    m = m.withColumn("share", F.col("mape") / 100)
    col = {"r2": "r2", "rmse": "rmse", "mae": "mae", "mape": "mape", "neg_mean_squared_error": "rmse",
           "neg_mean_absolute_percentage_error": "share",
           "neg_root_mean_squared_error": "rmse", "neg_mean_absolute_error": "mae"}[metric]
    score = F.col(col)
    if metric == "neg_mean_squared_error":
        score = -(score * score)
    elif metric.startswith("neg_"):
        score = -score
    return m.select(F.col(fold), score.alias("score"))


def comparison_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Model comparison ranked by test R2 (ties by name); the first row is
    the winner. ``rows`` hold the per-model metrics (one per model)."""
    schema = ("Model string, cv_mean double, cv_std double, test_r2 double, "
              "test_rmse double, test_mae double, test_mape double")
    data = [tuple(None if r.get(c) is None else (float(r[c]) if c != "Model" else r[c])
                  for c in COMPARISON_COLUMNS) for r in rows]
    return rank_models(spark.createDataFrame(data, schema))


def rank_models(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("test_r2"), F.asc("Model"))


def cv_summary(cv_scores: DataFrame) -> DataFrame:
    """``(Model, mean_cv_score, std_dev, min_score, max_score)`` from long
    ``(Model, fold, score)`` rows; population std; best mean first."""
    return (cv_scores.groupBy("Model").agg(
        F.avg("score").alias("mean_cv_score"), F.stddev_pop("score").alias("std_dev"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"))
        .orderBy(F.desc("mean_cv_score"), "Model"))


def metrics_table(comparison: DataFrame) -> DataFrame:
    """R2, RMSE, MAE per model."""
    return comparison.select("Model", F.col("test_r2").alias("r2"),
                             F.col("test_rmse").alias("rmse"), F.col("test_mae").alias("mae"))
