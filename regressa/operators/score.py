"""Scoring (R1-R6): batch and single-record prediction with a fitted
preprocessor and model. Scoring is one narrow stage (no shuffle): the fitted
fills, category lists and scaler moments are literals in the projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.operators.validate import missing_features, validate_scoring_input

# Fixed value: the reference's constant confidence for regressors.
DEFAULT_CONFIDENCE = 0.8


@dataclass
class ScoringResult:
    success: bool
    errors: list
    predictions: DataFrame | None


def score_batch(batch: DataFrame, preprocessor, model, keep=(), target_name: str | None = None,
                confidence: bool = False) -> DataFrame:
    """R2: transform with the training-time pipeline, align to the training
    feature list (unseen dummies -> 0), predict, and append
    ``predicted_<target>`` to the ``keep`` columns."""
    feats = preprocessor.transform(batch, keep=keep)
    pred = model.predict(feats)
    name = f"predicted_{target_name or preprocessor.target}"
    out = pred.select(*keep, F.col("prediction").alias(name))
    if confidence:
        out = out.withColumn("confidence", F.lit(DEFAULT_CONFIDENCE))
    return out


def score_validated(batch: DataFrame, preprocessor, model, keep=()) -> ScoringResult:
    """V9 checks (missing or all-null features are errors), then R2.
    Extra columns are ignored."""
    checks = validate_scoring_input(batch.drop(*[k for k in keep if k not in
                                                 preprocessor.input_features]),
                                    preprocessor.input_features)
    errs = [f"{r['check']}: {r['column_name']}" for r in
            checks.where((F.col("severity") == "error") & F.col("failed")).collect()]
    if errs:
        return ScoringResult(False, errs, None)
    return ScoringResult(True, [], score_batch(batch, preprocessor, model, keep, confidence=True))


def check_batch_columns(batch: DataFrame, preprocessor) -> list[str]:
    """V10 for batch scoring: required raw features absent from the batch."""
    return missing_features(batch, preprocessor.input_features)


def prediction_vs_training(scored: DataFrame, pred_col: str, train_mean: float,
                           train_std: float) -> DataFrame:
    """``z = (p - mean_train_y) / std_train_y`` and ``unusual = |z| > 1``."""
    z = F.try_divide(F.col(pred_col) - F.lit(train_mean), F.lit(train_std))
    return scored.withColumn("z_vs_training", z).withColumn(
        "unusual", F.coalesce(F.abs(F.col("z_vs_training")) > 1, F.lit(False)))


def prediction_summary(scored: DataFrame, pred_col: str) -> DataFrame:
    """``(count, mean, std)`` of predictions, population std."""
    return scored.agg(F.count(pred_col).alias("count"), F.avg(pred_col).alias("mean"),
                      F.stddev_pop(pred_col).alias("std"))


def score_record(spark, record: dict, preprocessor, model) -> DataFrame:
    """One record through R2 (fills and categories from training, so a
    single row keeps its dummy columns)."""
    one = spark.createDataFrame([record])
    return score_batch(one, preprocessor, model, keep=())
