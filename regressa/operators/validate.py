"""Table validation (V1-V8) in one aggregation pass, plus scoring-input
checks (V9, V10) that are schema differences and one ``count`` per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from regressa import messages as M
from regressa.functions.columns import categorical_columns, col, role_of
from regressa.operators.profile import distinct_counts

# Thresholds of the reference's validator.
MIN_VALID_TARGET_RATIO = 0.5
MIN_ROWS = 50
HIGH_CARDINALITY_RATIO = 0.8

RESULT_SCHEMA = ("check string, severity string, column_name string, value double, "
                 "failed boolean, message string")


def validate(df: DataFrame, target: str, *, approx_distinct: bool = False) -> DataFrame:
    """Rows ``(check, severity, column_name, value, failed, message)``, one per
    check; ``failed`` marks a raised error or warning.

    Checks: empty_table (V1), target_missing (V2), target_all_null (V3),
    target_valid_ratio (V4), target_not_numeric (V5), no_features (V6),
    few_rows (V7), high_cardinality per string feature (V8). Nulls do not count
    as a distinct value; the cardinality ratio divides by all rows.
    """
    spark = df.sparkSession
    has_target = target in df.columns
    features = [c for c in df.columns if c != target]
    cats = categorical_columns(df, exclude=(target,))
    aggs = [F.count(F.lit(1)).alias("n")]
    if has_target:
        t = col(target)
        aggs.append(F.count(t).alias("t_nn"))
        if role_of(df.schema[target].dataType) == "numeric":
            aggs.append(F.lit(0).cast("long").alias("t_bad"))
        else:
            aggs.append(F.count_if(t.isNotNull() & t.try_cast("double").isNull()).alias("t_bad"))
    if approx_distinct:
        aggs += [F.approx_count_distinct(col(c)).alias(f"d_{i}") for i, c in enumerate(cats)]
    stats = df.agg(*aggs)
    if cats and not approx_distinct:
        # One row on both sides: the distinct counts come from their own narrow shuffle.
        counts = distinct_counts(df, cats).agg(*[
            F.coalesce(F.max(F.when(F.col("column") == c, F.col("distinct"))), F.lit(0)).alias(f"d_{i}")
            for i, c in enumerate(cats)])
        both = stats.unionByName(counts, allowMissingColumns=True)
        stats = both.agg(*[F.max(c).alias(c) for c in both.columns])

    n = F.col("n").cast("double")
    rows = [
        _row(F.lit("empty_table"), F.lit("error"), F.lit(None).cast("string"), n,
             F.col("n") == 0, F.lit(M.EMPTY_TABLE)),
        _row(F.lit("target_missing"), F.lit("error"), F.lit(target),
                 F.lit(None).cast("double"), F.lit(not has_target),
                 F.lit(M.TARGET_NOT_FOUND.format(target=target))),
    ]
    if has_target:
        ratio = F.try_divide(F.col("t_nn").cast("double"), n)
        rows += [
            _row(F.lit("target_all_null"), F.lit("error"), F.lit(target),
                     F.col("t_nn").cast("double"), F.col("t_nn") == 0,
                     F.lit(M.TARGET_ALL_NULL)),
            _row(F.lit("target_valid_ratio"), F.lit("warning"), F.lit(target), ratio,
                     F.coalesce(ratio < MIN_VALID_TARGET_RATIO, F.lit(False)),
                     F.format_string(M.TARGET_LOW_VALID,
                                     F.coalesce(ratio, F.lit(0.0)) * 100)),
            _row(F.lit("target_not_numeric"), F.lit("error"), F.lit(target),
                     F.col("t_bad").cast("double"), F.col("t_bad") > 0,
                     F.lit(M.TARGET_NOT_NUMERIC.format(target=target))),
        ]
    rows += [
        _row(F.lit("no_features"), F.lit("error"), F.lit(None).cast("string"),
                 F.lit(float(len(features))), F.lit(len(features) == 0),
                 F.lit(M.NO_FEATURES)),
        _row(F.lit("few_rows"), F.lit("warning"), F.lit(None).cast("string"), n,
                 F.col("n") < MIN_ROWS,
                 F.format_string(M.FEW_ROWS,
                                 F.col("n"))),
    ]
    for i, c in enumerate(cats):
        r = F.try_divide(F.col(f"d_{i}").cast("double"), n)
        rows.append(_row(
            F.lit("high_cardinality"), F.lit("warning"), F.lit(c), r,
            F.coalesce(r > HIGH_CARDINALITY_RATIO, F.lit(False)),
            F.format_string(M.HIGH_CARDINALITY.format(column=c),
                            F.coalesce(r, F.lit(0.0)) * 100)))
    out = stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    names = ["check", "severity", "column_name", "value", "failed", "message"]
    return out.toDF(*names)


def _row(check, severity, column, value, failed, message):
    return F.struct(check.alias("check"), severity.alias("severity"),
                    column.cast("string").alias("column_name"), value.cast("double").alias("value"),
                    failed.cast("boolean").alias("failed"), message.alias("message"))


def is_valid(report: DataFrame) -> bool:
    """True when no error-severity check failed (one tiny action)."""
    return report.where((F.col("severity") == "error") & F.col("failed")).isEmpty()


def validate_scoring_input(df: DataFrame, feature_names: list[str]) -> DataFrame:
    """V9: missing required features -> error; extra columns -> warning;
    a feature that is entirely null -> error. Rows ``(check, severity,
    column_name, failed)``; null counts come from one aggregation."""
    spark = df.sparkSession
    missing = [f for f in feature_names if f not in df.columns]
    extra = [c for c in df.columns if c not in feature_names]
    present = [f for f in feature_names if f in df.columns]
    rows = [("missing_feature", "error", c, True) for c in missing]
    rows += [("extra_feature", "warning", c, True) for c in extra]
    schema = "check string, severity string, column_name string, failed boolean"
    static = spark.createDataFrame(rows, schema)
    if not present:
        return static
    nn = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(present)])
    null_rows = nn.select(F.explode(F.array(*[
        F.struct(F.lit("all_null_feature").alias("check"), F.lit("error").alias("severity"),
                 F.lit(c).alias("column_name"), (F.col(f"c{i}") == 0).alias("failed"))
        for i, c in enumerate(present)])).alias("r")).select("r.*")
    return static.unionByName(null_rows)


def missing_features(df: DataFrame, feature_names: list[str]) -> list[str]:
    """Required features absent from a batch (schema only)."""
    return [f for f in feature_names if f not in df.columns]


def coerce_target(df: DataFrame, target: str) -> DataFrame:
    """Target as DOUBLE (``try_cast`` for numeric strings, NaN -> NULL)."""
    t = col(target)
    t = t.try_cast("double") if isinstance(df.schema[target].dataType, StringType) else t.cast("double")
    return df.withColumn(target, F.nanvl(t, F.lit(None).cast("double")))
