"""Every public operator on columns named ``a.b`` and ``c d``, with NaN and a null third."""

import pytest
from pyspark.sql import functions as F

from regressa.operators import clean, drift, encode, profile, validate
from regressa.operators.ranking import exact_quantiles
from regressa.plans import models
from regressa.config import RegressionParams


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(90).select(
        F.col("id").alias("key.id"),
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 10 == 1, float("nan"))
        .otherwise(F.col("id") * 1.5).alias("a.b"),
        F.when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("v"), F.col("id") % 4)).alias("c d"),
        (F.col("id") * 2.0 + 1).alias("y`t")).cache()


OPERATORS = {
    "null_counts": lambda d: profile.null_counts(d),
    "duplicate_row_count": lambda d: profile.duplicate_row_count(d),
    "table_summary": lambda d: profile.table_summary(d),
    "memory_usage": lambda d: profile.memory_usage(d),
    "describe": lambda d: profile.describe(d),
    "describe_approx": lambda d: profile.describe(d, approx=True),
    "distinct_counts": lambda d: profile.distinct_counts(d),
    "column_profile": lambda d: profile.column_profile(d),
    "column_profile_approx": lambda d: profile.column_profile(d, approx_distinct=True),
    "missing_report": lambda d: profile.missing_report(d),
    "correlation_matrix": lambda d: profile.correlation_matrix(d),
    "target_correlation": lambda d: profile.target_correlation(d, "y`t"),
    "numeric_domain": lambda d: profile.numeric_domain(d),
    "categorical_domain": lambda d: profile.categorical_domain(d),
    "validate": lambda d: validate.validate(d, "y`t"),
    "validate_scoring_input": lambda d: validate.validate_scoring_input(d, ["a.b", "c d", "e"]),
    "coerce_target": lambda d: validate.coerce_target(d, "a.b"),
    "fit_impute": lambda d: clean.fit_impute(d, "y`t", spare=True).transform(d),
    "fill_mean": lambda d: clean.fit_fill(d, "mean").transform(d),
    "fill_median": lambda d: clean.fit_fill(d, "median").transform(d),
    "fill_mode": lambda d: clean.fit_fill(d, "mode").transform(d),
    "ffill": lambda d: clean.fill_ordered(d, ["a.b"], ["key.id"], ["c d"]),
    "bfill": lambda d: clean.fill_ordered(d, ["a.b", "c d"], ["key.id"], direction="backward"),
    "drop_duplicates": lambda d: clean.drop_duplicates(d),
    "drop_duplicates_subset": lambda d: clean.drop_duplicates(d, ["c d"], ["key.id"]),
    "remove_outliers": lambda d: clean.remove_outliers(d, clean.fit_outlier_bounds(d)),
    "capped_sample": lambda d: clean.capped_sample(d, ["key.id", "c d"], 7),
    "one_hot": lambda d: encode.fit_one_hot(d, ["c d"]).transform(d),
    "one_hot_vector": lambda d: encode.fit_one_hot_vector(d, ["c d"]).transform(d),
    "label": lambda d: encode.fit_label(d, ["c d"]).transform(d),
    "target": lambda d: encode.fit_target(d, ["c d"], "y`t").transform(d),
    "scale": lambda d: encode.fit_scaler(d, ["a.b", "y`t"]).transform(d),
    "align": lambda d: encode.align_columns(d, ["a.b", "new.x"]),
    "split": lambda d: encode.exact_split(d, ["key.id"], 0.2, 42, folds=3),
    "quantiles": lambda d: exact_quantiles(d, ["a.b", "y`t"], [0.25, 0.5]),
    "detect_drift": lambda d: drift.detect_drift(d, d),
    "mean_shift": lambda d: drift.mean_shift_drift(d, d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_takes_odd_names(df, name):
    assert len(OPERATORS[name](df).collect()) > 0


def test_values_behind_odd_names(df):
    assert {r["column"]: r["null_count"] for r in profile.null_counts(df).collect()}["a.b"] == 36
    assert profile.table_summary(df).first()["total_missing"] == 36 + 30
    d = {r["column"]: r for r in profile.describe(df).collect()}
    assert d["a.b"]["count"] == 54 and d["y`t"]["q50"] == 90.0


def test_preprocessor_on_odd_names(df):
    for how in ("onehot", "label", "target"):
        pre = models.fit_preprocessor(df, "y`t", RegressionParams(encode_categorical=how), ["a.b", "c d"])
        out = pre.transform(df, keep=["key.id"])
        assert out.count() == 90 and "key.id" in out.columns
