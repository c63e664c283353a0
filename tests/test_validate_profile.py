import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regressa.operators import profile, validate


def _checks(report):
    return {(r["check"], r["column_name"]): r for r in report.collect()}


def test_validate_flags(spark):
    rows = [(float(i) if i % 3 else None, f"id{i}", "a" if i % 2 else "b", str(i))
            for i in range(40)]
    df = spark.createDataFrame(rows, "y double, name string, cat string, ystr string")
    rep = _checks(validate.validate(df, "y"))
    assert rep[("few_rows", None)]["failed"]
    assert rep[("high_cardinality", "name")]["failed"]
    assert not rep[("high_cardinality", "cat")]["failed"]
    assert not rep[("target_valid_ratio", "y")]["failed"]
    assert validate.is_valid(validate.validate(df, "y"))
    # a numeric string target converts; a non-numeric one is an error
    assert validate.is_valid(validate.validate(df, "ystr"))
    assert not validate.is_valid(validate.validate(df, "name"))
    missing = _checks(validate.validate(df, "nope"))
    assert missing[("target_missing", "nope")]["failed"]


def test_validate_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "y double, x double")
    assert not validate.is_valid(validate.validate(empty, "y"))
    nulls = spark.createDataFrame([(None, 1.0)] * 5, "y double, x double")
    rep = _checks(validate.validate(nulls, "y"))
    assert rep[("target_all_null", "y")]["failed"]
    assert rep[("target_valid_ratio", "y")]["failed"]


def test_scoring_input_checks(spark):
    df = spark.createDataFrame([(1.0, None, 3.0)], "a double, b double, extra double")
    rep = {(r["check"], r["column_name"]): r["failed"] for r in
           validate.validate_scoring_input(df, ["a", "b", "c"]).collect()}
    assert rep[("missing_feature", "c")]
    assert rep[("extra_feature", "extra")]
    assert rep[("all_null_feature", "b")]
    assert not rep[("all_null_feature", "a")]


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=301), "b": rng.integers(0, 9, 301).astype(float)})
    pdf.loc[::10, "a"] = np.nan
    got = profile.describe(spark.createDataFrame(pdf)).toPandas().set_index("column")
    exp = pdf.describe().T
    for c in ["a", "b"]:
        for s_got, s_exp in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
            assert abs(got.loc[c, s_got] - exp.loc[c, s_exp]) < 1e-9


def test_summary_duplicates_and_missing(spark):
    rows = [(1, "a", None), (1, "a", None), (2, "b", 1.0), (3, None, 2.0), (2, "b", 1.0)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    s = profile.table_summary(df).first()
    assert s["n_rows"] == 5 and s["duplicate_rows"] == 2 and s["total_missing"] == 3
    assert (s["n_numeric"], s["n_categorical"]) == (2, 1)
    mr = profile.missing_report(df).collect()
    assert [(r["column"], r["missing_count"], r["missing_pct"]) for r in mr] == \
        [("x", 2, 40.0), ("s", 1, 20.0)]


def test_correlation_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf["c"] = pdf.a * 2 + rng.normal(size=200) * 0.1
    pdf.loc[::9, "b"] = np.nan
    got = {(r["column_a"], r["column_b"]): r["corr"]
           for r in profile.correlation_matrix(spark.createDataFrame(pdf)).collect()}
    exp = pdf.corr()
    for (a, b), v in got.items():
        assert abs(v - exp.loc[a, b]) < 1e-9


def test_head_and_domains(spark):
    df = spark.range(500).withColumn("c", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    assert [r["id"] for r in profile.head(df, ["id"], 3).collect()] == [0, 1, 2]
    dom = {r["value"]: r["count"] for r in profile.categorical_domain(df, ["c"]).collect()}
    assert dom == {"x": 250, "y": 250}


def test_correlation_of_odd_columns_matches_pandas(spark):
    """Large offsets, missing and infinite values, constant columns (an error before)."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "far": 1e6 + rng.normal(size=300), "k": np.full(300, 0.1)})
    pdf["b"] = pdf.a * 2 + rng.normal(size=300)
    pdf.loc[::3, "b"] = np.nan
    pdf["once"] = np.where(np.arange(300) == 7, 1.0, np.nan)
    pdf["part"] = np.where(np.arange(300) % 3 == 0, rng.normal(size=300), 4.0)  # constant where b is known
    pdf["inf"] = np.where(np.arange(300) == 5, np.inf, pdf.a)
    got = {(r["column_a"], r["column_b"]): r["corr"]
           for r in profile.correlation_matrix(spark.createDataFrame(pdf).repartition(4)).collect()}
    want = pdf.drop(columns="inf").corr()
    assert len(got) == 42
    for (x, y), r in got.items():
        if "inf" in (x, y):
            assert r is None or np.isnan(r)
        elif np.isnan(want.loc[x, y]) or (x, y) in (("b", "part"), ("part", "b")):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[x, y], abs=1e-9), (x, y)
