"""Cases off the happy path: odd names and types, nulls at scoring, wide inputs, large tails."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regressa.config import RegressionParams
from regressa.functions.stats import chi2_sf_scalar
from regressa.operators import diagnostics, drift, metrics
from regressa.plans import models, tuning
from regressa.sources import files


def frame(spark, n=60):
    rows = [(i, float(i % 7), ["St. Louis", "a`b", "x y"][i % 3], i % 2 == 0, float(i) / 3,
             2.0 * (i % 7) + (i % 3) + (i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y double, city string, flag boolean, fold double, price double")


@pytest.mark.parametrize("encode", ["onehot", "label", "target"])
def test_odd_names_booleans_and_nulls_at_scoring(spark, encode):
    df = frame(spark)
    params = RegressionParams(encode_categorical=encode)
    feats = ["y", "city", "flag", "fold"]
    pre = models.fit_preprocessor(df, "price", params, feats)
    train = pre.transform(df, keep=["id"])
    fit = models.fit_model("linear", train, pre.feature_names)
    out = fit.predict(train)
    assert out.count() == 60
    if encode != "label":
        assert metrics.metrics_dict(out)["test_r2"] > 0.99
    # complete in training, null, NaN or unseen in the batch
    batch = spark.createDataFrame([(1, None, "St. Louis", None, float("nan")), (2, 3.0, None, True, 1.0),
                                   (3, 2.0, "nowhere", False, None)],
                                  "id long, y double, city string, flag boolean, fold double")
    got = fit.predict(pre.transform(batch, keep=["id"])).collect()
    assert len(got) == 3 and all(r.prediction is not None and math.isfinite(r.prediction) for r in got)


def test_dates_are_an_error(spark):
    df = frame(spark).withColumn("day", F.current_date())
    with pytest.raises(ValueError, match="day"):
        models.fit_preprocessor(df, "price", RegressionParams(), ["y", "day"])


@pytest.mark.parametrize("name", ["linear", "ridge", "lasso", "elastic_net"])
def test_wide_solver_gives_the_same_coefficients(spark, name, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 4))
    y = x @ [3.0, -2.0, 1.0, 0.5] + 0.3 * rng.standard_normal(80)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)],
                               "a double, b double, c double, d double, y double")
    hp = {"alpha": 0.2}
    normal = models.fit_model(name, df, list("abcd"), hp).model.coefficients.toArray()
    monkeypatch.setattr(models, "NORMAL_SOLVER_MAX_FEATURES", 2)
    wide = models.fit_model(name, df, list("abcd"), hp).model.coefficients.toArray()
    assert np.allclose(normal, wide, atol=2e-3)


def test_chi_square_tail():
    assert chi2_sf_scalar(200_000.0, 1_999) == 0.0
    assert chi2_sf_scalar(10.0, 4) == pytest.approx(math.exp(-5) * 6, rel=1e-12)
    assert chi2_sf_scalar(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    for dof in (10 ** 4, 10 ** 6):  # the median is near dof - 2/3
        assert chi2_sf_scalar(dof - 2 / 3, dof) == pytest.approx(0.5, abs=1e-4)


def test_many_vanished_categories_are_drift(spark):
    ref = spark.range(20_000).select((F.col("id") % 2_000).cast("string").alias("c"))
    new = spark.range(20_000).select((F.col("id") % 1_000).cast("string").alias("c"))
    r = drift.chi_square_drift(ref, new).first()
    assert r.drifted and r.p_value == 0.0 and r.dof == 1_999


def test_nan_prediction_counts_as_failed(spark):
    p = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "k int, prediction double")
    r = drift.monitor_batch(p, None, ["k"]).first()
    assert (r.successful_predictions, r.failed_predictions) == (1, 2)


def test_random_search_evaluates_fifty_different_candidates():
    for name in ("random_forest", "gradient_boosting"):
        got = tuning.candidates(name, "random", 50)
        seen = {tuple(sorted((k, str(v)) for k, v in c.items() if k not in tuning.UNSUPPORTED.get(name, ())))
                for c in got}
        assert len(got) == len(seen) == 50


def test_search_minimises_plain_errors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(90)
    df = spark.createDataFrame([(float(a), float(3 * a + 0.01 * b), i % 3) for i, (a, b) in
                                enumerate(zip(x, rng.standard_normal(90)))],
                               "a double, y double, fold int")
    for metric in ("rmse", "neg_root_mean_squared_error", "explained_variance"):
        best, _, _ = tuning.search("ridge", df, ["a"], 3, "grid", metric=metric)
        assert best == {"alpha": 0.1}


def test_shapiro_beyond_the_calibrated_size(spark):
    df = spark.range(6_000).select("id", F.randn(3).alias("y"), F.lit(0.0).alias("prediction"))
    r = diagnostics.shapiro_wilk(df, ["id"]).first()
    assert r.extrapolated and r.statistic > 0.99 and 0 <= r.p_value <= 1


def test_forest_does_not_depend_on_input_partitions(spark):
    df = spark.range(400).select((F.col("id") % 17).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("b"),
                                 ((F.col("id") * 37) % 101).cast("double").alias("y"))
    got = [models.fit_model("random_forest", df.repartition(n), ["a", "b"], {"n_estimators": 5})
           .importances()[0] for n in (2, 7)]
    assert np.allclose(*got, atol=1e-6)


def test_svr_driver_rows_do_not_grow_with_partitions(spark):
    parts = spark.range(400, numPartitions=200).mapInPandas(
        lambda it: ({"s": [[1.0, float(len(p))]]} and __import__("pandas").DataFrame(
            {"s": [[1.0, float(len(p))]]}) for p in it), "s array<double>")
    assert models._summed(parts, "s", 2).tolist() == [200.0, 400.0]


def test_csv_as_written_by_spreadsheets(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b,n,f,d\n1.5,"say ""hi"", ok",7,true,2024-01-02\n'
                                     'NA,"x\ny",NULL,False,N/A\n')
    df = files.read_csv(spark, str(tmp_path / "in.csv"), multi_line=True)
    assert dict(df.dtypes) == {"a": "double", "b": "string", "n": "int", "f": "boolean", "d": "string"}
    assert [tuple(r) for r in df.collect()] == [(1.5, 'say "hi", ok', 7, True, "2024-01-02"),
                                                (None, "x\ny", None, False, None)]
    files.write_predictions(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), multi_line=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
