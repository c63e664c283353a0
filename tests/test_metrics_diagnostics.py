import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regressa import messages as M
from regressa.functions.stats import chi2_sf_scalar, norm_ppf_sql
from regressa.operators import chartdata, diagnostics, metrics


def _pred(spark, n=500, seed=11, zero=False):
    rng = np.random.default_rng(seed)
    y = rng.normal(10, 3, n)
    p = y + rng.normal(0, 1 + np.abs(y) / 10, n)
    if zero:
        y[0] = 0.0
    pdf = pd.DataFrame({"k": np.arange(n), "y": y, "prediction": p})
    return pdf, spark.createDataFrame(pdf)


def test_metrics_match_numpy(spark):
    pdf, df = _pred(spark)
    r = metrics.regression_metrics(df).first()
    err = pdf.y - pdf.prediction
    assert math.isclose(r["r2"], 1 - (err ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum())
    assert math.isclose(r["rmse"], math.sqrt((err ** 2).mean()))
    assert math.isclose(r["mae"], err.abs().mean())
    assert math.isclose(r["mape"], (err / pdf.y).abs().mean() * 100)
    _, dz = _pred(spark, zero=True)
    assert metrics.regression_metrics(dz).first()["mape"] == float("inf")


def test_constant_target_r2(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, prediction double")
    assert metrics.regression_metrics(df).first()["r2"] == 1.0


def test_residual_moments_match_pandas(spark):
    pdf, df = _pred(spark)
    r = diagnostics.residual_stats(df).first()
    res = pdf.y - pdf.prediction
    assert math.isclose(r["skewness"], res.skew(), rel_tol=1e-9)
    assert math.isclose(r["kurtosis"], res.kurt(), rel_tol=1e-9)
    assert math.isclose(r["std"], res.std(), rel_tol=1e-12)
    c = diagnostics.residual_cards(df).first()
    assert math.isclose(c["std"], res.std(ddof=0), rel_tol=1e-12)


def test_heteroscedasticity_groups(spark):
    pdf, df = _pred(spark, n=300)
    rows = {r["group"]: r for r in diagnostics.heteroscedasticity(df, ["k"]).collect()}
    srt = pdf.sort_values(["prediction", "k"])
    res = (srt.y - srt.prediction).to_numpy()
    exp = [res[:100].var(ddof=1), res[100:200].var(ddof=1), res[200:].var(ddof=1)]
    for g in range(3):
        assert math.isclose(rows[g]["variance"], exp[g], rel_tol=1e-9)
    assert math.isclose(rows[0]["ratio"], max(exp) / min(exp), rel_tol=1e-9)


def test_breakdown_matches_qcut(spark):
    pdf, df = _pred(spark, n=401)
    got = {r["range"]: r["count"] for r in diagnostics.performance_breakdown(df).collect()}
    bins = pd.qcut(pdf.prediction, 4, labels=["Low", "Medium-Low", "Medium-High", "High"])
    assert got == bins.value_counts().to_dict()


def test_histogram_and_qq(spark):
    pdf, df = _pred(spark, n=200)
    h = chartdata.residual_histogram(df).collect()
    assert sum(r["count"] for r in h) == 200 and max(r["bin"] for r in h) == 30
    counts, _ = np.histogram(pdf.y - pdf.prediction, bins=30)
    assert sorted((r["bin"], r["count"]) for r in h) == \
        [(i + 1, int(c)) for i, c in enumerate(counts) if c]
    qq = chartdata.qq_points(df, ["k"]).orderBy("i").toPandas()
    theo = [NormalDist().inv_cdf(p) for p in np.linspace(0.01, 0.99, 200)]
    assert np.allclose(qq.theoretical, theo, atol=1e-12)
    assert np.allclose(qq["sample"], np.sort(pdf.y - pdf.prediction))


def test_norm_ppf_against_stdlib(spark):
    ps = [1e-10, 1e-5, 0.01, 0.2, 0.5, 0.7, 0.975, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(F.expr(norm_ppf_sql("p"))).collect()]
    for p, g in zip(ps, got):
        assert abs(g - NormalDist().inv_cdf(p)) < 1e-12


def test_shapiro_normal_vs_skewed(spark):
    rng = np.random.default_rng(2)
    for x, normal in [(rng.normal(size=300), True), (rng.exponential(size=300), False)]:
        df = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(x)],
                                   "k long, y double, prediction double")
        r = diagnostics.shapiro_wilk(df, ["k"]).first()
        assert 0 < r["statistic"] <= 1 and r["is_normal"] == normal


def test_chi2_sf_known_values():
    assert abs(chi2_sf_scalar(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(chi2_sf_scalar(5.991464547107979, 2) - 0.05) < 1e-12
    assert abs(chi2_sf_scalar(9.487729036781154, 4) - 0.05) < 1e-12
    assert abs(chi2_sf_scalar(11.070497693516351, 5) - 0.05) < 1e-12


def test_importance_and_recommendations(spark):
    fi = diagnostics.feature_importance(spark, ["a", "b"], [0.2, 0.8], "Tree")
    assert [r["feature"] for r in fi.collect()] == ["b", "a"]
    assert diagnostics.feature_importance(spark, ["a"], None, None).count() == 0
    comp = metrics.comparison_table(spark, [
        {"Model": "ridge", "cv_mean": 0.6, "cv_std": 0.01, "test_r2": 0.65, "test_rmse": 1.0,
         "test_mae": 0.5, "test_mape": 3.0},
        {"Model": "linear", "cv_mean": 0.5, "cv_std": 0.01, "test_r2": 0.4, "test_rmse": 2.0,
         "test_mae": 1.5, "test_mape": 4.0}])
    assert comp.first()["Model"] == "ridge"
    recs = [r["title"] for r in diagnostics.recommendations(comp).collect()]
    assert recs == [M.REC_MODERATE_R2[0], M.REC_REGULARIZED[0]]
    cx = {r["Model"]: r["complexity"] for r in chartdata.complexity_vs_r2(comp).collect()}
    assert cx == {"ridge": 2, "linear": 1}


def test_breakdown_rejects_duplicate_edges(spark):
    import pytest

    df = spark.createDataFrame([(float(i), 5.0) for i in range(40)], "y double, prediction double")
    with pytest.raises(ValueError):
        diagnostics.performance_breakdown(df)
    # constant predictions still give residual statistics and a one-bin histogram
    assert chartdata.prediction_range(df).first()["min"] == 5.0


@pytest.mark.parametrize("predictions", [[1.0, 1, 1, 2, 3, 4], [1.0, 2, 3, 4, 4, 4], [2.0] * 5])
def test_bins_with_equal_edges_are_an_error(spark, predictions):
    df = spark.createDataFrame([(float(i), float(p)) for i, p in enumerate(predictions)],
                               "y double, prediction double")
    with pytest.raises(ValueError):
        diagnostics.performance_breakdown(df)


def test_permutation_importance_by_hand(spark):
    """Each row meets the foreign value that the seeded order gives it; losses by plain sums."""
    import hashlib

    import numpy as np
    from pyspark.sql import functions as F

    from regressa.operators import clean, diagnostics

    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(3 * a - 0.5 * b)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame([*rows, (99, 1.0, 1.0, None)], "k long, `a.a` double, b double, y double")

    def predict(f):
        return f.withColumn("prediction", 3 * F.col("`a.a`") - 0.5 * F.col("b"))

    got = diagnostics.permutation_importance(df.repartition(3), ["k"], ["a.a", "b"], predict)
    order = sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:42".encode()).hexdigest())
    y, n = np.array([r[3] for r in order]), len(order)
    for name, at, factor in (("a.a", 1, 3.0), ("b", 2, -0.5)):
        shift = diagnostics.permutation_shift(name, n, 42)
        x = np.array([r[at] for r in order])
        want = ((factor * (np.roll(x, -shift) - x)) ** 2).mean() / y.var()
        assert abs({r["feature"]: r["importance"] for r in got.collect()}[name] - want) < 1e-9
    assert clean.select_features_by_importance(got, 1) == ["a.a"]
    assert diagnostics.permutation_importance(df.limit(1), ["k"], ["b"], predict).count() == 0
