import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from regressa.plans import boosting, models
from regressa.sources import model_store

NAMES = ["a", "b.c", "d"]


def table(spark, n, seed=1):
    """Few values, many values and a feature that is mostly zero; rows and labels come twice."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 7, n), rng.normal(size=n).round(3), rng.integers(1, 5, n) * (rng.random(n) < 0.02)])
    y = x[:, 0] * x[:, 1] + 3 * x[:, 2] + rng.normal(size=n)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, `b.c` double, d double, y double")
    return df.unionByName(df.where("id % 3 = 0").withColumn("id", F.col("id") + n))


def on_rows(df, hp, seed=42):
    """MLlib on the rows themselves."""
    data = models.assemble(models.dealt(df, NAMES), NAMES)
    return models.build_estimator("gradient_boosting", hp, {"n": 1}, seed).fit(data)


def predictions(df):
    return {r["id"]: r["prediction"] for r in df.select("id", "prediction").collect()}


@pytest.mark.parametrize("n, hp", [(12_000, {"n_estimators": 3}), (12_000, {"n_estimators": 2, "max_bins": 9, "max_depth": 4}),
                                   (900, {"n_estimators": 3, "learning_rate": 0.3}), (20, {"n_estimators": 2})])
def test_the_trees_that_mllib_grows_on_the_rows(spark, n, hp):
    df = table(spark, n).cache()
    want = on_rows(df, hp)
    fit = models.fit_model("gradient_boosting", df, NAMES, hp)
    # Values between the rows' own ones, and beyond them, tell thresholds apart.
    new = df.limit(300).withColumns({"a": F.col("a") + 0.5, "d": F.col("d") - 0.5}).withColumn("b.c", F.col("`b.c`") * 1.5 + 0.0005)
    for rows in (df, new):
        a = predictions(fit.predict(rows))
        b = predictions(want.transform(models.assemble(rows, NAMES)))
        assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in b)
    assert fit.importances()[0] == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
    df.unpersist()


def test_stages_read_a_row_for_each_combination_of_bins(spark, monkeypatch):
    """Every stage read every row."""
    seen = []
    fit = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data: (seen.append(data.count()), fit(self, data))[1])
    for n in (1_000, 4_000):
        models.fit_model("gradient_boosting", table(spark, n).withColumn("b.c", F.round("`b.c`")), NAMES, {"n_estimators": 2})
    assert max(seen) < 400


def test_thresholds():
    def cuts(values, counts, expected, splits):
        return boosting.thresholds(np.array(values, float), np.array(counts), expected, splits).tolist()

    assert cuts([3, 1, 2], [1, 1, 1], 3, 31) == [1.5, 2.5]
    assert cuts([-1, 2], [3, 2], 9, 31) == [-0.5, 1.0]  # four rows hold zero
    assert cuts([5], [4], 4, 31) == []
    assert cuts(range(1, 9), [1] * 8, 8, 3) == [2.5, 4.5, 6.5]
    assert cuts([1, 2, 3, 4, 5], [1, 90, 3, 3, 3], 100, 3) == [1.5, 2.5, 3.5]  # a heavy value spans several shares


def test_missing_features_when_scoring(spark):
    df = table(spark, 800)
    hp = {"n_estimators": 2}
    fit, want = models.fit_model("gradient_boosting", df, NAMES, hp), on_rows(df, hp)
    new = df.limit(60).withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a"))).withColumn(
        "d", F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.lit(float("inf"))))
    a, b = predictions(fit.predict(new)), predictions(want.transform(models.assemble(new, NAMES)))
    assert len(a) == 60 and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in b)


def test_assembled_rows_and_the_store(spark, tmp_path):
    df = table(spark, 800)
    hp = {"n_estimators": 2}
    wide = models.assemble(df, NAMES)
    fit, again = (models.fit_model("gradient_boosting", d, NAMES, hp) for d in (df, wide))
    a = predictions(fit.predict(df))
    assert predictions(again.predict(wide)) == pytest.approx(a, abs=1e-9)
    assert again.predict(wide).columns == [*wide.columns, "prediction"]
    pre = models.Preprocessor("y", NAMES, None, False, None, None, NAMES)
    model_store.save_model(f"{tmp_path}/m", spark, pre, fit)
    _, loaded, meta = model_store.load_model(f"{tmp_path}/m", spark)
    assert meta["model_class"] == "BoostedModel" and predictions(loaded.predict(df)) == a


def test_what_mllib_takes_itself(spark):
    """Stages that draw rows see the rows; values that are not finite are refused as before."""
    df = table(spark, 300)
    fit = models.fit_model("gradient_boosting", df, NAMES, {"n_estimators": 2, "subsample": 0.8})
    assert isinstance(fit.model, GBTRegressionModel)
    for odd in (df.withColumn("a", F.lit(float("nan"))), df.withColumn("y", F.lit(float("inf"))), df.where("id < 0")):
        with pytest.raises(Exception):  # noqa: B017
            models.fit_model("gradient_boosting", odd, NAMES, {"n_estimators": 2})
    flat = df.withColumns({"a": F.lit(0.0), "d": F.lit(2.0)}).withColumn("b.c", F.lit(-1.0))
    one = models.fit_model("gradient_boosting", flat, NAMES, {"n_estimators": 2})
    mean = flat.agg(F.avg("y")).first()[0]
    assert all(v == pytest.approx(mean) for v in predictions(one.predict(flat)).values())
