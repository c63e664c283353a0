import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from regressa.config import RegressionParams
from regressa.operators import encode, metrics, score
from regressa.plans import models, tuning, workflow
from regressa.sources import model_store, synthetic


def _synthetic(spark, n=600):
    return synthetic.regression_dataset(spark, n_samples=n, n_features=4, noise=0.1,
                                        random_state=42)


def test_linear_recovers_coefficients(spark):
    import random

    df = _synthetic(spark)
    rng = random.Random(42)
    coefs = [rng.gauss(0, 1) for _ in range(4)]
    feats = [f"feature_{i + 1}" for i in range(4)]
    data = df.select(*feats, F.col("target").alias("y"))
    fit = models.fit_model("linear", data, feats)
    assert np.allclose(fit.model.coefficients.toArray(), coefs, atol=0.03)


def test_ridge_matches_closed_form(spark):
    df = _synthetic(spark, 300)
    feats = [f"feature_{i + 1}" for i in range(4)]
    pdf = df.select(*feats, "target").toPandas()
    data = df.select(*feats, F.col("target").alias("y"))
    fit = models.fit_model("ridge", data, feats, {"alpha": 10.0})
    x = pdf[feats].to_numpy()
    x = x - x.mean(0)
    y = pdf.target.to_numpy() - pdf.target.mean()
    exp = np.linalg.solve(x.T @ x + 10.0 * np.eye(4), x.T @ y)
    assert np.allclose(fit.model.coefficients.toArray(), exp, rtol=1e-8, atol=1e-10)


def test_trees_and_svr_fit(spark):
    df = _synthetic(spark, 400)
    feats = [f"feature_{i + 1}" for i in range(4)]
    data = df.select(*feats, F.col("target").alias("y")).cache()
    for name, hp, floor in [("random_forest", {"n_estimators": 20}, 0.5),
                            ("gradient_boosting", {"n_estimators": 20}, 0.5),
                            ("svr", {"kernel": "linear", "C": 10.0, "iterations": 80}, 0.5)]:
        fit = models.fit_model(name, data, feats, hp)
        r2 = metrics.regression_metrics(fit.predict(data)).first()["r2"]
        assert r2 > floor, (name, r2)


def test_tuning_candidates():
    grid = tuning.candidates("ridge", "grid")
    assert [c["alpha"] for c in grid] == [0.1, 1.0, 10.0, 100.0, 1000.0]
    rnd = tuning.candidates("random_forest", "random", 50, 42)
    assert 0 < len(rnd) <= 50
    assert tuning.candidates("linear") == []
    assert tuning.accept(0.5, 0.5015) and not tuning.accept(0.5, 0.5005)


def test_workflow_end_to_end_and_scoring(spark):
    """The reference's self-test shape: 500 synthetic rows, linear + ridge +
    random forest with tuning; then package, reload and score."""
    df = synthetic.regression_dataset(spark, n_samples=500, random_state=42)
    params = RegressionParams(models_to_include=("linear", "ridge", "random_forest"),
                              hyperparameter_tuning=True, tuning_method="grid", cv_folds=3)
    out = tempfile.mkdtemp(prefix="regressa-pkg-")
    res = workflow.run_workflow(df, "target", params, key_cols=["id"], output_dir=out)
    assert res.success and res.best_model is not None
    assert res.comparison.count() == 3 and res.stages.get("package")
    best = res.comparison.first()
    assert best["test_r2"] > 0.9
    pre, fit, meta = model_store.load_model(f"{out}/model", spark)
    assert meta["model_hash"] and meta["target"] == "target"
    batch = df.drop("target").limit(50)
    a = score.score_batch(batch, res.preprocessor, res.best_model, keep=["id"]).orderBy("id")
    b = score.score_batch(batch, pre, fit, keep=["id"]).orderBy("id")
    assert np.allclose([r[1] for r in a.collect()], [r[1] for r in b.collect()])
    # One record keeps its dummy columns (categories come from training)
    rec = df.drop("target").where("id = 3").first().asDict()
    one = score.score_record(spark, rec, pre, fit).first()[0]
    full = [r[1] for r in b.collect() if r[0] == 3]
    assert not full or abs(one - full[0]) < 1e-6
    failed = score.score_validated(batch.drop("feature_1"), pre, fit, keep=["id"])
    assert not failed.success and any("feature_1" in e for e in failed.errors)


def test_quick_analysis_defaults(spark):
    res = workflow.quick_analysis(None, spark=spark)
    assert res.success
    assert sorted(r["Model"] for r in res.comparison.collect()) == \
        ["gradient_boosting", "linear", "random_forest", "ridge"]


def test_prepare_with_each_encoding_and_drop(spark):
    """E6 end to end: every encoding yields numeric features only, fitted on
    the training rows; 'drop' removes rows with gaps instead of filling."""
    from pyspark.sql.types import StringType

    df = synthetic.regression_dataset(spark, n_samples=300, n_features=3, random_state=7)
    df = df.withColumn("feature_1", F.when(F.col("id") % 17 == 0, None)
                       .otherwise(F.col("feature_1")))
    for enc in ("onehot", "label", "target"):
        params = RegressionParams(encode_categorical=enc, cv_folds=3)
        prepared, pre, keys, steps = workflow.prepare(df, "target", params, ["id"])
        assert not any(isinstance(f.dataType, StringType) for f in prepared.schema.fields
                       if f.name in pre.feature_names)
        assert prepared.count() == 300
        assert any("median" in s for s in steps)
    params = RegressionParams(handle_missing="drop", cv_folds=3)
    prepared, pre, _, steps = workflow.prepare(df, "target", params, ["id"])
    assert prepared.count() == 300 - 18 and steps[0] == "Dropped rows with missing values"


def test_registered_forests_grow_without_a_depth_limit(spark, monkeypatch):
    from regressa.plans import forest
    from regressa.plans.queries import QUERIES

    class Fitted(Exception):
        pass

    grown = []

    def fit(data, x, y, width, trees, how, **kwargs):
        grown.append((trees, how.max_depth, how.min_samples_split, how.max_features))
        raise Fitted

    monkeypatch.setattr(forest, "fit_forest", fit)
    for name in ("random_forest_lineitem", "feature_importance_lineitem"):
        with pytest.raises(Fitted):
            QUERIES[name](spark, "/root/testdata/sf0.001")
    assert grown == [(100, None, 2, None)] * 2


def test_columns_beyond_the_one_hot_limit_are_fitted(spark, monkeypatch, tmp_path):
    rows = [(i, f"c{i % 7}", "ab"[i % 2], float(i % 11), 3.0 * (i % 7) ** 2 + i % 2 + 0.5 * (i % 11))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, city string, kind string, x double, t double")
    batch = df.limit(20).unionByName(spark.createDataFrame(
        [(900, "unseen", "a", 1.0, 0.0), (901, None, "b", 2.0, 0.0)], df.schema))
    feats, params = ["city", "kind", "x"], RegressionParams()

    def fitted(name):
        pre = models.fit_preprocessor(df, "t", params, feats)
        fit = models.fit_model(name, pre.transform(df, ["id"]), pre.feature_names,
                               {"n_estimators": 5, "max_depth": 4} if name == "random_forest" else {})
        return pre, fit

    def scored(pre, fit):
        return {r["id"]: r["prediction"] for r in fit.predict(pre.transform(batch, ["id"])).collect()}

    names = ("linear", "ridge", "random_forest")
    narrow = {n: fitted(n) for n in names}
    want = {n: scored(*narrow[n]) for n in ("linear", "ridge")}
    monkeypatch.setattr(encode, "MAX_ONE_HOT_CATEGORIES", 3)
    for n in names:
        pre, fit = fitted(n)
        assert pre.vector_columns() == ["city_onehot"] and "kind_b" in pre.feature_names
        got = scored(pre, fit)
        assert len(got) == 22
        if n in want:
            assert got == pytest.approx(want[n], abs=1e-6)
        imp = dict(zip(pre.position_names(), fit.importances()[0], strict=True))
        assert set(imp) == set(narrow[n][0].feature_names)
        model_store.save_model(f"{tmp_path}/{n}", spark, pre, fit)
        again, model, _ = model_store.load_model(f"{tmp_path}/{n}", spark)
        assert scored(again, model) == pytest.approx(got, abs=1e-9)
    lacking = pre.transform(batch.drop("city"), ["id"])
    assert {r["city_onehot"].numNonzeros() for r in lacking.collect()} == {0}


def test_cosines_and_mapped_rows(spark):
    """The SVR maps few rows at a time with a cosine of its own; far values go to NumPy's."""
    from regressa.plans.models import SvrModel, cosines

    rng = np.random.default_rng(4)
    t = rng.normal(size=(300, 9)) * np.array([0, 1e-9, 1, 3, 10, 50, 1e3, 1e5, 1e6])
    assert np.abs(cosines(t.copy()) - np.cos(t)).max() < 4e-15
    far = np.array([1.0, 1e9, np.inf, np.nan, 0.5])
    with np.errstate(invalid="ignore"):
        assert np.array_equal(cosines(far.copy()), np.cos(far), equal_nan=True)
    m = SvrModel(["a"], "rbf", rng.normal(size=(1, 5)), rng.random(5), rng.normal(size=5), 1.5)
    x = rng.normal(size=(1000, 1))
    assert np.concatenate([z for _, _, z in m._mapped(x)]) == pytest.approx(
        np.sqrt(2 / 5) * np.cos(x @ m.omega + m.phase), abs=1e-14)


def test_svr_steps_read_evenly_dealt_blocks(spark):
    """Rows that lay in one partition were read by one task in every step."""
    from regressa.plans import models

    cores = spark.sparkContext.defaultParallelism
    held = models._evenly(spark.sparkContext.parallelize(range(6 * cores), 1), 6 * cores).glom().map(len).collect()
    assert held == [6] * cores
    large = models._evenly(spark.sparkContext.parallelize([0], 1), (cores + 1) * models.TASK_BLOCKS * models.BLOCK_ROWS)
    assert large.getNumPartitions() == 2 * cores
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=(300, 3)) * 5, np.ones(300)])
    turns = rng.normal(size=(4, 40))
    assert np.abs(2 * models.squared_cosines(x, turns) - 1 - np.cos(2 * np.pi * (x @ turns))).max() < 1e-13
    df = _synthetic(spark, 400).select("feature_1", "feature_2", F.col("target").alias("y")).cache()
    for kernel in ("rbf", "linear"):
        one, many = (models.fit_svr(df.repartition(k), ["feature_1", "feature_2"], kernel=kernel, iterations=15)
                     for k in (1, 7))
        assert one.coef == pytest.approx(many.coef, rel=1e-6) and one.intercept == pytest.approx(many.intercept, rel=1e-6)
