import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from regressa.plans import forest, models
from regressa.plans.forest import Growth, draws, fit_forest, grow, walk


def best_split(x, y, w, how):
    """Plain loops over all features and cuts."""
    best, centre = None, np.average(y, weights=w)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values[:-1], values[1:], strict=True):
            low = x[:, f] <= a
            lw, rw = w[low].sum(), w[~low].sum()
            if min(lw, rw) < how.min_samples_leaf:
                continue
            ls, rs = (w * (y - centre))[low].sum(), (w * (y - centre))[~low].sum()
            score = ls ** 2 / lw + rs ** 2 / rw
            if best is None or score > best[0] + 1e-12:
                best = (score, f, (a + b) / 2)
    return best


def brute(x, y, w, how, rows, depth=0):
    """The prediction for ``rows`` of a tree grown by recursion."""
    if (len(np.unique(y)) > 1 and w.sum() >= how.min_samples_split and depth != how.max_depth
            and (cut := best_split(x, y, w, how))):
        low, to = x[:, cut[1]] <= cut[2], rows[:, cut[1]] <= cut[2]
        out = np.zeros(len(rows))
        out[to] = brute(x[low], y[low], w[low], how, rows[to], depth + 1)
        out[~to] = brute(x[~low], y[~low], w[~low], how, rows[~to], depth + 1)
        return out
    return np.full(len(rows), np.average(y, weights=w))


GROWTHS = [Growth(), Growth(max_depth=2), Growth(min_samples_split=5), Growth(min_samples_split=10),
           Growth(min_samples_leaf=3), Growth(max_depth=4, min_samples_leaf=2, min_samples_split=7)]


@pytest.mark.parametrize("how", GROWTHS)
def test_a_tree_equals_brute_force(how):
    rng = np.random.default_rng(1)
    for trial in range(15):
        n, p = int(rng.integers(1, 70)), int(rng.integers(1, 4))
        x = rng.integers(0, 6, size=(n, p)).astype(float)
        y, w = rng.normal(size=n).round(1), rng.integers(1, 4, size=n).astype(float)
        nodes = grow(x, y, w, how, 0, trial).packed()
        assert np.allclose(walk(x, *nodes[:4]), brute(x, y, w, how, x))


def test_a_limit_on_splits_cuts_the_free_tree():
    """Nodes of the tree without the limit, cut below it, are the tree grown with it."""
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(200, 2)), rng.normal(size=200), np.ones(200)
    free, bound = (grow(x, y, w, Growth(min_samples_split=s), 0, 0).packed() for s in (2, 10))
    stack, seen = [(0, 0)], 0
    while stack:
        a, b = stack.pop()
        seen += 1
        assert free[5][a] == bound[5][b] and free[3][a] == pytest.approx(bound[3][b])
        assert (bound[2][b] >= 0) == (free[2][a] >= 0 and free[5][a] >= 10)
        if bound[2][b] >= 0:
            assert (free[0][a], free[1][a]) == (bound[0][b], bound[1][b])
            stack += [(free[2][a] + i, bound[2][b] + i) for i in (0, 1)]
    assert seen == len(bound[0]) < len(free[0])


def test_draws_are_poisson_and_differ_by_tree():
    mark = np.random.default_rng(3).integers(-2 ** 62, 2 ** 62, 100_000)
    for copies in (1, 7, 1000):
        d = draws(mark, np.full(len(mark), copies), 5)
        assert abs(d.mean() / copies - 1) < 0.02 and abs(d.var() / copies - 1) < 0.04
    one = np.ones(len(mark), int)
    assert abs(np.corrcoef(draws(mark, one, 1), draws(mark, one, 2))[0, 1]) < 0.02


def table(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n).round(2), rng.integers(0, 2, n)])
    y = x[:, 0] * x[:, 1] + 3 * x[:, 2] + rng.normal(size=n) * 0.1
    rows = [(int(i), *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, `b.c` double, d double, y double")


def features():
    return F.array("a", F.col("`b.c`"), "d")


def predictions(df, model):
    return {r["id"]: r["prediction"] for r in model.transform(df, features()).collect()}


def test_the_same_forest_under_any_partitioning_and_scoring(spark, monkeypatch):
    df = table(spark)
    one = fit_forest(df.coalesce(1), features(), F.col("y"), 3, 12, Growth(), batch=5)
    many = fit_forest(df.repartition(7), features(), F.col("y"), 3, 12, Growth(), batch=12)
    assert one.trees == 12 and one.size == many.size
    a, b = predictions(df, one), predictions(df, many)
    assert a == b
    monkeypatch.setattr(forest, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(forest, "SCORE_ROWS", 50)
    joined = predictions(df.repartition(3), one)
    assert joined.keys() == a.keys() and all(joined[i] == pytest.approx(a[i], abs=1e-9) for i in a)


def test_upper_nodes_by_histograms(spark, monkeypatch):
    """With small parts the upper nodes are cut by histograms; the tree stays a full tree."""
    df = table(spark, 900)
    y = {r["id"]: r["y"] for r in df.select("id", "y").collect()}
    whole = fit_forest(df, features(), F.col("y"), 3, 6, Growth())
    small = fit_forest(df.repartition(5), features(), F.col("y"), 3, 6, Growth(), part_cells=180, bins=32)
    parts = small.packed.where("part >= 0").groupBy("tree").count().collect()
    assert all(r["count"] > 5 for r in parts) and small.packed.where("part < 0").count() == 6
    assert small.nodes().where("part >= 0 AND node = 0").agg(F.max("rows")).first()[0] <= 60 * 4

    def error(m):
        return np.mean([(v - y[i]) ** 2 for i, v in predictions(df, m).items()])

    assert error(small) == pytest.approx(error(whole), rel=0.35)
    a = predictions(df, small)
    monkeypatch.setattr(forest, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(forest, "SCORE_ROWS", 20)
    joined = predictions(df, small)
    assert all(joined[i] == pytest.approx(a[i], abs=1e-9) for i in a)


def test_hot_values_and_final_nodes(spark):
    """A third of the rows share all features (their labels differ), a value lies far out, and a
    limit on depth ends nodes that are larger than a part."""
    rows = [(i, 1.0, 1.0, 0.0, float(i % 5)) for i in range(300)]
    rows += [(1000 + i, float(i), 1e6 if i == 3 else 2.0, 0.0, float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, `b.c` double, d double, y double")
    for how in (Growth(), Growth(max_depth=1), Growth(max_depth=3, min_samples_leaf=40)):
        m = fit_forest(df, features(), F.col("y"), 3, 3, how, part_cells=60, bins=8)
        got = predictions(df, m)
        assert len(got) == 900 and abs(np.mean(list(got.values())) - np.mean([r[4] for r in rows])) < 60
    assert got.keys() == {r[0] for r in rows}


def test_small_tables(spark):
    schema = "id long, a double, `b.c` double, d double, y double"
    with pytest.raises(ValueError):
        fit_forest(spark.createDataFrame([(1, 1.0, 1.0, 1.0, None)], schema), features(), F.col("y"), 3, 2, Growth())
    one = spark.createDataFrame([(1, 1.0, float("nan"), None, 5.0)], schema)
    x = forest.feature_array(one, "features", ["a", "b.c", "d"])
    m = fit_forest(one, x, F.col("y"), 3, 1, Growth())
    assert m.transform(one, x).first()["prediction"] == 5.0
    assert m.featureImportances.toArray().tolist() == [0.0, 0.0, 0.0]


def test_importances_are_sums_over_node_rows(spark):
    df = table(spark)
    m = fit_forest(df, features(), F.col("y"), 3, 8, Growth(min_samples_leaf=2))
    nodes = m.nodes().toPandas()
    inner = nodes[nodes.feature.notna()]
    assert (nodes[nodes.feature.isna()].left.isna()).all() and (inner.right == inner.left + 1).all()
    per = inner.groupby(["tree", "feature"]).gain.sum().unstack(fill_value=0.0)
    want = (per.div(per.sum(axis=1), axis=0)).mean().to_numpy()
    assert m.featureImportances.toArray() == pytest.approx(want / want.sum(), abs=1e-12)
    assert m.featureImportances[0] > 0.2 > m.featureImportances[2]


def test_fit_model_uses_it_with_and_without_assembled_features(spark, tmp_path):
    from regressa.sources import model_store

    df = table(spark).withColumn("c1", F.col("`b.c`"))
    names = ["a", "c1", "d"]
    hp = {"n_estimators": 8, "max_features": "sqrt", "min_samples_split": 5}
    fit = models.fit_model("random_forest", df, names, hp)
    assert fit.model.trees == 8 and fit.importances()[1] == "Tree-based Feature Importance"
    wide = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    again = models.fit_model("random_forest", wide, names, hp)
    a = {r["id"]: r["prediction"] for r in fit.predict(df).collect()}
    b = {r["id"]: r["prediction"] for r in again.predict(wide).collect()}
    assert a == b
    pre = models.Preprocessor("y", names, None, False, None, None, names)
    model_store.save_model(f"{tmp_path}/m", spark, pre, fit)
    _, loaded, meta = model_store.load_model(f"{tmp_path}/m", spark)
    assert meta["model_class"] == "ForestModel"
    assert {r["id"]: r["prediction"] for r in loaded.predict(df).collect()} == a


def test_small_trees_fill_the_cores():
    """One-part trees were fitted ten at once, whatever the number of cores."""
    assert forest._batch(100, 1, 12) == 34 and forest._batch(100, 1, 8) == 25
    assert forest._batch(100, 50, 12) == 10 and forest._batch(3, 1, 12) == 3


def test_missing_values_are_never_cut_off():
    """The largest value of a node may be missing: values are compared by rank, and no cut lies before NaN."""
    x = np.array([[1.0], [2.0], [np.nan], [5.0], [np.nan]])
    nodes = grow(x, np.array([1.0, 2.0, 8.0, 3.0, 9.0]), np.ones(5), Growth(), 0, 0).packed()
    assert sorted(t for t in nodes[1] if not np.isnan(t)) == [1.5, 3.5]
    assert walk(x, *nodes[:4]).tolist() == [1.0, 2.0, pytest.approx(20 / 3), pytest.approx(20 / 3), pytest.approx(20 / 3)]


def test_two_batches_run_at_once(spark, monkeypatch):
    """Cores that a batch left idle while its last parts were grown had nothing to do."""
    import threading

    both, fit = threading.Barrier(2), forest._fit_batch

    def met(*args):
        both.wait(timeout=60)
        return fit(*args)

    df = table(spark, 200)
    alone = fit_forest(df, features(), F.col("y"), 3, 4, Growth(), batch=4)
    monkeypatch.setattr(forest, "_fit_batch", met)
    model = fit_forest(df, features(), F.col("y"), 3, 4, Growth(), batch=2)
    assert model.trees == 4 and predictions(df, model) == predictions(df, alone)


def test_importances_are_summed_once(spark, monkeypatch):
    """Asking whether a forest has importances summed up all its nodes, and taking them did so again."""
    fit = models.fit_model("random_forest", table(spark, 100).withColumnRenamed("b.c", "c"), ["a", "c", "d"],
                           {"n_estimators": 2})
    calls, rows = [], forest.ForestModel.importance_rows
    monkeypatch.setattr(forest.ForestModel, "importance_rows", lambda self: calls.append(1) or rows(self))
    assert fit.importances()[0].sum() == pytest.approx(1.0) and len(calls) == 1
