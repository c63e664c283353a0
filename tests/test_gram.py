import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from regressa.plans import gram, models, tuning

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(size=(n, 4)) * [1, 2, 0.5, 1] + [0, 3, -1, 1e4]
    y = 1e5 + 3 * x[:, 0] - x[:, 1] + rng.normal(size=n)
    rows = [(*map(float, r), float(t), i % 5) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df.repartition(3)).cache()


CASES = [("linear", {}), ("ridge", {"alpha": 1.0}), ("ridge", {"alpha": 1000.0}), ("lasso", {"alpha": 0.1}),
         ("lasso", {"alpha": 10.0}), ("elastic_net", {"alpha": 0.5, "l1_ratio": 0.3})]


@pytest.mark.parametrize("name,hp", CASES)
def test_one_pass_equals_a_fit_for_each_fold(train, name, hp):
    folds = gram.fold_moments(train, "features", "y", 4)
    assert sorted(folds) == [0, 1, 2, 3, 4] and gram.total(folds).n == 400
    spark_fit = models.fit_model(name, train, NAMES, hp).model
    own = gram.fit(gram.total(folds), name, hp)
    assert own.coefficients.toArray() == pytest.approx(spark_fit.coefficients.toArray(), abs=2e-5)
    got = gram.cross_val_scores(folds, name, hp, "r2")
    for f in (0, 3):
        part = models.fit_model(name, train.where(F.col("fold") != f), NAMES, hp)
        held = part.predict(train.where(F.col("fold") == f))
        y, p = np.array([(r["y"], r["prediction"]) for r in held.select("y", "prediction").collect()]).T
        assert got[f] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)


def test_metrics_of_the_moments(train):
    folds = gram.fold_moments(train, "features", "y", 4)
    m = folds[2]
    model = gram.fit(gram.total(folds), "linear", {})
    rows = model.transform(train.where("fold = 2")).select("y", "prediction").collect()
    e = np.array([r["y"] - r["prediction"] for r in rows])
    w, b = model.coefficients.toArray(), model.intercept
    assert gram.score(m, w, b, "rmse") == pytest.approx(np.sqrt((e ** 2).mean()), rel=1e-9)
    assert gram.score(m, w, b, "neg_mean_squared_error") == pytest.approx(-(e ** 2).mean(), rel=1e-9)
    y = np.array([r["y"] for r in rows])
    assert gram.score(m, w, b, "explained_variance") == pytest.approx(1 - e.var() / y.var(), abs=1e-9)


def test_search_takes_the_same_candidates_either_way(train, monkeypatch):
    best, score, results = tuning.search("ridge", train, NAMES, 5, "grid")
    monkeypatch.setattr(tuning, "from_moments", lambda *a: False)
    best2, score2, results2 = tuning.search("ridge", train, NAMES, 5, "grid")
    assert best == best2 and score == pytest.approx(score2, abs=1e-7)
    for (hp, m, s), (hp2, m2, s2) in zip(results, results2, strict=True):
        assert hp == hp2 and (m, s) == pytest.approx((m2, s2), abs=1e-7)


def test_odd_tables(spark):
    one = spark.createDataFrame([(1.0, 5.0, 0), (1.0, 5.0, 1), (1.0, None, 1)], "x double, y double, fold int")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(one)
    folds = gram.fold_moments(df, "features", "y", 1)
    assert gram.cross_val_scores(folds, "linear", {}, "r2") == [1.0, 1.0]  # constant and met
    assert gram.fold_moments(df.limit(0), "features", "y", 1) == {}
    m = gram.fit(gram.total(folds), "lasso", {"alpha": 1.0})
    assert m.transform(df).first()["prediction"] == 5.0


def test_columns_give_what_an_assembled_vector_gives(spark):
    """The linear family needs no assembled copy of the rows."""
    from pyspark.sql import functions as F

    from regressa.plans import gram, models

    df = spark.range(300).select(
        (F.col("id") % 5).cast("int").alias("fold"), F.rand(1).alias("a.b"), F.rand(2).alias("c"),
        (F.rand(3) * 4).alias("y"))
    vectors = models.assemble(df, ["a.b", "c"])
    one = gram.fold_moments(vectors, "features", "y", 2)
    two = gram.fold_moments(df, ["a.b", "c"], "y", 2)
    assert all((one[f].cross == two[f].cross).all() and (one[f].mean == two[f].mean).all() for f in range(5))
    fit = gram.fit(gram.total(two), "ridge", {})
    a = fit.transform(vectors).select("prediction").collect()
    assert a == fit.transform(df, ["a.b", "c"]).select("prediction").collect()


def test_the_split_reads_given_hashes(spark):
    """prepare hashes the keys once; the split took three passes of hashing before."""
    from pyspark.sql import functions as F

    from regressa.operators import clean, encode

    df = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 3).alias("k"))
    hashed = df.withColumn("h", clean.hash_of_keys(df, ["id", "k"], 9))
    a = encode.exact_split(df, ["id", "k"], 0.2, 9, folds=4)
    b = encode.exact_split(hashed, ["id", "k"], 0.2, 9, folds=4, hashed="h")
    assert a.columns == b.columns and sorted(a.collect(), key=lambda r: r["id"]) == sorted(
        b.collect(), key=lambda r: r["id"])
