import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regressa.operators import clean, encode


def test_impute_median_mode_unknown(spark):
    rows = [(1.0, "b", None, 10.0), (None, "a", None, 11.0), (3.0, "b", None, None),
            (4.0, None, None, 13.0), (None, "a", None, 14.0)]
    df = spark.createDataFrame(rows, "x double, c string, allnull string, y double")
    m = clean.fit_impute(df, "y")
    assert m.values["x"] == 3.0            # median of 1, 3, 4
    assert m.values["c"] == "a"            # tie a/b -> smallest
    assert m.values["allnull"] == "Unknown"
    out = m.transform(df).collect()
    assert all(r["x"] is not None and r["c"] is not None for r in out)
    assert sum(r["y"] is None for r in out) == 1  # the target is never filled


def test_fill_methods(spark):
    rows = [(1, None, "u"), (None, 2.0, "v"), (3, 2.0, None), (3, 5.0, "v")]
    df = spark.createDataFrame(rows, "i int, d double, s string")
    mean = clean.fit_fill(df, "mean").transform(df).collect()
    assert mean[1]["i"] == (1 + 3 + 3) / 3 and isinstance(mean[1]["i"], float)
    med = clean.fit_fill(df, "median").transform(df).collect()
    assert med[0]["d"] == 2.0
    mode = clean.fit_fill(df, "mode").transform(df).collect()
    assert (mode[1]["i"], mode[0]["d"], mode[2]["s"]) == (3, 2.0, "v")


def test_forward_backward_fill_match_pandas(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"t": rng.permutation(n), "g": rng.integers(0, 4, n),
                        "v": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.4, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    for direction, method in [("forward", "ffill"), ("backward", "bfill")]:
        got = clean.fill_ordered(df.repartition(5), ["v"], ["t"], direction=direction,
                                 num_buckets=6).toPandas().set_index("t").sort_index()
        exp = getattr(pdf.sort_values("t").set_index("t").v, method)()
        assert np.allclose(got.v.to_numpy(dtype=float), exp.to_numpy(), equal_nan=True)
        got_g = clean.fill_ordered(df, ["v"], ["t"], partition_by=["g"], direction=direction,
                                   num_buckets=6).toPandas().set_index("t").sort_index()
        srt = pdf.sort_values("t")
        exp_g = getattr(srt.groupby("g").v, method)()
        exp_g.index = srt.t
        assert np.allclose(got_g.v.to_numpy(dtype=float), exp_g.sort_index().to_numpy(),
                           equal_nan=True)


def test_drop_duplicates_keep_first(spark):
    rows = [(1, 5, "x"), (1, 3, "y"), (2, 9, "z"), (2, 9, "z")]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    assert clean.drop_duplicates(df).count() == 3
    first = {r["k"]: r["v"] for r in clean.drop_duplicates(df, ["k"], ["t"]).collect()}
    assert first == {1: "y", 2: "z"}


def test_outliers_and_capped_sample(spark):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") == 7, 1e6).otherwise(
        F.col("id").cast("double")))
    kept = clean.remove_outliers(df, clean.fit_outlier_bounds(df, ["x"]))
    assert kept.count() == 999
    s1 = clean.capped_sample(df, ["id"], 100, seed=1)
    s2 = clean.capped_sample(df.repartition(9), ["id"], 100, seed=1)
    assert s1.count() == 100
    assert sorted(r[0] for r in s1.select("id").collect()) == \
        sorted(r[0] for r in s2.select("id").collect())


def test_one_hot_drop_first_matches_pandas(spark):
    pdf = pd.DataFrame({"k": range(6), "c": ["b", "a", "c", None, "a", "b"]})
    df = spark.createDataFrame(pdf)
    model = encode.fit_one_hot(df, ["c"])
    assert model.output_columns() == ["c_b", "c_c"]
    got = model.transform(df).toPandas().sort_values("k")
    exp = pd.get_dummies(pdf, columns=["c"], drop_first=True)
    assert (got[["c_b", "c_c"]].to_numpy() == exp[["c_b", "c_c"]].astype(int).to_numpy()).all()
    # unseen category at scoring time -> all zeros
    new = spark.createDataFrame([(9, "zzz")], "k long, c string")
    assert model.transform(new).first()["c_b"] == 0


def test_label_and_target_encoding(spark):
    rows = [(1, "m", 10.0), (2, "a", 20.0), (3, None, 30.0), (4, "m", 40.0)]
    df = spark.createDataFrame(rows, "k int, c string, y double")
    lab = {r["k"]: r["c"] for r in encode.fit_label(df, ["c"]).transform(df).collect()}
    assert lab == {1: 1, 2: 0, 3: 2, 4: 1}  # sorted 'a' < 'm' < 'nan'
    tm = encode.fit_target(df, ["c"], "y", smoothing=2.0)
    enc = {r["k"]: r["c"] for r in tm.transform(df).collect()}
    g = 25.0
    assert math.isclose(enc[1], (50.0 + 2 * g) / 4)
    assert math.isclose(enc[3], g)


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = encode.fit_scaler(df, ["a", "b"]).transform(df).collect()
    sd = np.std([1, 2, 3])
    assert math.isclose(out[0]["a"], -1 / sd) and out[0]["b"] == 0.0


def test_exact_split_and_folds(spark):
    df = spark.range(1003).withColumn("x", F.col("id") * 2)
    a = encode.exact_split(df, ["id"], 0.2, 42, folds=5)
    b = encode.exact_split(df.repartition(13), ["id"], 0.2, 42, folds=5)
    ra = sorted(a.select("id", "is_test", "fold").collect())
    assert ra == sorted(b.select("id", "is_test", "fold").collect())
    n_test = sum(r["is_test"] for r in ra)
    assert n_test == math.ceil(1003 * 0.2)
    sizes = pd.Series([r["fold"] for r in ra if not r["is_test"]]).value_counts().sort_index()
    assert sizes.tolist() == [161, 161, 160, 160, 160]
    assert all(r["fold"] is None for r in ra if r["is_test"])
    approx = encode.hash_split(df, ["id"], 0.2, 42).where("is_test").count()
    assert 120 < approx < 290


def test_align_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, extra double")
    out = encode.align_columns(df, ["a", "b"])
    assert out.columns == ["a", "b"] and out.first()["a"] == 0


def test_split_does_not_depend_on_session_time_zone(spark):
    from tests.conftest import SF0001

    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    utc = sorted(encode.exact_split(li, keys).where("is_test").select(*keys[:4]).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        la = sorted(encode.exact_split(li, keys).where("is_test").select(*keys[:4]).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == la


def test_one_hot_vector_takes_any_number_of_categories(spark):
    rows = spark.range(20_000).selectExpr("id", "format_string('v%05d', id) AS `city.name`",
                                          "IF(id % 2 = 0, 'a', 'b') AS half")
    model = encode.fit_one_hot_vector(rows, ["city.name", "half"])
    assert model.widths == {"city.name": 20_000, "half": 2}
    batch = spark.createDataFrame([(0, "v00000", "a"), (1, "v00001", "b"), (2, "v19999", None),
                                   (3, "unseen", "b"), (4, None, "a")], "id long, `city.name` string, "
                                                                        "half string")
    got = {r.id: r for r in model.transform(batch).collect()}
    assert {len(r["city.name_onehot"]) for r in got.values()} == {19_999}
    assert [got[i]["city.name_onehot"].indices.tolist() for i in range(5)] == [[], [0], [19_998], [], []]
    assert [got[i].half_onehot.indices.tolist() for i in range(5)] == [[], [0], [], [0], []]
    with pytest.raises(ValueError):
        encode.fit_one_hot_vector(rows.where("half = 'a'"), ["half"])


def test_subset_duplicates_without_an_order_keep_the_smallest_rest(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1), (1, "a", 3)],
                               "k int, v string, n int").repartition(3)
    assert sorted(map(tuple, clean.drop_duplicates(df, ["k"]).collect())) == [(1, "a", 3), (2, None, 1)]
    assert clean.drop_duplicates(df.select("k"), ["k"]).count() == 2


def test_backward_fill_is_linear_and_keeps_null_groups(spark):
    """Twice the rows take about twice the time (a frame evaluated anew took four times)."""
    import time

    def run(n):
        df = spark.range(n).select(F.col("id").alias("t"), F.when(F.col("id") % 7 == 0, F.col("id") * 1.0)
                                   .alias("v"))
        start = time.perf_counter()
        out = clean.fill_ordered(df, ["v"], ["t"], direction="backward", num_buckets=2)
        out.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(1_000)
    assert run(400_000) < 40  # minutes before
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, "g", 5.0), (4, "g", None)],
                               "t int, `k.k` string, `v v` double")
    got = {r["t"]: r["v v"] for r in clean.fill_ordered(df, ["v v"], ["t"], ["k.k"]).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 5.0, 4: 5.0}


def test_keys_with_nulls_and_separators_differ(spark):
    rows = [(None, "a"), ("a", None), ("a|", "b"), ("a", "|b"), ("a", "b"), ("a\\", "b"), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(clean.hash_of_keys(df, ["x", "y"], 1).alias("h")).distinct().count() == len(rows)


def test_whole_row_duplicates_by_fingerprints(spark):
    from regressa.operators import profile

    rows = [(1, "a", 0.0), (1, "a", -0.0), (None, "a", 1.0), (None, "a", 1.0), (1, None, None),
            (None, "1", None), (2, "x", float("nan")), (2, "x", float("nan"))] + [(9, "hot", 1.0)] * 300
    df = spark.createDataFrame(rows, "i int, `s.t` string, d double").repartition(4)
    assert profile.duplicate_row_count(df).first()[0] == 302
    assert clean.drop_duplicates(df).count() == 6
    assert profile.table_summary(df).first()["duplicate_rows"] == 302
    counts = {r["column"]: r["distinct"] for r in profile.distinct_counts(df).collect()}
    assert counts == {"i": 3, "s.t": 4, "d": 3}


def test_encoders_on_hot_and_null_categories(spark, monkeypatch):
    """A third of the rows are null and a third one value: neither goes through the join."""
    n = 3_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot")
        .otherwise(F.concat(F.lit("c"), (F.col("id") % 500).cast("string"))).alias("k.1"),
        (F.col("id") % 7).cast("double").alias("y"))
    rows = [(r["k.1"], r["y"]) for r in df.collect()]
    label = encode.fit_label(df, ["k.1"])
    assert set(label.heavy["k.1"]) == {"hot", "nan"}
    codes = {v: i for i, v in enumerate(sorted({str(k) if k else "nan" for k, _ in rows}))}
    got = [r["k.1"] for r in label.transform(df).collect()]
    assert sorted(got) == sorted(codes[k or "nan"] for k, _ in rows)
    target = encode.fit_target(df, ["k.1"], "y", 10.0)
    mean = sum(y for _, y in rows) / n
    hot = [y for k, y in rows if k == "hot"]
    enc = {k: v for k, v in zip([k for k, _ in rows], [r["k.1"] for r in target.transform(df).collect()])}
    assert target.heavy["k.1"]["hot"] == (sum(hot) + 10 * mean) / (len(hot) + 10)
    assert any(abs(v - target.heavy["k.1"]["hot"]) < 1e-12 for v in enc.values())
    wide = encode.fit_one_hot_vector(df, ["k.1"])
    hits = [r["k.1_onehot"] for r in wide.transform(df).collect()]
    first = min(k for k, _ in rows if k)
    assert sum(v.numNonzeros() for v in hits) == sum(k is not None and k != first for k, _ in rows)
    monkeypatch.setattr(encode, "HEAVY_SHARE", 2.0)  # no category counts as heavy
    plain = encode.fit_label(df, ["k.1"])
    assert plain.heavy == {} and sorted(r["k.1"] for r in plain.transform(df).collect()) == sorted(got)
