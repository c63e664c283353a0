import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regressa.operators.ranking import (exact_quantiles, hash_rank_thresholds,
                                        with_row_number, with_running_sums)


def _frame(spark, n=2000, seed=1, groups=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": np.arange(n), "g": rng.integers(0, groups, n),
                        "v": rng.integers(0, 50, n).astype(float), "w": rng.integers(1, 5, n)})
    return pdf, spark.createDataFrame(pdf)


def test_running_sums_match_pandas(spark):
    pdf, df = _frame(spark)
    out = with_running_sums(df.repartition(7), ["v", "k"], {"w": "w"}).toPandas()
    exp = pdf.sort_values(["v", "k"]).assign(w_before=lambda d: d.w.cumsum() - d.w)
    got = out.set_index("k").loc[exp.k, "w_before"].to_numpy()
    assert (got == exp.w_before.to_numpy()).all()


def test_running_sums_partitioned_and_skewed(spark):
    # One hot group holds most rows: it spans several range partitions.
    pdf, df = _frame(spark, groups=2)
    pdf.loc[pdf.index % 10 != 0, "g"] = 0
    df = spark.createDataFrame(pdf)
    out = with_running_sums(df, ["v", "k"], {"w": "w"}, partition_by=["g"],
                            num_buckets=5).toPandas()
    exp = pdf.sort_values(["g", "v", "k"])
    exp["w_before"] = exp.groupby("g").w.cumsum() - exp.w
    got = out.set_index("k").loc[exp.k, "w_before"].to_numpy()
    assert (got == exp.w_before.to_numpy()).all()


def test_row_number_is_unchanged_by_repartitioning(spark):
    _, df = _frame(spark)
    a = with_row_number(df.repartition(3), ["v", "k"]).select("k", "row_number")
    b = with_row_number(df.repartition(11), ["v", "k"]).select("k", "row_number")
    assert sorted(a.collect()) == sorted(b.collect())
    assert sorted(r[0] for r in a.select("row_number").collect()) == list(range(1, 2001))


def test_exact_quantiles_match_numpy(spark):
    pdf, df = _frame(spark, n=999)
    pdf.loc[::7, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r["value"]
           for r in exact_quantiles(df, ["v", "w"], probs).collect()}
    for c in ["v", "w"]:
        vals = pdf[c].dropna().to_numpy(dtype=float)
        for p in probs:
            assert abs(got[(c, p)] - np.quantile(vals, p)) < 1e-9


@pytest.mark.parametrize("rows,cells", [(4096, 1024), (5, 16)])
def test_order_statistics_match_sorting(spark, monkeypatch, rows, cells):
    """Also with brackets that stay wide, so that they are narrowed again and again."""
    import regressa.operators.ranking as R

    monkeypatch.setattr(R, "BRACKET_ROWS", rows)
    monkeypatch.setattr(R, "SKETCH_CELLS", cells)
    rng = np.random.default_rng(8)
    n = 3000
    pdf = pd.DataFrame({"a.b": rng.lognormal(0, 9, n), "hot": rng.choice([1.0, 1.0, 1.0, 2.0, -7.5], n),
                        "few": rng.integers(0, 4, n).astype(float), "z": rng.normal(size=n)})
    pdf.loc[::5, "z"] = np.nan
    pdf.loc[:3, "few"] = [np.inf, -np.inf, np.inf, -np.inf]
    df = spark.createDataFrame(pdf).repartition(5)
    wanted = [0, 1, 777, 1200, 1500, 2300, 2999]
    got = R.order_statistics(df, {c: lambda n: wanted for c in pdf})
    for c in pdf:
        vals = np.sort(pdf[c].dropna().to_numpy())
        assert got[c][0] == len(vals)
        for r in wanted:
            if r < len(vals):
                v = vals[r]
                assert got[c][1][r] == (v, int((vals < v).sum()), int((vals == v).sum())), (c, r)


def test_order_statistics_of_empty_and_constant_columns(spark):
    import regressa.operators.ranking as R

    df = spark.range(50).select(F.lit(3.5).alias("k"), F.lit(None).cast("double").alias("none"))
    got = R.order_statistics(df, {"k": lambda n: [0, 25, 49], "none": lambda n: [0]})
    assert got == {"k": (50, {r: (3.5, 0, 50) for r in (0, 25, 49)}), "none": (0, {})}


def test_hash_rank_thresholds_match_sorting(spark):
    n = 5000
    df = spark.range(n).withColumn("h", F.md5(F.col("id").cast("string")))
    hashes = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(n))
    ranks = [0, 1, 999, 2500, 4999]
    assert hash_rank_thresholds(df, "h", ranks) == [hashes[r] for r in ranks]


def test_hash_rank_thresholds_refines_large_buckets(spark, monkeypatch):
    import regressa.operators.ranking as R

    monkeypatch.setattr(R, "DIRECT_BUCKET_ROWS", 1)
    n = 3000
    df = spark.range(n).withColumn("h", F.md5(F.col("id").cast("string")))
    hashes = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(n))
    ranks = [0, 1234, 2999]
    assert R.hash_rank_thresholds(df, "h", ranks) == [hashes[r] for r in ranks]


def test_order_statistics_scan_only_a_few_times(spark, monkeypatch):
    """No sketch of every value: histograms over leading bits, at most six scans whatever the values."""
    import regressa.operators.ranking as R

    scans, cells = [], R._cells
    monkeypatch.setattr(R, "_cells", lambda *a: scans.append(1) or cells(*a))
    monkeypatch.setattr(R, "BRACKET_ROWS", 2)
    base = 1.0 + np.arange(4000) * 2.0 ** -50  # one cell until the last bits
    df = spark.createDataFrame(pd.DataFrame({"v": np.concatenate([base, -base, [0.0, -0.0, 5e-324]])})).repartition(3)
    got = R.order_statistics(df, {"v": lambda n: [0, 3999, 4000, 4002, 4003, 8002]})["v"]
    assert got == (8003, {0: (-base[-1], 0, 1), 3999: (-base[0], 3999, 1), 4000: (0.0, 4000, 2),
                          4002: (5e-324, 4002, 1), 4003: (base[0], 4003, 1), 8002: (base[-1], 8002, 1)})
    assert len(scans) <= 5
