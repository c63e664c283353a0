import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regressa.operators import drift


def _ks_brute(a, b):
    vals = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), vals, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), vals, side="right") / len(b)
    d = np.abs(fa - fb).max()
    en = len(a) * len(b) / (len(a) + len(b))
    lam = math.sqrt(en) * d
    p = 1.0 if lam < 0.05 else min(1.0, max(0.0, 2 * sum(
        (-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))
    return d, p


def test_ks_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    a = np.round(rng.normal(0, 1, 700), 2)
    b = np.round(rng.normal(0.2, 1, 500), 2)
    ref = spark.createDataFrame(pd.DataFrame({"x": a}))
    new = spark.createDataFrame(pd.DataFrame({"x": b}))
    r = drift.ks_drift(ref, new, method="asymp").first()
    d, p = _ks_brute(a, b)
    assert math.isclose(r["statistic"], d, rel_tol=1e-12)
    assert math.isclose(r["p_value"], p, rel_tol=1e-9, abs_tol=1e-15)
    assert r["drifted"] == (p < 0.05)


def test_exact_ks_p_values_by_enumeration():
    from itertools import combinations

    from regressa.functions.stats import ks_exact_scalar

    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 5)):
        reached = []
        for first in map(set, combinations(range(n + m), n)):
            i = j = top = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in first else (i, j + 1)
                top = max(top, abs(i * m - j * n))
            reached.append(top)
        for top in set(reached):
            assert math.isclose(ks_exact_scalar(top / (n * m), n, m),
                                sum(r >= top for r in reached) / len(reached), rel_tol=1e-12)
    # Printed tables: P(D >= 5/8) of two samples of 8 is 0.0870, P(D >= 7/10) of two of 10 is 0.0123.
    assert round(ks_exact_scalar(5 / 8, 8, 8), 4) == 0.0870
    assert round(ks_exact_scalar(7 / 10, 10, 10), 4) == 0.0123
    assert ks_exact_scalar(0.0, 5, 5) == 1.0 and ks_exact_scalar(1.0, 9_000, 10_000) == 0.0


def test_ks_method_follows_the_sample_sizes(spark, monkeypatch):
    ref = spark.range(40).select((F.col("id") * 1.0).alias("x"))
    new = spark.range(30).select((F.col("id") * 1.1).alias("x"))

    def p(method):
        return drift.ks_drift(ref, new, method=method).first()["p_value"]

    assert p("auto") == p("exact") != p("asymp")
    monkeypatch.setattr(drift, "KS_EXACT_ROWS", 39)
    assert p("auto") == p("asymp")
    one_sided = drift.ks_drift(ref, new.limit(0)).first()
    assert (one_sided["p_value"], one_sided["drifted"]) == (None, False)


def test_chi_square_scaled_expected(spark):
    ref = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "c string")
    new = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10, "c string")
    r = drift.chi_square_drift(ref, new).first()
    assert math.isclose(r["statistic"], (30 - 20) ** 2 / 20 + (10 - 20) ** 2 / 20)
    assert r["dof"] == 1 and r["drifted"]
    unseen = spark.createDataFrame([("a",)] * 5 + [("z",)], "c string")
    assert drift.chi_square_drift(ref, unseen).first()["statistic"] == float("inf")


def test_detect_drift_summary(spark):
    ref = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"),
                                  F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("c"))
    new = ref.withColumn("x", F.col("x") + 30)
    s = drift.drift_summary(drift.detect_drift(ref, new)).first()
    assert s["drift_detected"] and s["drift_features"] == ["x"]


def test_degradation_alert_severity(spark):
    base = spark.createDataFrame([("r2", 0.8), ("rmse", 10.0), ("mae", 8.0)],
                                 "metric string, value double")
    cur = spark.createDataFrame([("r2", 0.7), ("rmse", 13.0), ("mae", 8.4)],
                                "metric string, value double")
    rows = {r["metric"]: r for r in drift.degradation_alert(cur, base).collect()}
    assert math.isclose(rows["r2"]["degradation_pct"], 12.5)
    assert rows["rmse"]["degraded"] and not rows["mae"]["degraded"]
    assert rows["r2"]["severity"] == "high"  # worst: rmse 30%
    neg = spark.createDataFrame([("r2", -0.5)], "metric string, value double")
    worse = spark.createDataFrame([("r2", -0.8)], "metric string, value double")
    assert drift.degradation_alert(worse, neg).first()["degraded"]  # |baseline| keeps the sign


def test_mean_shift_and_batch_monitor(spark):
    ref = spark.createDataFrame([(float(v),) for v in range(10)], "x double")
    rec = spark.createDataFrame([(float(v) + 20,) for v in range(10)], "x double")
    r = drift.mean_shift_drift(ref, rec).first()
    assert r["drifted"] and math.isclose(r["drift_magnitude"], 20 / np.std(range(10), ddof=1))
    pred = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.5)], "k int, prediction double")
    act = spark.createDataFrame([(1, 1.0), (3, 3.0)], "k int, y double")
    m = drift.monitor_batch(pred, act, ["k"]).first()
    assert (m["batch_size"], m["successful_predictions"], m["failed_predictions"]) == (3, 2, 1)
    assert math.isclose(m["mae"], 0.25)


def test_chi_square_with_empty_reference_side(spark):
    ref = spark.createDataFrame([(None,)] * 5, "c string")
    new = spark.createDataFrame([("a",)] * 3, "c string")
    r = drift.chi_square_drift(ref, new).first()
    assert r["statistic"] == float("inf") and r["drifted"]


@pytest.mark.parametrize("name,features", [
    ("ks_drift_events_all", {"event_id", "user_id", "value"}),
    ("ks_drift_events_shifted_all", {"event_id", "user_id", "value"}),
    ("mean_shift_events_all", {"event_id", "user_id", "value"}),
    ("drift_report_events_all", {"event_id", "user_id", "value", "ts", "event_type", "props"}),
    ("drift_summary_events_all", None)])
def test_all_common_columns_of_events_match_oracle(spark, name, features):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/sf0.01/events.parquet')")
    exp = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in exp.description]
    exp = sorted(exp.fetchall(), key=str)
    got = sorted(map(tuple, entry.queries()[name](spark, "/root/testdata/sf0.01").select(names).collect()),
                 key=str)
    assert features is None or {r[0] for r in got} == features
    assert len(got) == len(exp)
    for g, e in zip(got, exp):
        assert [pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in e] == list(g)
