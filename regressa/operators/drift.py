"""Monitoring (D1-D8): drift tests, degradation alerts, batch monitoring.

All columns of a side are tested in one job: numeric columns are unpivoted
to ``(feature, value, side)`` so every two-sample KS statistic comes from one
grouped count plus one distributed running sum; categorical columns go
through one grouped count and a full outer join of the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regressa.functions.columns import col, role_of
from regressa.functions.stats import KS_EXACT_ROWS, chi2_sf, ks_exact, ks_pvalue_sql
from regressa.operators.metrics import metric_aggs
from regressa.operators.ranking import range_buckets, unpivot_numeric, value_counts_cumulative

# The reference's alert thresholds.
DRIFT_P_THRESHOLD = 0.05
DEGRADATION_THRESHOLD = 0.1
SEVERITY_HIGH_PCT = 25.0
SEVERITY_MEDIUM_PCT = 15.0
MEAN_SHIFT_STDS = 2.0


def common_features(reference: DataFrame, new: DataFrame) -> tuple[list, list]:
    """D3 set logic: shared columns split by role (reference side's type)."""
    shared = [c for c in reference.columns if c in new.columns]
    num = [c for c in shared if role_of(reference.schema[c].dataType) == "numeric"]
    cat = [c for c in shared if role_of(reference.schema[c].dataType) != "numeric"]
    return num, cat


def ks_drift(reference: DataFrame, new: DataFrame, columns=None,
             threshold: float = DRIFT_P_THRESHOLD, method: str = "auto") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per numeric column, nulls dropped.
    Rows ``(feature, test, statistic, p_value, n_ref, n_new, drifted)``. The
    p-value is exact (lattice paths) where neither sample has more than
    ``KS_EXACT_ROWS`` values, and beyond from the asymptotic Kolmogorov
    distribution with ``lambda = sqrt(n m / (n + m)) * D``; ``method`` 'exact'
    or 'asymp' asks for one of them."""
    if method not in ("auto", "exact", "asymp"):
        raise ValueError(f"unknown method {method!r}")
    cols = list(columns) if columns is not None else common_features(reference, new)[0]
    ref = unpivot_numeric(reference, cols, name="feature").withColumn("__ref", F.lit(1))
    nw = unpivot_numeric(new, cols, name="feature").withColumn("__ref", F.lit(0))
    long = ref.unionByName(nw).where(F.col("value").isNotNull()).select(
        "feature", "value", F.col("__ref").alias("r"), (1 - F.col("__ref")).alias("w"))
    buckets = max(range_buckets(reference, None, len(cols)), range_buckets(new, None, len(cols)))
    cum = value_counts_cumulative(long, "value", ["feature"], weight_cols=["r", "w"],
                                  num_buckets=buckets)
    tot = long.groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("w").alias("n_new"))
    # Totals are one row per column.
    gaps = cum.join(F.broadcast(tot), "feature").select(
        "feature", "n_ref", "n_new",
        F.abs(F.try_divide((F.col("r_before") + F.col("r")).cast("double"), F.col("n_ref"))
              - F.try_divide((F.col("w_before") + F.col("w")).cast("double"), F.col("n_new")))
        .alias("gap"))
    stat = gaps.groupBy("feature", "n_ref", "n_new").agg(F.max("gap").alias("statistic"))
    # Doubles: the product of two counts leaves the long range at about 3e9 rows.
    n, m = F.col("n_ref").cast("double"), F.col("n_new").cast("double")
    en = n * m / (n + m)
    lam = F.sqrt(en) * F.col("statistic")
    # One row a column from here on.
    few = {"auto": F.greatest("n_ref", "n_new") <= KS_EXACT_ROWS, "exact": F.lit(True),
           "asymp": F.lit(False)}[method]
    exact = ks_exact(F.when(few, F.col("statistic")), "n_ref", "n_new")
    out = stat.withColumn("__lam", lam).withColumn("__exact", exact).select(
        "feature", F.lit("kolmogorov_smirnov").alias("test"), "statistic",
        # Without values on one side there is no test.
        F.when(F.col("statistic").isNotNull(), F.coalesce("__exact", F.expr(ks_pvalue_sql("__lam"))))
        .alias("p_value"), "n_ref", "n_new")
    return out.withColumn("drifted", F.coalesce(F.col("p_value") < F.lit(threshold), F.lit(False)))


def chi_square_counts(reference: DataFrame, new: DataFrame, columns=None) -> DataFrame:
    """D2 core: per categorical column, the chi-square statistic of the new
    counts against reference counts scaled to the new total, over the union
    of categories (full outer join). Rows ``(feature, test, statistic, dof,
    n_ref, n_new)``; a category unseen in the reference gives +inf."""
    cols = list(columns) if columns is not None else common_features(reference, new)[1]

    def counts(df, name):
        entries = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("category"))
                            for c in cols])
        long = df.select(F.explode(entries).alias("e")).select("e.*").where("category IS NOT NULL")
        return long.groupBy("feature", "category").agg(F.count(F.lit(1)).alias(name))

    joined = counts(reference, "o_ref").join(counts(new, "o_new"), ["feature", "category"],
                                             "full_outer").na.fill(0, ["o_ref", "o_new"])
    tot = joined.groupBy("feature").agg(F.sum("o_ref").alias("n_ref"),
                                        F.sum("o_new").alias("n_new"),
                                        F.count(F.lit(1)).alias("k"))
    cells = joined.join(F.broadcast(tot), "feature").withColumn(  # one row per column
        "e", F.try_divide(F.col("o_ref").cast("double") * F.col("n_new"), F.col("n_ref")))
    term = (F.when(F.col("e") > 0, F.try_divide((F.col("o_new") - F.col("e")) ** 2, F.col("e")))
            .when(F.col("o_new") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    return cells.groupBy("feature", "n_ref", "n_new", "k").agg(F.sum(term).alias("statistic")) \
        .select("feature", F.lit("chi_square").alias("test"), "statistic",
                (F.col("k") - 1).cast("int").alias("dof"), "n_ref", "n_new")


def chi_square_drift(reference: DataFrame, new: DataFrame, columns=None,
                     threshold: float = DRIFT_P_THRESHOLD) -> DataFrame:
    """Adds ``p_value`` (chi-square survival function, computed on the
    per-feature result rows only) and ``drifted``."""
    stat = chi_square_counts(reference, new, columns)
    out = stat.withColumn("p_value", F.when(F.col("statistic") == float("inf"), F.lit(0.0))
                          .otherwise(chi2_sf(F.col("statistic"), F.col("dof"))))
    return out.withColumn("drifted", F.col("p_value") < F.lit(threshold))


def detect_drift(reference: DataFrame, new: DataFrame,
                 threshold: float = DRIFT_P_THRESHOLD) -> DataFrame:
    """D3: every shared column tested by role; ``(feature, test, statistic,
    p_value, drifted)`` rows. ``drift_summary`` rolls them up."""
    num, cat = common_features(reference, new)
    parts = []
    if num:
        parts.append(ks_drift(reference, new, num, threshold).select(
            "feature", "test", "statistic", "p_value", "drifted"))
    if cat:
        parts.append(chi_square_drift(reference, new, cat, threshold).select(
            "feature", "test", "statistic", "p_value", "drifted"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drift_summary(results: DataFrame) -> DataFrame:
    """D3 roll-up: ``(drift_detected, drift_features)``."""
    return results.agg(F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("drift_detected"),
                       F.sort_array(F.collect_list(F.when(F.col("drifted"), F.col("feature"))))
                       .alias("drift_features"))


def metrics_long(metrics: DataFrame, names=("r2", "rmse", "mae")) -> DataFrame:
    """One metrics row -> ``(metric, value)`` rows."""
    return metrics.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for n in names])).alias("m")).select("m.*")


def _degradation(cur: DataFrame, base: DataFrame, lower_is_worse=("r2",)) -> DataFrame:
    j = cur.withColumnRenamed("value", "current").join(
        base.withColumnRenamed("value", "baseline"), "metric", "inner")
    delta = F.when(F.col("metric").isin(*lower_is_worse), F.col("baseline") - F.col("current")) \
        .otherwise(F.col("current") - F.col("baseline"))
    # Divide by |baseline| so a negative R2 baseline keeps the sign right.
    return j.withColumn("degradation_pct", F.try_divide(delta, F.abs(F.col("baseline"))) * 100)


def degradation_alert(current: DataFrame, baseline: DataFrame,
                      threshold: float = DEGRADATION_THRESHOLD) -> DataFrame:
    """``current``/``baseline`` are ``(metric, value)`` rows (r2, rmse,
    mae). Rows ``(metric, current, baseline, degradation_pct, degraded,
    severity)``; severity of the worst degraded metric: > 25% high, > 15%
    medium, else low; 'none' without degradation."""
    d = _degradation(current, baseline).withColumn(
        "degraded", F.coalesce(F.col("degradation_pct") > threshold * 100, F.lit(False)))
    # ``d`` has one row per metric (three): a whole-frame window is bounded.
    w = F.max(F.when(F.col("degraded"), F.col("degradation_pct"))).over(
        Window.partitionBy(F.lit(1)))
    sev = (F.when(w.isNull(), "none").when(w > SEVERITY_HIGH_PCT, "high")
           .when(w > SEVERITY_MEDIUM_PCT, "medium").otherwise("low"))
    return d.withColumn("severity", sev)


def batch_alerts(per_batch: DataFrame, baseline: DataFrame, batch_cols,
                 threshold: float = DEGRADATION_THRESHOLD) -> DataFrame:
    """Per monitored batch, alerts for metrics degraded by more than 10%:
    ``(*batch_cols, metric, current, baseline, degradation_pct, severity)``,
    severity high above 25% else medium. ``per_batch`` holds one metrics row
    per batch (r2, rmse, mae); ``baseline`` is ``(metric, value)``."""
    batch_cols = list(batch_cols)
    long = per_batch.select(*batch_cols, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for n in ("r2", "rmse", "mae")])).alias("m")).select(*batch_cols, "m.*")
    b = F.broadcast(baseline.withColumnRenamed("value", "baseline"))  # three rows
    j = long.withColumnRenamed("value", "current").join(b, "metric")
    delta = F.when(F.col("metric") == "r2", F.col("baseline") - F.col("current")) \
        .otherwise(F.col("current") - F.col("baseline"))
    d = j.withColumn("degradation_pct", F.try_divide(delta, F.abs(F.col("baseline"))) * 100)
    return d.where(F.col("degradation_pct") > threshold * 100).withColumn(
        "severity", F.when(F.col("degradation_pct") > SEVERITY_HIGH_PCT, "high")
        .otherwise("medium"))


def mean_shift_drift(reference: DataFrame, recent: DataFrame, columns=None) -> DataFrame:
    """``|mean_recent - mean_ref| > 2 * std_ref`` (sample std). Rows
    ``(feature, recent_mean, reference_mean, reference_std, drift_magnitude,
    drifted)``; two scans, one per side, no join of rows."""
    cols = list(columns) if columns is not None else common_features(reference, recent)[0]
    r = unpivot_numeric(reference, cols, name="feature").groupBy("feature").agg(
        F.avg("value").alias("reference_mean"), F.stddev_samp("value").alias("reference_std"))
    n = unpivot_numeric(recent, cols, name="feature").groupBy("feature").agg(
        F.avg("value").alias("recent_mean"))
    j = n.join(r, "feature")
    diff = F.abs(F.col("recent_mean") - F.col("reference_mean"))
    return j.select("feature", "recent_mean", "reference_mean", "reference_std",
                    F.try_divide(diff, F.col("reference_std")).alias("drift_magnitude"),
                    F.coalesce(diff > MEAN_SHIFT_STDS * F.col("reference_std"), F.lit(False))
                    .alias("drifted"))


def monitor_batch(predictions: DataFrame, actuals: DataFrame | None, key_cols,
                  p: str = "prediction", y: str = "y") -> DataFrame:
    """One row ``(batch_size, successful_predictions, failed_predictions,
    r2, rmse, mae)``. A prediction succeeded when it is not null; metrics are
    computed when every successful prediction has an actual (joined on the
    key), else null."""
    key_cols = list(key_cols)
    # A NaN prediction is a failed one.
    value = F.col(p).cast("double")
    pr = predictions.select(*key_cols, F.when(~F.isnan(value), value).alias("__p"))
    if actuals is None:
        return pr.agg(F.count(F.lit(1)).alias("batch_size"),
                      F.count("__p").alias("successful_predictions"),
                      F.count_if(F.col("__p").isNull()).alias("failed_predictions"),
                      F.lit(None).cast("double").alias("r2"),
                      F.lit(None).cast("double").alias("rmse"),
                      F.lit(None).cast("double").alias("mae"))
    j = pr.join(actuals.select(*key_cols, F.col(y).alias("__y")), key_cols, "left")
    both_ok = F.col("__p").isNotNull() & F.col("__y").isNotNull()
    j = j.withColumn("__ym", F.when(both_ok, F.col("__y"))).withColumn(
        "__pm", F.when(both_ok, F.col("__p")))
    stats = j.agg(F.count(F.lit(1)).alias("batch_size"),
                  F.count("__p").alias("successful_predictions"),
                  F.count_if(F.col("__p").isNull()).alias("failed_predictions"),
                  F.count_if(F.col("__p").isNotNull() & F.col("__y").isNull()).alias("__miss"),
                  *metric_aggs("__ym", "__pm", only=("r2", "rmse", "mae")))
    gate = F.col("__miss") == 0
    return stats.select("batch_size", "successful_predictions", "failed_predictions",
                        F.when(gate, F.col("r2")).alias("r2"),
                        F.when(gate, F.col("rmse")).alias("rmse"),
                        F.when(gate, F.col("mae")).alias("mae"))


def monitoring_report(alerts: DataFrame, ts_col: str, last: int = 10):
    """(last ``last`` alerts by time, totals by severity)."""
    others = [col(c) for c in alerts.columns if c != ts_col]
    recent = alerts.orderBy(F.desc(ts_col), *others).limit(last)
    totals = alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                        F.count_if(F.col("severity") == "high").alias("high_severity"),
                        F.count_if(F.col("severity") == "medium").alias("medium_severity"))
    return recent, totals
