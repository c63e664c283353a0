"""Registered queries: each reads the whole test tables at ``sf_dir`` and runs
one operator family over them. Doubles are rounded to 6 digits so results can
be compared across engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regressa.functions.columns import round_doubles
from regressa.operators import chartdata, clean, diagnostics, encode, profile, validate
from regressa.sources.tables import table

NET_PRICE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def lineitem_regression(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem plus the derived target ``net_price``."""
    return table(spark, sf, "lineitem").withColumn("net_price", F.expr(NET_PRICE))


def q_validate_lineitem(spark, sf):
    rep = validate.validate(lineitem_regression(spark, sf), "net_price")
    return round_doubles(rep.drop("message").withColumnRenamed("check", "check_name"))


def q_validate_customer(spark, sf):
    rep = validate.validate(table(spark, sf, "customer"), "c_acctbal")
    return round_doubles(rep.drop("message").withColumnRenamed("check", "check_name"))


def q_validate_nation(spark, sf):
    rep = validate.validate(table(spark, sf, "nation"), "n_regionkey")
    return round_doubles(rep.drop("message").withColumnRenamed("check", "check_name"))


def q_table_summary_lineitem(spark, sf):
    return profile.table_summary(table(spark, sf, "lineitem"))


def q_table_summary_dup_orders(spark, sf):
    o = table(spark, sf, "orders")
    # Whole-row copies of the orders placed in 1995: a real duplicate load.
    return profile.table_summary(o.unionByName(o.where(F.year("o_orderdate") == 1995)))


def q_column_profile_customer(spark, sf):
    return profile.column_profile(table(spark, sf, "customer"))


def q_describe_lineitem(spark, sf):
    return round_doubles(profile.describe(lineitem_regression(spark, sf)))


def q_missing_report_documents(spark, sf):
    return profile.missing_report(documents_labelled(spark, sf))


def q_correlation_lineitem(spark, sf):
    return round_doubles(profile.correlation_matrix(lineitem_regression(spark, sf)))


def q_target_correlation_lineitem(spark, sf):
    return round_doubles(profile.target_correlation(lineitem_regression(spark, sf), "net_price"))


def q_head_orders(spark, sf):
    return profile.head(table(spark, sf, "orders"), ["o_orderkey"], 100)


def q_numeric_domain_lineitem(spark, sf):
    return round_doubles(profile.numeric_domain(lineitem_regression(spark, sf)))


def q_categorical_domain_orders(spark, sf):
    return profile.categorical_domain(table(spark, sf, "orders"))


QUERIES = {
    "validate_lineitem": q_validate_lineitem,
    "validate_customer": q_validate_customer,
    "validate_nation": q_validate_nation,
    "table_summary_lineitem": q_table_summary_lineitem,
    "table_summary_dup_orders": q_table_summary_dup_orders,
    "column_profile_customer": q_column_profile_customer,
    "describe_lineitem": q_describe_lineitem,
    "missing_report_documents": q_missing_report_documents,
    "correlation_lineitem": q_correlation_lineitem,
    "target_correlation_lineitem": q_target_correlation_lineitem,
    "head_orders": q_head_orders,
    "numeric_domain_lineitem": q_numeric_domain_lineitem,
    "categorical_domain_orders": q_categorical_domain_orders,
}


# --- cleaning -------------------------------------------------------------

def lineitem_with_nulls(spark, sf):
    """lineitem with real gaps: quantity 50 and return flag 'R' blanked."""
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_quantity", F.expr("nullif(l_quantity, 50)")).withColumn(
        "l_returnflag", F.expr("nullif(l_returnflag, 'R')"))


def documents_labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def events_with_gaps(spark, sf):
    ev = table(spark, sf, "events")
    return ev.withColumn("value", F.expr("CASE WHEN event_type = 'error' THEN NULL ELSE value END"))


def q_impute_lineitem(spark, sf):
    li = lineitem_with_nulls(spark, sf).withColumn("net_price", F.expr(NET_PRICE))
    model = clean.fit_impute(li, "net_price")
    return round_doubles(model.transform(li).select(*LINEITEM_KEY, "l_quantity", "l_returnflag"))


def _fill_documents(method):
    def q(spark, sf):
        d = documents_labelled(spark, sf)
        model = clean.fit_fill(d, method)
        return round_doubles(model.transform(d))
    return q


def q_ffill_events(spark, sf):
    ev = events_with_gaps(spark, sf)
    out = clean.fill_ordered(ev, ["value"], ["ts", "event_id"], direction="forward")
    return out.select("event_id", "value")


def q_bfill_events(spark, sf):
    ev = events_with_gaps(spark, sf)
    out = clean.fill_ordered(ev, ["value"], ["ts", "event_id"], direction="backward")
    return out.select("event_id", "value")


def q_ffill_events_by_user(spark, sf):
    ev = events_with_gaps(spark, sf)
    out = clean.fill_ordered(ev, ["value"], ["ts", "event_id"], partition_by=["user_id"])
    return out.select("event_id", "user_id", "value")


def q_drop_null_rows_documents(spark, sf):
    return clean.drop_null_rows(documents_labelled(spark, sf))


def q_dedup_orders(spark, sf):
    o = table(spark, sf, "orders")
    return clean.drop_duplicates(o.unionByName(o.where(F.year("o_orderdate") == 1995)))


def q_dedup_first_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return round_doubles(clean.drop_duplicates(
        li, subset=["l_orderkey", "l_linenumber"],
        order_by=["l_shipdate", "l_partkey", "l_suppkey"]))


def q_outliers_lineitem(spark, sf):
    li = lineitem_regression(spark, sf)
    bounds = clean.fit_outlier_bounds(li, ["l_extendedprice", "net_price"])
    return round_doubles(clean.remove_outliers(li, bounds).select(
        *LINEITEM_KEY, "l_extendedprice", "net_price"))


def q_select_features_lineitem(spark, sf):
    li = lineitem_regression(spark, sf)
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    picked = clean.select_features_by_correlation(li, "net_price", 2, cols)
    return round_doubles(li.select(*LINEITEM_KEY, *picked, "net_price"))


def q_capped_sample_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return round_doubles(clean.capped_sample(li, LINEITEM_KEY, 5000, seed=42))


# --- encoding, split, folds -------------------------------------------------

def q_split_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return encode.exact_split(li, LINEITEM_KEY, 0.2, 42).select(*LINEITEM_KEY, "is_test")


def q_hash_split_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return encode.hash_split(li, LINEITEM_KEY, 0.2, 42).select(*LINEITEM_KEY, "is_test")


def q_folds_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return encode.exact_split(li, LINEITEM_KEY, 0.2, 42, folds=5).select(
        *LINEITEM_KEY, "is_test", "fold")


def q_onehot_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    model = encode.fit_one_hot(li, ["l_returnflag", "l_linestatus"])
    return model.transform(li.select(*LINEITEM_KEY, "l_returnflag", "l_linestatus"))


def q_label_orders(spark, sf):
    o = table(spark, sf, "orders")
    model = encode.fit_label(o, ["o_orderstatus", "o_orderpriority"])
    return model.transform(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"))


def q_target_encode_orders(spark, sf):
    o = encode.exact_split(table(spark, sf, "orders"), ["o_orderkey"], 0.2, 42).cache()
    model = encode.fit_target(o.where(~F.col("is_test")), ["o_orderstatus", "o_orderpriority"],
                              "o_totalprice", smoothing=10.0)
    return round_doubles(model.transform(
        o.select("o_orderkey", "is_test", "o_orderstatus", "o_orderpriority")))


def q_scale_lineitem(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = encode.exact_split(table(spark, sf, "lineitem").select(*LINEITEM_KEY, *cols),
                            LINEITEM_KEY, 0.2, 42).cache()
    model = encode.fit_scaler(li.where(~F.col("is_test")), cols)
    return round_doubles(model.transform(li.select(*LINEITEM_KEY, *cols)))


QUERIES.update({
    "impute_lineitem": q_impute_lineitem,
    "fill_mean_documents": _fill_documents("mean"),
    "fill_median_documents": _fill_documents("median"),
    "fill_mode_documents": _fill_documents("mode"),
    "ffill_events": q_ffill_events,
    "bfill_events": q_bfill_events,
    "ffill_events_by_user": q_ffill_events_by_user,
    "drop_null_rows_documents": q_drop_null_rows_documents,
    "dedup_orders": q_dedup_orders,
    "dedup_first_lineitem": q_dedup_first_lineitem,
    "outliers_lineitem": q_outliers_lineitem,
    "select_features_lineitem": q_select_features_lineitem,
    "capped_sample_lineitem": q_capped_sample_lineitem,
    "split_lineitem": q_split_lineitem,
    "hash_split_lineitem": q_hash_split_lineitem,
    "folds_lineitem": q_folds_lineitem,
    "onehot_lineitem": q_onehot_lineitem,
    "label_orders": q_label_orders,
    "target_encode_orders": q_target_encode_orders,
    "scale_lineitem": q_scale_lineitem,
})


# --- single-feature OLS: predictions, metrics, diagnostics, chart data -----
# Model: net_price ~ l_extendedprice (M1, normal-equation solver) fitted on
# the training rows of the exact split; closed form, so SQL can check it.

def _rounded(df: DataFrame, spec: dict) -> DataFrame:
    return df.select(*[F.round(F.col(c), spec[c]).alias(c) if c in spec else F.col(c)
                       for c in df.columns])


def ols_split(spark, sf):
    from regressa.plans import models

    li = lineitem_regression(spark, sf)
    sp = encode.exact_split(li, LINEITEM_KEY, 0.2, 42)
    # The narrow projection is reused by the fit and every diagnostic: cache it
    # (the assembled training set, as the workflow does).
    data = sp.select(*LINEITEM_KEY, "is_test", F.col("l_extendedprice").alias("x"),
                     F.col("net_price").alias("y")).cache()
    fit = models.fit_model("linear", data.where(~F.col("is_test")), ["x"])
    return data, fit


def ols_test_predictions(spark, sf):
    data, fit = ols_split(spark, sf)
    return fit.predict(data.where(F.col("is_test")))


def q_ols_metrics_lineitem(spark, sf):
    from regressa.operators import metrics

    m = metrics.regression_metrics(ols_test_predictions(spark, sf))
    return _rounded(m, {"r2": 6, "rmse": 4, "mae": 4, "mape": 5})


def q_score_lineitem(spark, sf):
    """R2-R4 over every lineitem row with the training-time pipeline."""
    from regressa.config import RegressionParams
    from regressa.operators import score
    from regressa.plans import models

    li = lineitem_regression(spark, sf)
    sp = encode.exact_split(li, LINEITEM_KEY, 0.2, 42)
    train = sp.where(~F.col("is_test")).select("l_extendedprice", "net_price").cache()
    pre = models.fit_preprocessor(train, "net_price", RegressionParams(), scale=False)
    fit = models.fit_model("linear", pre.transform(train), pre.feature_names)
    scored = score.score_batch(li, pre, fit, keep=LINEITEM_KEY, confidence=True)
    scored = score.prediction_vs_training(scored, "predicted_net_price", pre.target_mean,
                                          pre.target_std)
    # Row-level predictions are rounded to 0.1: the two engines' closed-form
    # fits differ by ~1e-13 relative, enough to flip a 0.01 rounding boundary
    # somewhere in hundreds of thousands of rows.
    return _rounded(scored, {"predicted_net_price": 1, "z_vs_training": 4})


def q_prediction_summary_lineitem(spark, sf):
    from regressa.operators import score

    data, fit = ols_split(spark, sf)
    return _rounded(score.prediction_summary(fit.predict(data), "prediction"),
                    {"mean": 4, "std": 4})


def q_residual_stats_lineitem(spark, sf):
    from regressa.operators import diagnostics

    return _rounded(diagnostics.residual_stats(ols_test_predictions(spark, sf)),
                    {"mean": 4, "std": 4, "skewness": 4, "kurtosis": 4})


def q_residual_cards_lineitem(spark, sf):
    from regressa.operators import diagnostics

    return _rounded(diagnostics.residual_cards(ols_test_predictions(spark, sf)),
                    {"mean": 4, "std": 4, "min": 2, "max": 2})


def q_heteroscedasticity_lineitem(spark, sf):
    from regressa.operators import diagnostics

    out = diagnostics.heteroscedasticity(ols_test_predictions(spark, sf), LINEITEM_KEY)
    return _rounded(out, {"variance": 2, "ratio": 6})


def q_performance_breakdown_lineitem(spark, sf):
    from regressa.operators import diagnostics

    out = diagnostics.performance_breakdown(ols_test_predictions(spark, sf))
    return _rounded(out, {"r2": 6, "rmse": 4, "mae": 4})


def q_residual_histogram_lineitem(spark, sf):
    from regressa.operators import chartdata

    out = chartdata.residual_histogram(ols_test_predictions(spark, sf))
    return _rounded(out, {"lower": 3, "upper": 3})


def q_qq_points_lineitem(spark, sf):
    from regressa.operators import chartdata

    out = chartdata.qq_points(ols_test_predictions(spark, sf), LINEITEM_KEY)
    return _rounded(out, {"theoretical": 6, "sample": 2})


def q_standardized_residuals_lineitem(spark, sf):
    from regressa.operators import chartdata

    out = chartdata.standardized_residuals(ols_test_predictions(spark, sf), LINEITEM_KEY)
    return _rounded(out, {"prediction": 1, "std_residual": 4})


def q_predicted_vs_actual_lineitem(spark, sf):
    from regressa.operators import chartdata

    out = chartdata.predicted_vs_actual(ols_test_predictions(spark, sf), LINEITEM_KEY)
    return _rounded(out, {"actual": 6, "predicted": 1, "abs_error": 1})


def q_identity_line_lineitem(spark, sf):
    from regressa.operators import chartdata

    return _rounded(chartdata.identity_line(ols_test_predictions(spark, sf)), {"lo": 2, "hi": 2})


def q_prediction_range_lineitem(spark, sf):
    from regressa.operators import chartdata

    return _rounded(chartdata.prediction_range(ols_test_predictions(spark, sf)),
                    {"min": 2, "max": 2})


# --- monitoring -------------------------------------------------------------

def events_halves(spark, sf, shift: float = 1.0):
    """Days 1-15 (reference) and 16 onward (new) of the events table; the new
    half optionally has ``value`` scaled (a drifted feed)."""
    ev = table(spark, sf, "events")
    ref = ev.where(F.dayofmonth("ts") <= 15)
    new = ev.where(F.dayofmonth("ts") > 15).withColumn("value", F.col("value") * F.lit(shift))
    return ref, new


def q_chisq_events(spark, sf):
    from regressa.operators import drift

    ref, new = events_halves(spark, sf)
    out = drift.chi_square_counts(ref.select("event_type"), new.select("event_type"))
    return _rounded(out, {"statistic": 6})


def q_chisq_users_events(spark, sf):
    """D2 with one category for each user: many categories."""
    from regressa.operators import drift

    ref, new = events_halves(spark, sf)
    user = F.col("user_id").cast("string").alias("user_id")
    out = drift.chi_square_drift(ref.select(user), new.select(user))
    return _rounded(out.drop("p_value"), {"statistic": 4})


def _whole_drift(fn, shift, digits):
    """``fn`` of both halves whole: the columns' roles choose the tests."""
    def q(spark, sf):
        from regressa.operators import drift

        return _rounded(getattr(drift, fn)(*events_halves(spark, sf, shift)), digits)
    return q


def q_drift_summary_events_all(spark, sf):
    """D3 roll-up over all common columns."""
    from regressa.operators import drift

    out = drift.drift_summary(drift.detect_drift(*events_halves(spark, sf, 1.5)))
    return out.withColumn("drift_features", F.array_join("drift_features", ","))


def _ols_current_vs_baseline(spark, sf):
    """Baseline: test metrics of the OLS model; current: the same rows with
    a feed that reports extended price 10% high (input drift)."""
    from regressa.operators import drift, metrics

    data, fit = ols_split(spark, sf)
    test = data.where(F.col("is_test"))
    base = metrics.regression_metrics(fit.predict(test))
    cur = metrics.regression_metrics(fit.predict(test.withColumn("x", F.col("x") * 1.1)))
    return drift.metrics_long(cur), drift.metrics_long(base)


def q_degradation_lineitem(spark, sf):
    from regressa.operators import drift

    cur, base = _ols_current_vs_baseline(spark, sf)
    out = drift.degradation_alert(cur, base)
    return _rounded(out, {"current": 4, "baseline": 4, "degradation_pct": 4})


def q_batch_monitor_lineitem(spark, sf):
    from regressa.operators import drift

    data, fit = ols_split(spark, sf)
    test = data.where(F.col("is_test"))
    out = drift.monitor_batch(fit.predict(test), test.select(*LINEITEM_KEY, "y"), LINEITEM_KEY)
    return _rounded(out, {"r2": 6, "rmse": 4, "mae": 4})


def monitored_batches(spark, sf):
    """Per ship-year batches of the test rows; from 2000 on the feed reports
    extended price 10% high. Returns per-batch metrics and the baseline."""
    from regressa.operators import drift, metrics

    data, fit = ols_split(spark, sf)
    test = data.where(F.col("is_test")).withColumn("batch_year", F.year("l_shipdate"))
    fed = test.withColumn("x", F.when(F.col("batch_year") >= 2000, F.col("x") * 1.1)
                          .otherwise(F.col("x")))
    per = metrics.regression_metrics(fit.predict(fed), group_cols=["batch_year"])
    base = drift.metrics_long(metrics.regression_metrics(fit.predict(test)))
    return per, base


def q_batch_alerts_lineitem(spark, sf):
    from regressa.operators import drift

    per, base = monitored_batches(spark, sf)
    out = drift.batch_alerts(per, base, ["batch_year"])
    return _rounded(out, {"current": 4, "baseline": 4, "degradation_pct": 4})


def q_monitoring_recent_lineitem(spark, sf):
    from regressa.operators import drift

    per, base = monitored_batches(spark, sf)
    alerts = drift.batch_alerts(per, base, ["batch_year"])
    recent, _ = drift.monitoring_report(alerts.withColumn(
        "__ts", F.col("batch_year") * 10 + F.when(F.col("metric") == "r2", 2)
        .when(F.col("metric") == "rmse", 1).otherwise(0)), "__ts", 10)
    return _rounded(recent.drop("__ts"), {"current": 4, "baseline": 4, "degradation_pct": 4})


def q_monitoring_totals_lineitem(spark, sf):
    from regressa.operators import drift

    per, base = monitored_batches(spark, sf)
    _, totals = drift.monitoring_report(drift.batch_alerts(per, base, ["batch_year"]),
                                        "batch_year")
    return totals


QUERIES.update({
    "ols_metrics_lineitem": q_ols_metrics_lineitem,
    "score_lineitem": q_score_lineitem,
    "prediction_summary_lineitem": q_prediction_summary_lineitem,
    "residual_stats_lineitem": q_residual_stats_lineitem,
    "residual_cards_lineitem": q_residual_cards_lineitem,
    "heteroscedasticity_lineitem": q_heteroscedasticity_lineitem,
    "performance_breakdown_lineitem": q_performance_breakdown_lineitem,
    "residual_histogram_lineitem": q_residual_histogram_lineitem,
    "qq_points_lineitem": q_qq_points_lineitem,
    "standardized_residuals_lineitem": q_standardized_residuals_lineitem,
    "predicted_vs_actual_lineitem": q_predicted_vs_actual_lineitem,
    "identity_line_lineitem": q_identity_line_lineitem,
    "prediction_range_lineitem": q_prediction_range_lineitem,
    "ks_drift_events_all": _whole_drift("ks_drift", 1.0, {"statistic": 6, "p_value": 6}),
    "ks_drift_events_shifted_all": _whole_drift("ks_drift", 1.5, {"statistic": 6, "p_value": 6}),
    "mean_shift_events_all": _whole_drift("mean_shift_drift", 1.5, {
        "recent_mean": 6, "reference_mean": 6, "reference_std": 6, "drift_magnitude": 6}),
    "drift_report_events_all": _whole_drift("detect_drift", 1.5, {"statistic": 6, "p_value": 6}),
    "drift_summary_events_all": q_drift_summary_events_all,
    "chisq_events": q_chisq_events,
    "chisq_users_events": q_chisq_users_events,
    "degradation_lineitem": q_degradation_lineitem,
    "batch_monitor_lineitem": q_batch_monitor_lineitem,
    "batch_alerts_lineitem": q_batch_alerts_lineitem,
    "monitoring_recent_lineitem": q_monitoring_recent_lineitem,
    "monitoring_totals_lineitem": q_monitoring_totals_lineitem,
})
#: Names that stand for the same queries without the suffix.
WHOLE_DRIFT = ("ks_drift_events", "ks_drift_events_shifted", "mean_shift_events", "drift_report_events",
               "drift_summary_events")
QUERIES.update({name: QUERIES[f"{name}_all"] for name in WHOLE_DRIFT})


# --- models, CV, tuning, workflow (no SQL oracle: iterative fits) ----------

REGRESSION_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                       "l_linestatus"]


def lineitem_prepared(spark, sf, params=None):
    """Exact split, folds, training-side fills / one-hot / scaler."""
    from regressa.config import RegressionParams
    from regressa.plans import workflow

    params = params or RegressionParams()
    li = lineitem_regression(spark, sf).select(*LINEITEM_KEY, *REGRESSION_FEATURES, "net_price")
    prepared, pre, keys, _ = workflow.prepare(li, "net_price", params, LINEITEM_KEY)
    return prepared, pre, params


def _comparison(spark, sf, names, tuning_on=False):
    from regressa.operators import metrics
    from regressa.plans import workflow

    prepared, pre, params = lineitem_prepared(spark, sf)
    rows, cv, fitted = workflow.evaluate_models(prepared, pre.feature_names, names, params)
    return metrics.comparison_table(spark, rows), cv, fitted, prepared, pre


def q_model_comparison_lineitem(spark, sf):
    comp, _, _, _, _ = _comparison(spark, sf, ["linear", "ridge", "lasso", "elastic_net"])
    return round_doubles(comp)


def q_cv_summary_lineitem(spark, sf):
    from regressa.operators import metrics

    _, cv, _, _, _ = _comparison(spark, sf, ["linear", "ridge", "lasso", "elastic_net"])
    scores = spark.createDataFrame(cv, "Model string, fold int, score double")
    return round_doubles(metrics.cv_summary(scores))


def _single_model(name, hp=None):
    def q(spark, sf):
        from regressa.operators import metrics
        from regressa.plans import models

        prepared, pre, params = lineitem_prepared(spark, sf)
        train = prepared.where(~F.col("is_test"))
        fit = models.fit_model(name, train, pre.feature_names, hp, params.random_state)
        m = metrics.regression_metrics(fit.predict(prepared.where(F.col("is_test"))))
        return round_doubles(m.select(F.lit(name).alias("Model"), "n", "r2", "rmse", "mae"))
    return q


def q_feature_importance_lineitem(spark, sf):
    from regressa.operators import diagnostics
    from regressa.plans import models

    prepared, pre, params = lineitem_prepared(spark, sf)
    fit = models.fit_model("random_forest", prepared.where(~F.col("is_test")), pre.feature_names,
                           seed=params.random_state)
    imp, method = fit.importances()
    fi = diagnostics.feature_importance(spark, pre.feature_names, imp, method)
    return round_doubles(diagnostics.top_features(fi, 20))


def q_tuning_ridge_lineitem(spark, sf):
    from regressa.plans import tuning

    prepared, pre, params = lineitem_prepared(spark, sf)
    train = prepared.where(~F.col("is_test"))
    best, score, results = tuning.search("ridge", train, pre.feature_names, params.cv_folds,
                                         "grid", seed=params.random_state)
    rows = [(float(hp["alpha"]), mean, std, hp == best) for hp, mean, std in results]
    return round_doubles(spark.createDataFrame(
        rows, "alpha double, mean_cv_score double, std_cv_score double, is_best boolean"))


def q_workflow_lineitem(spark, sf):
    from regressa.config import RegressionParams
    from regressa.plans import workflow

    params = RegressionParams(models_to_include=("linear", "ridge", "lasso", "elastic_net"),
                              tuning_method="grid")
    li = lineitem_regression(spark, sf).select(*LINEITEM_KEY, *REGRESSION_FEATURES, "net_price")
    res = workflow.run_workflow(li, "net_price", params, LINEITEM_KEY)
    stages = [(k, bool(v)) for k, v in res.stages.items()]
    out = spark.createDataFrame(stages, "stage string, ok boolean")
    return out.withColumn("best_model", F.lit(res.best_name)).withColumn(
        "tuned", F.lit(bool(res.tuning.get("accepted"))))


def _from_comparison(fn):
    def q(spark, sf):
        comp, _, _, _, _ = _comparison(spark, sf, ["linear", "ridge", "lasso", "elastic_net"])
        return round_doubles(fn(comp))
    return q


def q_shapiro_part(spark, sf):
    """I6 on a table small enough for the test (part: OLS of retail price on
    part key, test rows)."""
    from regressa.operators import diagnostics
    from regressa.plans import models

    part = encode.exact_split(table(spark, sf, "part"), ["p_partkey"], 0.2, 42)
    data = part.select("p_partkey", "is_test", F.col("p_partkey").cast("double").alias("x"),
                       F.col("p_retailprice").alias("y"))
    fit = models.fit_model("linear", data.where(~F.col("is_test")), ["x"])
    pred = fit.predict(data.where(F.col("is_test")))
    return round_doubles(diagnostics.shapiro_wilk(pred, ["p_partkey"]))


def flagship(spark, sf):
    """validate -> fill -> one-hot -> exact split -> scale -> linear + ridge
    with 5-fold CV -> ranked comparison."""
    from regressa.config import RegressionParams
    from regressa.plans import workflow

    params = RegressionParams(models_to_include=("linear", "ridge"), hyperparameter_tuning=False)
    li = lineitem_regression(spark, sf).select(*LINEITEM_KEY, *REGRESSION_FEATURES, "net_price")
    res = workflow.run_workflow(li, "net_price", params, LINEITEM_KEY)
    if not res.success:
        raise RuntimeError(f"workflow failed: {res.stages}")
    return res.comparison


QUERIES.update({
    "model_comparison_lineitem": q_model_comparison_lineitem,
    "cv_summary_lineitem": q_cv_summary_lineitem,
    "random_forest_lineitem": _single_model("random_forest"),
    "gradient_boosting_lineitem": _single_model("gradient_boosting"),
    "svr_lineitem": _single_model("svr"),
    "feature_importance_lineitem": q_feature_importance_lineitem,
    "tuning_ridge_lineitem": q_tuning_ridge_lineitem,
    "workflow_lineitem": q_workflow_lineitem,
    "shapiro_part": q_shapiro_part,
    "recommendations_lineitem": _from_comparison(diagnostics.recommendations),
    "interpretation_lineitem": _from_comparison(
        lambda c: diagnostics.interpretation(c, "net_price")),
    "complexity_vs_r2_lineitem": _from_comparison(chartdata.complexity_vs_r2),
    "cv_error_bars_lineitem": _from_comparison(chartdata.cv_error_bars),
})


# --- more profiling / validation queries ------------------------------------

def q_memory_usage_lineitem(spark, sf):
    return profile.memory_usage(table(spark, sf, "lineitem"))


def q_null_counts_documents(spark, sf):
    return profile.null_counts(documents_labelled(spark, sf))


def q_row_change_documents(spark, sf):
    d = documents_labelled(spark, sf)
    return profile.row_change(d, clean.drop_null_rows(d))


def q_scoring_input_check_lineitem(spark, sf):
    """V9 on a scoring batch: lineitem whose quantity column is blanked (an
    upstream failure), checked against a feature list that also expects a
    column the batch lacks."""
    batch = table(spark, sf, "lineitem").withColumn("l_quantity",
                                                    F.lit(None).cast("double"))
    expected = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                "l_linestatus", "l_comment"]
    return validate.validate_scoring_input(batch.drop("l_orderkey", "l_partkey", "l_suppkey",
                                                      "l_linenumber"), expected)


QUERIES.update({
    "memory_usage_lineitem": q_memory_usage_lineitem,
    "null_counts_documents": q_null_counts_documents,
    "row_change_documents": q_row_change_documents,
    "scoring_input_check_lineitem": q_scoring_input_check_lineitem,
})


# --- cross-validation of the closed-form model (A1, A7) ---------------------

def _ols_cv_scores(spark, sf):
    from regressa.plans import tuning

    li = lineitem_regression(spark, sf)
    sp = encode.exact_split(li, LINEITEM_KEY, 0.2, 42, folds=5)
    train = sp.where(~F.col("is_test")).select(
        "fold", F.col("l_extendedprice").alias("x"), F.col("net_price").alias("y")).cache()
    scores = tuning.cross_val_scores("linear", train, ["x"], {}, 5, "r2")
    return spark.createDataFrame([("linear", i, float(s)) for i, s in enumerate(scores)],
                                 "Model string, fold int, score double")


def q_cv_scores_ols_lineitem(spark, sf):
    return _rounded(_ols_cv_scores(spark, sf), {"score": 6})


def q_cv_summary_ols_lineitem(spark, sf):
    from regressa.operators import metrics

    return _rounded(metrics.cv_summary(_ols_cv_scores(spark, sf)),
                    {"mean_cv_score": 6, "std_dev": 6, "min_score": 6, "max_score": 6})


QUERIES.update({
    "cv_scores_ols_lineitem": q_cv_scores_ols_lineitem,
    "cv_summary_ols_lineitem": q_cv_summary_ols_lineitem,
})


def q_shapiro_statistic_part(spark, sf):
    """I6 statistic (W) alone: the order statistics and weights are SQL-checkable."""
    return q_shapiro_part(spark, sf).select("n", F.round("statistic", 6).alias("statistic"))


QUERIES.update({"shapiro_statistic_part": q_shapiro_statistic_part})
