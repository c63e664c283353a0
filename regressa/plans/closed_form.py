"""Queries on models with one or two features, whose fits SQL can write down, and on scoring,
files and encoders away from the plain case; each with its DuckDB oracle.

With the scaled feature ``x`` the four linear models are one formula in the sums of the training
rows: ``slope = soft(cov(x, y), l1) / (var(x) + l2)``, where ridge has ``l2 = alpha / n``."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regressa import messages as M
from regressa.config import RegressionParams
from regressa.functions.columns import col
from regressa.operators import chartdata, clean, diagnostics, encode, metrics, score
from regressa.plans import models, tuning
from regressa.plans.oracle import LI, LI_HASH, LI_KEY, LI_NULLS, _positive_zero, _R2, _split_cte
from regressa.plans.queries import (LINEITEM_KEY, NET_PRICE, _rounded, lineitem_regression,
                                    lineitem_with_nulls)
from regressa.session import ensure_checkpoint_dir
from regressa.sources import files, model_store
from regressa.sources.tables import table

FOLDS = 5
#: Penalties strong enough to tell the models apart.
FAMILY = {"linear": {}, "ridge": {"alpha": 1000.0}, "lasso": {"alpha": 50.0},
          "elastic_net": {"alpha": 0.1, "l1_ratio": 0.5}}


def _scaled_split(spark: SparkSession, sf: str, columns: dict[str, str]) -> DataFrame:
    """Split and folded lineitem rows with scaled features (E4 of the training rows), assembled."""
    parts = encode.exact_split(lineitem_regression(spark, sf), LINEITEM_KEY, 0.2, 42, folds=FOLDS) \
        .select("is_test", "fold", F.col("net_price").alias("y"),
                *[F.col(c).alias(x) for x, c in columns.items()]).cache()
    scaler = encode.fit_scaler(parts.where(~F.col("is_test")), list(columns))
    return models.assemble(scaler.transform(parts), list(columns)).cache()


def _sides(spark, sf, columns=None):
    data = _scaled_split(spark, sf, columns or {"x": "l_extendedprice"})
    return data.where(~F.col("is_test")), data.where(F.col("is_test"))


def _comparison(spark, sf, cv: bool = False) -> DataFrame:
    """A6 over the linear family; cross-validated where asked for."""
    train, test = _sides(spark, sf)
    rows = []
    for name, hp in FAMILY.items():
        fit = models.fit_model(name, train, ["x"], hp)
        row = {"Model": name, **metrics.metrics_dict(fit.predict(test))}
        if cv:
            scores = tuning.cross_val_scores(name, train, ["x"], hp, FOLDS)
            mean = sum(scores) / FOLDS
            row |= {"cv_mean": mean,
                    "cv_std": (sum((s - mean) ** 2 for s in scores) / FOLDS) ** 0.5}
        rows.append(row)
    return metrics.comparison_table(spark, rows)


def q_family_coefficients_lineitem(spark, sf):
    """M1-M4 fitted on the training rows."""
    train, _ = _sides(spark, sf)
    fits = {name: models.fit_model(name, train, ["x"], hp).model for name, hp in FAMILY.items()}
    rows = [(name, float(m.coefficients[0]), float(m.intercept)) for name, m in fits.items()]
    return _rounded(spark.createDataFrame(rows, "Model string, slope double, intercept double"),
                    {"slope": 2, "intercept": 2})


def q_family_comparison_lineitem(spark, sf):
    return _rounded(_comparison(spark, sf, cv=True).drop("test_mape"),
                    {"cv_mean": 6, "cv_std": 6, "test_r2": 6, "test_rmse": 2, "test_mae": 2})


def q_family_metrics_lineitem(spark, sf):
    """A8."""
    return _rounded(metrics.metrics_table(_comparison(spark, sf)), {"r2": 6, "rmse": 2, "mae": 2})


def q_family_error_bars_lineitem(spark, sf):
    """G6."""
    return _rounded(chartdata.cv_error_bars(_comparison(spark, sf, cv=True)),
                    {"cv_mean": 6, "low": 6, "high": 6})


def q_family_complexity_lineitem(spark, sf):
    """G5."""
    return _rounded(chartdata.complexity_vs_r2(_comparison(spark, sf)),
                    {"test_r2": 6, "test_rmse": 2})


def q_family_recommendations_lineitem(spark, sf):
    """I9."""
    return diagnostics.recommendations(_comparison(spark, sf))


def q_family_interpretation_lineitem(spark, sf):
    """I10."""
    return diagnostics.interpretation(_comparison(spark, sf), "net_price")


def q_family_ridge_search_lineitem(spark, sf):
    """H1, H4-H6: the whole ridge grid, and whether its best candidate replaces alpha = 1."""
    train, test = _sides(spark, sf)
    best, _, results = tuning.search("ridge", train, ["x"], FOLDS, "grid")
    r2 = [metrics.metrics_dict(models.fit_model("ridge", train, ["x"], hp).predict(test))["test_r2"]
          for hp in ({"alpha": 1.0}, best)]
    accepted = tuning.accept(*r2)
    rows = [(float(hp["alpha"]), mean, std, hp == best, accepted) for hp, mean, std in results]
    return _rounded(spark.createDataFrame(
        rows, "alpha double, mean_score double, std_score double, is_best boolean, "
              "accepted boolean"), {"mean_score": 6, "std_score": 6})


def q_importance_ols_lineitem(spark, sf):
    """Coefficients of two scaled features by size."""
    names = {"price": "l_extendedprice", "tax": "l_tax"}
    train, _ = _sides(spark, sf, names)
    importances, method = models.fit_model("linear", train, list(names)).importances()
    return _rounded(diagnostics.top_features(diagnostics.feature_importance(
        spark, list(names), importances, method), 20), {"importance": 2})


PERMUTED = {"l_extendedprice": "x1", "l_tax": "x2"}


def _permuted(spark, sf):
    li = encode.exact_split(lineitem_regression(spark, sf), LINEITEM_KEY, 0.2, 42) \
        .select(*LINEITEM_KEY, "is_test", F.col("net_price").alias("y"),
                *[F.col(c).alias(x) for c, x in PERMUTED.items()]).cache()
    fit = models.fit_model("linear", li.where(~F.col("is_test")), list(PERMUTED.values()))
    return diagnostics.permutation_importance(li.where(F.col("is_test")), LINEITEM_KEY,
                                              list(PERMUTED.values()), fit.predict)


def q_permutation_importance_lineitem(spark, sf):
    """I1 by permutation: the fall of R2 of a two-feature OLS on the test rows."""
    return _rounded(_permuted(spark, sf).drop("method"), {"importance": 6})


def q_select_by_importance_lineitem(spark, sf):
    """C12 by importance: the better one of two features."""
    best = clean.select_features_by_importance(_permuted(spark, sf), 1)
    return spark.createDataFrame([(c,) for c in best], "feature string")


def _permutation_sql() -> str:
    """Normal equations of two features, and foreign values by ranks in the order of the key hash."""
    shift = {x: int(hashlib.md5(f"{x}:42".encode()).hexdigest()[:8], 16) for x in PERMUTED.values()}
    cov = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in (
        ("x1", "x1"), ("x2", "x2"), ("x1", "x2"), ("x1", "y"), ("x2", "y")))
    return (f"WITH s AS (SELECT *, net_price AS y, l_extendedprice AS x1, l_tax AS x2 FROM {_split_cte(LI)}), "
            f"c AS (SELECT {cov}, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM s WHERE NOT is_test), "
            "f AS (SELECT *, (x1y * x2x2 - x2y * x1x2) / (x1x1 * x2x2 - x1x2 * x1x2) AS b1, "
            "(x2y * x1x1 - x1y * x1x2) / (x1x1 * x2x2 - x1x2 * x1x2) AS b2 FROM c), "
            f"t AS (SELECT y, x1, x2, row_number() OVER (ORDER BY {LI_HASH}, {LI_KEY}) - 1 AS r, "
            "count(*) OVER () AS n FROM s WHERE is_test), "
            "d AS (SELECT t.*, p.x1 AS d1, q.x2 AS d2 FROM t "
            f"JOIN t p ON p.r = (t.r + 1 + {shift['x1']} % (t.n - 1)) % t.n "
            f"JOIN t q ON q.r = (t.r + 1 + {shift['x2']} % (t.n - 1)) % t.n), "
            "e AS (SELECT y, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e0, "
            "y - my - b1 * (d1 - m1) - b2 * (x2 - m2) AS e1, "
            "y - my - b1 * (x1 - m1) - b2 * (d2 - m2) AS e2 FROM d, f), "
            "i AS (SELECT 'x1' AS feature, (avg(e1 * e1) - avg(e0 * e0)) / var_pop(y) AS importance FROM e "
            "UNION ALL SELECT 'x2', (avg(e2 * e2) - avg(e0 * e0)) / var_pop(y) FROM e) ")


def _price_scorer(spark, sf):
    """The preprocessor and the model of net_price by extended price, of the training rows."""
    li = lineitem_regression(spark, sf)
    train = encode.exact_split(li, LINEITEM_KEY, 0.2, 42).where(~F.col("is_test")) \
        .select("l_extendedprice", "net_price").cache()
    pre = models.fit_preprocessor(train, "net_price", RegressionParams(), scale=False)
    return li, pre, models.fit_model("linear", pre.transform(train), pre.feature_names)


def _score_gaps(li: DataFrame, pre, fit) -> DataFrame:
    """Scores of lineitem without the extended prices of quantity 50."""
    batch = li.withColumn("l_extendedprice",
                          F.expr("CASE WHEN l_quantity <> 50 THEN l_extendedprice END"))
    scored = score.score_validated(batch.select(*LINEITEM_KEY, "l_extendedprice"), pre, fit,
                                   keep=LINEITEM_KEY)
    if not scored.success:
        raise ValueError(scored.errors)
    return _rounded(scored.predictions, {"predicted_net_price": 1})


def q_score_with_nulls_lineitem(spark, sf):
    """Gaps at scoring in a column that training had whole take the training median."""
    return _score_gaps(*_price_scorer(spark, sf))


def q_stored_model_lineitem(spark, sf):
    """The same scores from the model as it was saved and loaded again."""
    li, pre, fit = _price_scorer(spark, sf)
    path = _new_folder(spark, "model")
    model_store.save_model(path, spark, pre, fit)
    pre, fit, _ = model_store.load_model(path, spark)
    return _score_gaps(li, pre, fit)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_predictions_csv_lineitem(spark, sf):
    """Predictions written as CSV and read again."""
    li, pre, fit = _price_scorer(spark, sf)
    scored = score.score_batch(li, pre, fit, keep=LINEITEM_KEY)
    path = _new_folder(spark, "predictions")
    files.write_predictions(scored, path)
    return _rounded(files.read_csv(spark, path, schema=scored.schema), {"predicted_net_price": 1})


def q_csv_customer(spark, sf):
    """The table written as CSV and read again with inferred types."""
    customer = table(spark, sf, "customer")
    path = _new_folder(spark, "customer")
    files.write_predictions(customer, path)
    back = files.read_csv(spark, path)
    # Inference finds the narrowest type that holds all values; widen it to the table's.
    return back.select(*[(col(f.name).cast(f.dataType)).alias(f.name) for f in customer.schema])


def q_label_unseen_orders(spark, sf):
    """Codes fitted without the pending orders, on all orders: their status is -1."""
    orders = table(spark, sf, "orders")
    seen = orders.where("o_orderstatus <> 'P'")
    return encode.fit_label(seen, ["o_orderstatus"]).transform(
        orders.select("o_orderkey", "o_orderstatus"))


def q_onehot_vector_orders(spark, sf):
    """E1 as vectors, shown as lists."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    cols = ["o_orderstatus", "o_orderpriority"]
    made = encode.fit_one_hot_vector(orders, cols).transform(orders)
    return made.select("o_orderkey", *[F.array_join(F.transform(
        vector_to_array(f"{c}_onehot"), lambda x: x.cast("int").cast("string")), ",").alias(c)
        for c in cols])


def q_align_onehot_lineitem(spark, sf):
    """Dummies of a feed that lost a return flag, put into the columns of training."""
    expected = encode.fit_one_hot(table(spark, sf, "lineitem"),
                                  ["l_returnflag", "l_linestatus"]).output_columns()
    feed = lineitem_with_nulls(spark, sf).select(*LINEITEM_KEY, "l_returnflag", "l_linestatus")
    dummies = encode.fit_one_hot(feed, ["l_returnflag", "l_linestatus"]).transform(feed)
    return encode.select_features(encode.align_columns(dummies, [*LINEITEM_KEY, *expected]),
                                  [*LINEITEM_KEY, *expected])


def q_preprocessing_log_lineitem(spark, sf):
    """C14: the steps that fitting the preprocessor took."""
    rows = lineitem_with_nulls(spark, sf).withColumn("net_price", F.expr(NET_PRICE))
    pre = models.fit_preprocessor(rows, "net_price", RegressionParams(), [
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    return clean.steps_frame(spark, pre.steps)


QUERIES = {
    "family_coefficients_lineitem": q_family_coefficients_lineitem,
    "family_comparison_lineitem": q_family_comparison_lineitem,
    "family_metrics_lineitem": q_family_metrics_lineitem,
    "family_error_bars_lineitem": q_family_error_bars_lineitem,
    "family_complexity_lineitem": q_family_complexity_lineitem,
    "family_recommendations_lineitem": q_family_recommendations_lineitem,
    "family_interpretation_lineitem": q_family_interpretation_lineitem,
    "family_ridge_search_lineitem": q_family_ridge_search_lineitem,
    "importance_ols_lineitem": q_importance_ols_lineitem,
    "permutation_importance_lineitem": q_permutation_importance_lineitem,
    "select_by_importance_lineitem": q_select_by_importance_lineitem,
    "score_with_nulls_lineitem": q_score_with_nulls_lineitem,
    "stored_model_lineitem": q_stored_model_lineitem,
    "predictions_csv_lineitem": q_predictions_csv_lineitem,
    "csv_customer": q_csv_customer,
    "label_unseen_orders": q_label_unseen_orders,
    "onehot_vector_orders": q_onehot_vector_orders,
    "align_onehot_lineitem": q_align_onehot_lineitem,
    "preprocessing_log_lineitem": q_preprocessing_log_lineitem,
}


# --- oracles ------------------------------------------------------------------

def _family(candidates: str) -> str:
    """CTEs of the linear family; ``candidates`` are rows (Model, l1, l2, l2 to be divided by n).
    Fold -1 stands for the fit on all training rows."""
    return (
        f"WITH s AS {_split_cte(LI)}, c AS (SELECT count(*) FILTER (WHERE is_test) AS nt, "
        "count(*) FILTER (WHERE NOT is_test) AS ntr FROM s), "
        "m AS (SELECT avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd FROM s "
        "WHERE NOT is_test), "
        "d AS (SELECT is_test, (l_extendedprice - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS x, "
        "net_price AS y, CAST(CASE WHEN split_rank - nt - 1 < (ntr % 5) * (ntr // 5 + 1) "
        "THEN (split_rank - nt - 1) // (ntr // 5 + 1) "
        "ELSE (ntr % 5) + (split_rank - nt - 1 - (ntr % 5) * (ntr // 5 + 1)) // (ntr // 5) "
        "END AS INTEGER) AS fold FROM s, c, m), "
        "tr AS (SELECT * FROM d WHERE NOT is_test), "
        "fs AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, "
        "sum(x * y) AS sxy FROM tr GROUP BY fold), "
        "tot AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, "
        "sum(sxy) AS sxy FROM fs), "
        "co AS (SELECT fs.fold, tot.n - fs.n AS n, tot.sx - fs.sx AS sx, tot.sy - fs.sy AS sy, "
        "tot.sxx - fs.sxx AS sxx, tot.sxy - fs.sxy AS sxy FROM fs, tot "
        "UNION ALL SELECT -1, n, sx, sy, sxx, sxy FROM tot), "
        "cov AS (SELECT fold, n, sx / n AS mx, sy / n AS my, sxx / n - (sx / n) * (sx / n) AS vx, "
        "sxy / n - (sx / n) * (sy / n) AS vxy FROM co), "
        f"candidates(\"Model\", l1, l2, l2n) AS ({candidates}), "
        "fit AS (SELECT \"Model\", fold, mx, my, sign(vxy) * greatest(abs(vxy) - l1, 0) / "
        "(vx + l2 + l2n / n) AS b FROM cov, candidates), "
        "te AS (SELECT \"Model\", y, my + b * (x - mx) AS prediction FROM d, fit "
        "WHERE is_test AND fit.fold = -1), "
        f"test AS (SELECT \"Model\", {_R2} AS test_r2, "
        "sqrt(avg((y - prediction) * (y - prediction))) AS test_rmse, "
        "avg(abs(y - prediction)) AS test_mae FROM te GROUP BY \"Model\"), "
        "cvp AS (SELECT \"Model\", tr.fold, y, my + b * (x - mx) AS prediction FROM tr JOIN fit "
        "ON tr.fold = fit.fold), "
        f"cvs AS (SELECT \"Model\", fold, {_R2} AS score FROM cvp GROUP BY \"Model\", fold), "
        "cv AS (SELECT \"Model\", avg(score) AS cv_mean, stddev_pop(score) AS cv_std FROM cvs "
        "GROUP BY \"Model\"), "
        "best AS (SELECT * FROM test ORDER BY test_r2 DESC, \"Model\" LIMIT 1) ")


_FAMILY = _family("VALUES ('linear', 0::DOUBLE, 0::DOUBLE, 0::DOUBLE), ('ridge', 0, 0, 1000), "
                  "('lasso', 50, 0, 0), ('elastic_net', 0.05, 0.05, 0)")
_GRID = _family("SELECT alpha::VARCHAR, 0::DOUBLE, 0::DOUBLE, alpha FROM "
                "(VALUES (0.1::DOUBLE), (1), (10), (100), (1000)) g(alpha)")


def _text(parts: tuple[str, str, str]) -> str:
    title, detail, kind = (p.replace("'", "''") for p in parts)
    return f"'{title}' AS title, '{detail}' AS detail, '{kind}' AS kind"


_PRICE_FIT = (f"WITH s AS {_split_cte(LI)}, fit AS (SELECT regr_slope(net_price, l_extendedprice) "
              "AS b, regr_intercept(net_price, l_extendedprice) AS a, median(l_extendedprice) AS mid "
              "FROM s WHERE NOT is_test) ")

_SCORED_GAPS = (
    _PRICE_FIT + f"SELECT {LI_KEY}, round(a + b * CASE WHEN l_quantity <> 50 THEN l_extendedprice "
    "ELSE mid END, 1) AS predicted_net_price, CAST(0.8 AS DOUBLE) AS confidence FROM s, fit")

ORACLE = {name: _positive_zero(sql) for name, sql in {
    "family_coefficients_lineitem": (
        _FAMILY + "SELECT \"Model\", round(b, 2) AS slope, round(my - b * mx, 2) AS intercept "
        "FROM fit WHERE fold = -1"),
    "family_comparison_lineitem": (
        _FAMILY + "SELECT test.\"Model\", round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, "
        "round(test_r2, 6) AS test_r2, round(test_rmse, 2) AS test_rmse, "
        "round(test_mae, 2) AS test_mae FROM test JOIN cv ON test.\"Model\" = cv.\"Model\""),
    "family_metrics_lineitem": (
        _FAMILY + "SELECT \"Model\", round(test_r2, 6) AS r2, round(test_rmse, 2) AS rmse, "
        "round(test_mae, 2) AS mae FROM test"),
    "family_error_bars_lineitem": (
        _FAMILY + "SELECT \"Model\", round(cv_mean, 6) AS cv_mean, round(cv_mean - cv_std, 6) AS low, "
        "round(cv_mean + cv_std, 6) AS high FROM cv"),
    "family_complexity_lineitem": (
        _FAMILY + "SELECT \"Model\", CAST(CASE \"Model\" WHEN 'linear' THEN 1 WHEN 'elastic_net' "
        "THEN 3 ELSE 2 END AS INTEGER) AS complexity, round(test_r2, 6) AS test_r2, "
        "round(test_rmse, 2) AS test_rmse FROM test"),
    "family_recommendations_lineitem": (
        _FAMILY + f"SELECT \"Model\", {_text(M.REC_LOW_R2)} FROM best WHERE test_r2 < 0.5 UNION ALL "
        f"SELECT \"Model\", {_text(M.REC_MODERATE_R2)} FROM best WHERE test_r2 >= 0.5 AND test_r2 < 0.7 "
        f"UNION ALL SELECT \"Model\", {_text(M.REC_GOOD_R2)} FROM best WHERE test_r2 >= 0.7 UNION ALL "
        f"SELECT \"Model\", {_text(M.REC_REGULARIZED)} FROM best WHERE \"Model\" <> 'linear'"),
    "family_interpretation_lineitem": (
        _FAMILY + "SELECT \"Model\", printf('"
        + M.INTERPRET_VARIANCE.format(target="net_price") + "', test_r2 * 100) AS text FROM best "
        "UNION ALL SELECT \"Model\", printf('" + M.INTERPRET_MAE + "', test_mae) FROM best "
        "UNION ALL SELECT \"Model\", printf('" + M.INTERPRET_RMSE + "', test_rmse) FROM best"),
    "family_ridge_search_lineitem": (
        _GRID + "SELECT cv.\"Model\"::DOUBLE AS alpha, round(cv_mean, 6) AS mean_score, "
        "round(cv_std, 6) AS std_score, cv_mean = max(cv_mean) OVER () AS is_best, "
        "(SELECT t.test_r2 - o.test_r2 > 0.001 FROM test t, test o WHERE o.\"Model\"::DOUBLE = 1 "
        "AND t.\"Model\" = (SELECT \"Model\" FROM cv ORDER BY cv_mean DESC LIMIT 1)) AS accepted "
        "FROM cv"),
    "permutation_importance_lineitem": (
        _permutation_sql() + "SELECT feature, round(importance, 6) AS importance FROM i"),
    "select_by_importance_lineitem": (
        _permutation_sql() + "SELECT feature FROM i ORDER BY importance DESC, feature LIMIT 1"),
    "importance_ols_lineitem": (
        f"WITH s AS {_split_cte(LI)}, k AS (SELECT covar_pop(l_extendedprice, net_price) AS py, "
        "covar_pop(l_tax, net_price) AS ty, covar_pop(l_extendedprice, l_tax) AS pt, "
        "var_pop(l_extendedprice) AS pp, var_pop(l_tax) AS tt FROM s WHERE NOT is_test) "
        "SELECT 'price' AS feature, round(abs((tt * py - pt * ty) / (pp * tt - pt * pt)) * sqrt(pp), 2) "
        "AS importance, 'Coefficient Magnitude' AS method FROM k UNION ALL "
        "SELECT 'tax', round(abs((pp * ty - pt * py) / (pp * tt - pt * pt)) * sqrt(tt), 2), "
        "'Coefficient Magnitude' FROM k"),
    "score_with_nulls_lineitem": _SCORED_GAPS,
    "stored_model_lineitem": _SCORED_GAPS,
    "predictions_csv_lineitem": (
        _PRICE_FIT + f"SELECT {LI_KEY}, round(a + b * l_extendedprice, 1) AS predicted_net_price "
        "FROM s, fit"),
    "csv_customer": "SELECT * FROM customer",
    "label_unseen_orders": (
        "WITH codes AS (SELECT o_orderstatus AS v, CAST(row_number() OVER (ORDER BY o_orderstatus) - 1 "
        "AS INTEGER) AS code FROM (SELECT DISTINCT o_orderstatus FROM orders "
        "WHERE o_orderstatus <> 'P')) SELECT o_orderkey, coalesce(code, -1) AS o_orderstatus "
        "FROM orders LEFT JOIN codes ON o_orderstatus = v"),
    "onehot_vector_orders": (
        "WITH " + ", ".join(
            f"{k} AS (SELECT v, row_number() OVER (ORDER BY v) - 2 AS p, count(*) OVER () - 1 AS w "
            f"FROM (SELECT DISTINCT {c} AS v FROM orders))"
            for k, c in (("a", "o_orderstatus"), ("b", "o_orderpriority")))
        + " SELECT o_orderkey, " + ", ".join(
            f"list_aggregate(list_transform(range({k}.w), lambda i: CAST(CAST(i = {k}.p AS INTEGER) "
            f"AS VARCHAR)), 'string_agg', ',') AS {c}"
            for k, c in (("a", "o_orderstatus"), ("b", "o_orderpriority")))
        + " FROM orders JOIN a ON o_orderstatus = a.v JOIN b ON o_orderpriority = b.v"),
    "align_onehot_lineitem": (
        f"SELECT {LI_KEY}, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, "
        "0 AS l_returnflag_R, CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus_O FROM lineitem"),
    "preprocessing_log_lineitem": (
        "WITH n AS (SELECT count(*) - count(l_quantity) AS q, count(*) - count(l_returnflag) AS f "
        f"FROM {LI_NULLS}), st AS ("
        "SELECT 1 AS o, 'Filled missing values in ''l_quantity'' with median' AS step FROM n "
        "WHERE q > 0 UNION ALL SELECT 2, 'Filled missing values in ''l_returnflag'' with mode' "
        "FROM n WHERE f > 0 UNION ALL SELECT 3, 'One-hot encoded 2 categorical columns' FROM n) "
        "SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS step_no, step FROM st"),
}.items()}
