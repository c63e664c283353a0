"""Interpretation and residual diagnostics.

Inputs are prediction frames ``(key..., y, prediction)``. Orderings
(heteroscedasticity groups, Shapiro-Wilk order statistics) use the
distributed row number; bins use exact quantile edges."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regressa import messages as M
from regressa.functions.columns import col
from regressa.functions.stats import kurtosis_unbiased, norm_ppf_sql, skewness_unbiased
from regressa.operators.clean import hash_of_keys
from regressa.operators.metrics import metric_aggs
from regressa.operators.ranking import exact_quantiles, order_statistics, with_row_number
from regressa.session import cut_lineage

# Labels of the four prediction bins, in order.
BIN_LABELS = ("Low", "Medium-Low", "Medium-High", "High")
# Shapiro-Wilk limit and heteroscedasticity ratio of the reference.
SHAPIRO_MAX_N = 5000
HETERO_RATIO = 3.0


def feature_importance(spark: SparkSession, feature_names, importances, method: str) -> DataFrame:
    """``(feature, importance, method)`` sorted by importance, descending.
    ``importances`` is the fitted model's bounded vector (tree importances or
    |coefficients|); ``None`` gives an empty frame (e.g. an RBF SVR)."""
    schema = "feature string, importance double, method string"
    if importances is None:
        return spark.createDataFrame([], schema)
    rows = [(f, float(v), method) for f, v in zip(feature_names, importances)]
    return spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most important features (a top-k report)."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def permutation_importance(data: DataFrame, key_cols, features, predict, y: str = "y",
                           seed: int = 42) -> DataFrame:
    """``(feature, importance, method)``: how much R2 falls when a feature's values are dealt to other
    rows, for any model; ``predict`` adds ``prediction`` to a frame with the features.

    Rows get ranks in a seeded order of their keys; a feature's value comes from the row a seeded
    number of ranks further on, so one ranking serves all features. Each rank gathers its foreign
    values in one narrow shuffle, the rows are scored once for every feature in one frame, and the
    losses are one aggregation."""
    features, key_cols = list(features), list(key_cols)
    names = [f"v{i}" for i in range(len(features))]
    thin = data.where(col(y).isNotNull()).select(
        hash_of_keys(data, key_cols, seed).alias("h"), *[col(c).alias(f"k{i}") for i, c in enumerate(key_cols)],
        col(y).cast("double").alias("t"), *[col(c).alias(v) for c, v in zip(features, names, strict=True)])
    order = ["h", *[f"k{i}" for i in range(len(key_cols))]]
    ranked = cut_lineage(with_row_number(thin, order, name="rank").drop(*order))
    n = ranked.count()
    schema = "feature string, importance double, method string"
    if n < 2:
        return data.sparkSession.createDataFrame([], schema)
    given = F.explode(F.array(*[F.struct(
        (F.pmod(F.col("rank") - 1 - permutation_shift(c, n, seed), F.lit(n)) + 1).alias("rank"),
        *[(F.col(v) if j == i else F.lit(None).cast(ranked.schema[v].dataType)).alias(f"d{j}")
          for j, v in enumerate(names)]) for i, c in enumerate(features)])).alias("e")
    dealt = ranked.select(given).select("e.*").groupBy("rank").agg(
        *[F.max(f"d{i}").alias(f"d{i}") for i in range(len(features))])
    # Number -1 keeps all of a row's own values; number i has a foreign value for feature i.
    joined = ranked.join(dealt, "rank").select("*", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1)))
                                               .alias("which"))
    scored = predict(joined.select("t", "which", *[
        F.when(F.col("which") == i, F.col(f"d{i}")).otherwise(F.col(v)).alias(c)
        for i, (c, v) in enumerate(zip(features, names, strict=True))]))
    loss = {r["which"]: (r["mse"], r["var"]) for r in scored.groupBy("which").agg(
        F.avg((F.col("t") - F.col("prediction")) ** 2).alias("mse"), F.var_pop("t").alias("var")).collect()}
    base, spread = loss[-1]
    rows = [(c, (loss[i][0] - base) / spread if spread else 0.0, "Permutation Importance")
            for i, c in enumerate(features)]
    return data.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")


def permutation_shift(feature: str, n: int, seed: int) -> int:
    """Ranks between a row and the one its foreign value comes from; never a multiple of ``n``."""
    return 1 + int(hashlib.md5(f"{feature}:{seed}".encode()).hexdigest()[:8], 16) % (n - 1)


def with_residuals(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """``residual = y - prediction``."""
    return pred.withColumn("residual", F.col(y) - F.col(p))


def residual_stats(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """I4: one row ``(mean, std, skewness, kurtosis)`` of the residuals: sample
    std and the bias-corrected skewness G1 and excess kurtosis G2."""
    r = F.col(y) - F.col(p)
    data = pred.select(r.alias("r"))
    return data.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"),
                    skewness_unbiased("r").alias("skewness"),
                    kurtosis_unbiased("r").alias("kurtosis"))


def residual_cards(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """``(mean, std, min, max)`` of residuals, population std."""
    r = F.col(y) - F.col(p)
    data = pred.select(r.alias("r"))
    return data.agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"),
                    F.min("r").alias("min"), F.max("r").alias("max"))


# Royston (1995), AS R94 polynomial coefficients, in natural
# order (constant term first): weights (c1, c2), small-sample mean and log-sd
# (c3, c4, with g for the transform), large-sample mean and log-sd (c5, c6).
_SW_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_SW_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SW_C3 = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SW_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_SW_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SW_C6 = (-0.4803, -0.082676, 0.0030302)
_SW_G = (-2.273, 0.459)


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_weights(n: int, summ2: float):
    """``(a_n, a_{n-1} or None, fac)``: the two adjusted extreme weights and the
    divisor that turns the remaining normal scores into weights."""
    nd = NormalDist()
    m_n = nd.inv_cdf((n - 0.375) / (n + 0.25))
    u = 1.0 / math.sqrt(n)
    a_n = m_n / math.sqrt(summ2) + _poly(_SW_C1, u)
    if n > 5:
        m_n1 = nd.inv_cdf((n - 1 - 0.375) / (n + 0.25))
        a_n1 = m_n1 / math.sqrt(summ2) + _poly(_SW_C2, u)
        fac = math.sqrt((summ2 - 2 * m_n ** 2 - 2 * m_n1 ** 2) /
                        (1 - 2 * a_n ** 2 - 2 * a_n1 ** 2))
        return a_n, a_n1, fac
    fac = math.sqrt((summ2 - 2 * m_n ** 2) / (1 - 2 * a_n ** 2))
    return a_n, None, fac


def shapiro_pvalue(w: float, n: int) -> float:
    """Royston's normalising transformation of ``W`` (exact for n = 3)."""
    if n == 3:
        return max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1.0:
        return 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = _poly(_SW_G, n)
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        mu, sig = _poly(_SW_C3, n), math.exp(_poly(_SW_C4, n))
    else:
        ln_n = math.log(n)
        mu, sig = _poly(_SW_C5, ln_n), math.exp(_poly(_SW_C6, ln_n))
    return 1.0 - NormalDist(mu, sig).cdf(y)


def shapiro_wilk(pred: DataFrame, key_cols, y: str = "y", p: str = "prediction",
                 calibrated_n: int = SHAPIRO_MAX_N) -> DataFrame:
    """Shapiro-Wilk test of the residuals (Royston's AS R94) for 3 rows or
    more; one row ``(n, statistic, p_value, is_normal, extrapolated)`` with
    ``is_normal = p > 0.05``. The p-value's approximation is calibrated up to
    ``calibrated_n`` rows; beyond it is given as ``extrapolated``.

    Order statistics come from the distributed row number; the expected
    normal scores ``m_i`` are an AS 241 column expression; only scalars (n and
    three sums) reach the driver."""
    spark = pred.sparkSession
    schema = "n long, statistic double, p_value double, is_normal boolean, extrapolated boolean"
    r = pred.select(*key_cols, (F.col(y) - F.col(p)).alias("r")).where(F.col("r").isNotNull())
    n = r.count()
    if n < 3:
        return spark.createDataFrame([(n, None, None, None, None)], schema)
    ranked = with_row_number(r, ["r", *key_cols], name="i")
    m_expr = norm_ppf_sql(f"(CAST(i AS DOUBLE) - CAST(0.375 AS DOUBLE)) / CAST({n + 0.25!r} AS DOUBLE)")
    ranked = ranked.withColumn("m", F.expr(m_expr))
    summ2 = ranked.agg(F.sum(F.col("m") * F.col("m")).alias("s")).first()["s"]
    i = F.col("i")
    if n == 3:
        a = F.when(i == 3, F.lit(math.sqrt(0.5))).when(i == 1, F.lit(-math.sqrt(0.5))) \
            .otherwise(F.lit(0.0))
    else:
        a_n, a_n1, fac = shapiro_weights(n, summ2)
        a = F.when(i == n, F.lit(a_n)).when(i == 1, F.lit(-a_n))
        if a_n1 is not None:
            a = a.when(i == n - 1, F.lit(a_n1)).when(i == 2, F.lit(-a_n1))
        a = a.otherwise(F.col("m") / F.lit(fac))
    s = ranked.agg(F.sum(a * F.col("r")).alias("num"),
                   (F.var_pop("r") * F.count("r")).alias("den")).first()
    if not s["den"]:
        return spark.createDataFrame([(n, None, None, None, None)], schema)
    w = min(1.0, (s["num"] ** 2) / s["den"])
    pval = shapiro_pvalue(w, n)
    return spark.createDataFrame([(n, w, pval, pval > 0.05, n > calibrated_n)], schema)


def heteroscedasticity(pred: DataFrame, key_cols, y: str = "y", p: str = "prediction") -> DataFrame:
    """Rows sorted by prediction (ties by key) split into 3 groups of
    ``n // 3`` (the last takes the rest); sample variance of the residuals per
    group. Returns ``(group, n, variance)`` plus, on every row, ``ratio`` =
    max/min variance and ``detected`` = ratio > 3."""
    data = pred.select(*key_cols, F.col(p).alias("__p"), (F.col(y) - F.col(p)).alias("__r"))
    n = data.count()
    size = max(n // 3, 1)
    # The value at each limit, and how many of the rows that share it lie below the limit.
    order = F.nanvl(F.col("__p").cast("double"), F.lit(None).cast("double"))
    data = data.withColumn("__p", F.coalesce(order, F.lit(float("-inf"))))  # missing ones come first
    at = order_statistics(data, {"__p": lambda m: [size - 1, 2 * size - 1]})["__p"][1]
    limits = [(at[r][0], r + 1 - at[r][1], at[r][2]) for r in (size - 1, 2 * size - 1) if r in at]
    above = sum((F.when(F.col("__p") > v, 1).otherwise(0) for v, _, _ in limits), F.lit(0))
    cut = sorted({v for v, inside, equal in limits if inside < equal})
    rows = data.select("__r", above.alias("group")) if not cut else \
        data.where(~F.col("__p").isin(cut)).select("__r", above.alias("group"))
    for v in cut:
        # A limit falls among equal predictions: those rows alone are ranked, by key.
        ranked = with_row_number(data.where(F.col("__p") == v), key_cols, name="__rn")
        first = sum(1 for w, _, _ in limits if w < v)
        past = sum((F.when(F.col("__rn") > inside, 1).otherwise(0)
                    for w, inside, _ in limits if w == v), F.lit(first))
        rows = rows.unionByName(ranked.select("__r", past.alias("group")))
    per = rows.groupBy(F.col("group").cast("int").alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("__r").alias("variance"))
    # ``per`` has three rows, so a whole-frame window over it is bounded.
    w = Window.partitionBy(F.lit(1))
    return per.select(
        "group", "n", "variance",
        F.try_divide(F.max("variance").over(w), F.min("variance").over(w)).alias("ratio"),
    ).withColumn("detected", F.coalesce(F.col("ratio") > HETERO_RATIO, F.lit(False)))


def performance_breakdown(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """I8: four right-closed bins of the prediction at its exact 25/50/75%
    quantiles (the lowest bin includes the minimum); count, r2, rmse, mae per
    bin. Duplicate edges raise, as ``qcut`` does."""
    edges = {r["prob"]: r["value"] for r in
             exact_quantiles(pred, [p], [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    q1, q2, q3 = edges.get(0.25), edges.get(0.5), edges.get(0.75)
    if q1 is None:
        raise ValueError("no predictions to bin")
    if len({edges[0.0], q1, q2, q3, edges[1.0]}) < 5:
        raise ValueError("bin edges must be unique (duplicate quantiles)")
    pc = F.col(p)
    label = (F.when(pc <= q1, BIN_LABELS[0]).when(pc <= q2, BIN_LABELS[1])
             .when(pc <= q3, BIN_LABELS[2]).otherwise(BIN_LABELS[3]))
    order = (F.when(pc <= q1, 0).when(pc <= q2, 1).when(pc <= q3, 2).otherwise(3))
    data = pred.where(pc.isNotNull() & F.col(y).isNotNull()).withColumn(
        "range", label).withColumn("__o", order)
    aggs = metric_aggs(y, p)
    out = data.groupBy("range", "__o").agg(*aggs)
    return out.orderBy("__o").select("range", F.col("n").alias("count"), "r2", "rmse", "mae")


def _rec(t) -> "F.Column":
    return F.struct(F.lit(t[0]).alias("title"), F.lit(t[1]).alias("detail"),
                    F.lit(t[2]).alias("kind"))


def recommendations(comparison: DataFrame) -> DataFrame:
    """Advice rows for the winning model: R2 < .5 low, < .7 moderate, else
    good; tree models and regularised models get a note."""
    best = comparison.orderBy(F.desc_nulls_last("test_r2"), "Model").limit(1)
    r2 = F.col("test_r2")
    perf = (F.when(r2 < 0.5, _rec(M.REC_LOW_R2)).when(r2 < 0.7, _rec(M.REC_MODERATE_R2))
            .otherwise(_rec(M.REC_GOOD_R2)))
    m = F.col("Model")
    model_note = (F.when(m.isin("random_forest", "gradient_boosting"), _rec(M.REC_TREE))
                  .when(m.isin("ridge", "lasso", "elastic_net"), _rec(M.REC_REGULARIZED)))
    rows = best.select("Model", F.explode(F.array(perf, model_note)).alias("rec"))
    return rows.where(F.col("rec").isNotNull()).select("Model", "rec.*")


def interpretation(comparison: DataFrame, target: str) -> DataFrame:
    """The three interpretation sentences for the winning model."""
    best = comparison.orderBy(F.desc_nulls_last("test_r2"), "Model").limit(1)
    return best.select("Model", F.explode(F.array(
        F.format_string(M.INTERPRET_VARIANCE.format(target=target), F.col("test_r2") * 100),
        F.format_string(M.INTERPRET_MAE, F.col("test_mae")),
        F.format_string(M.INTERPRET_RMSE, F.col("test_rmse")),
    )).alias("text"))
