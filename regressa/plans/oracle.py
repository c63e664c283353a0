"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark operators, from the operator semantics;
the only shared pieces are published numeric formulas (AS 241, the
Kolmogorov series)."""

from __future__ import annotations

NET_PRICE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
LI = f"(SELECT *, {NET_PRICE} AS net_price FROM lineitem)"


def _validate_sql(src: str, target: str, n_features: int, cats: list[str],
                  target_numeric: bool = True) -> str:
    d = ", ".join(f"count(DISTINCT {c}) AS d{i}" for i, c in enumerate(cats))
    d = (", " + d) if d else ""
    bad = "0" if target_numeric else (
        f"count_if({target} IS NOT NULL AND try_cast({target} AS DOUBLE) IS NULL)")
    parts = [
        "SELECT 'empty_table' AS check_name, 'error' AS severity, NULL::VARCHAR AS column_name, "
        "n::DOUBLE AS value, n = 0 AS failed FROM s",
        f"SELECT 'target_missing', 'error', '{target}', NULL::DOUBLE, false FROM s",
        f"SELECT 'target_all_null', 'error', '{target}', t_nn::DOUBLE, t_nn = 0 FROM s",
        f"SELECT 'target_valid_ratio', 'warning', '{target}', round(t_nn / n, 6), "
        f"coalesce(t_nn / n < 0.5, false) FROM s",
        f"SELECT 'target_not_numeric', 'error', '{target}', t_bad::DOUBLE, t_bad > 0 FROM s",
        f"SELECT 'no_features', 'error', NULL, {float(n_features)}, {str(n_features == 0).lower()} "
        "FROM s",
        "SELECT 'few_rows', 'warning', NULL, n::DOUBLE, n < 50 FROM s",
    ]
    parts += [f"SELECT 'high_cardinality', 'warning', '{c}', round(d{i} / n, 6), "
              f"coalesce(d{i} / n > 0.8, false) FROM s" for i, c in enumerate(cats)]
    return (f"WITH s AS (SELECT count(*) AS n, count({target}) AS t_nn, {bad} AS t_bad{d} "
            f"FROM {src}) " + " UNION ALL ".join(parts))


def _unpivot_union(cols: list[str], select_fn) -> str:
    return " UNION ALL ".join(select_fn(c) for c in cols)


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax", "net_price"]


def _describe_sql() -> str:
    def one(c):
        return (f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, "
                f"round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, "
                f"round(quantile_cont({c}, 0.25), 6) AS q25, "
                f"round(quantile_cont({c}, 0.5), 6) AS q50, "
                f"round(quantile_cont({c}, 0.75), 6) AS q75, "
                f"round(max({c})::DOUBLE, 6) AS max FROM {LI}")
    return _unpivot_union(LI_NUM, one)


#: The numeric columns of lineitem with the target.
LI_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "net_price"]


def _corr_sql() -> str:
    cols = LI_NUMBERS
    parts = []
    for a in cols:
        for b in cols:
            if a != b:
                parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
                             f"round(corr({a}, {b}), 6) AS corr FROM {LI}")
    return " UNION ALL ".join(parts)


def _target_corr_sql() -> str:
    cols = [c for c in LI_NUMBERS if c != "net_price"]
    return _unpivot_union(cols, lambda c: (
        f"SELECT '{c}' AS feature, round(corr({c}, net_price), 6) AS corr, "
        f"round(abs(corr({c}, net_price)), 6) AS abs_corr FROM {LI}"))


def _column_profile_customer() -> str:
    types = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
             "c_acctbal": "double", "c_mktsegment": "string"}
    return _unpivot_union(list(types), lambda c: (
        f"SELECT '{c}' AS column, '{types[c]}' AS dtype, count({c}) AS non_null, "
        f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_values "
        "FROM customer"))


def _missing_documents() -> str:
    cols = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
    src = ("(SELECT d.*, l.quality, l.toxic "
           "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
    inner = _unpivot_union(cols, lambda c: (
        f"SELECT '{c}' AS column, count(*) - count({c}) AS missing_count, count(*) AS n FROM {src}"))
    return ('SELECT "column", missing_count, round(missing_count * 100.0 / n, 2) AS missing_pct '
            f"FROM ({inner}) WHERE missing_count > 0")


def _summary(src: str, cols: list[str], n_num: int, n_cat: int, n_other: int) -> str:
    nulls = " + ".join(f"count(*) - count({c})" for c in cols)
    collist = ", ".join(cols)
    return (f"SELECT count(*) AS n_rows, {len(cols)} AS n_columns, {n_num} AS n_numeric, "
            f"{n_cat} AS n_categorical, {n_other} AS n_other, "
            f"CAST({nulls} AS BIGINT) AS total_missing, "
            f"CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {collist} FROM {src})) "
            f"AS BIGINT) AS duplicate_rows FROM {src}")


LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
O_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
          "o_orderpriority"]
O_DUP = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE year(o_orderdate) = 1995)"


ORACLE = {
    "validate_lineitem": _validate_sql(LI, "net_price", 11, ["l_returnflag", "l_linestatus"]),
    "validate_customer": _validate_sql("customer", "c_acctbal", 4, ["c_name", "c_mktsegment"]),
    "validate_nation": _validate_sql("nation", "n_regionkey", 2, ["n_name"]),
    "table_summary_lineitem": _summary("lineitem", LI_COLS, 8, 2, 1),
    "table_summary_dup_orders": _summary(O_DUP, O_COLS, 3, 2, 1),
    "column_profile_customer": _column_profile_customer(),
    "describe_lineitem": _describe_sql(),
    "missing_report_documents": _missing_documents(),
    "correlation_lineitem": _corr_sql(),
    "target_correlation_lineitem": _target_corr_sql(),
    "head_orders": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100",
    "numeric_domain_lineitem": _unpivot_union(
        LI_NUMBERS,
        lambda c: (f"SELECT '{c}' AS column, round(min({c})::DOUBLE, 6) AS min, "
                   f"round(max({c})::DOUBLE, 6) AS max, round(avg({c}), 6) AS mean FROM {LI}")),
    "categorical_domain_orders": _unpivot_union(
        ["o_orderstatus", "o_orderpriority"],
        lambda c: (f"SELECT '{c}' AS column, {c} AS value, count(*) AS count FROM orders "
                   f"WHERE {c} IS NOT NULL GROUP BY {c}")),
}


# --- cleaning -------------------------------------------------------------

LI_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
LI_NULLS = ("(SELECT * REPLACE (nullif(l_quantity, 50) AS l_quantity, "
            "nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem)")
DOCS = ("(SELECT d.*, l.quality, l.toxic FROM documents d "
        "LEFT JOIN labels l ON d.doc_id = l.doc_id)")
EV_GAPS = ("(SELECT * REPLACE (CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value) "
           "FROM events)")


def _mode_sql(col: str, src: str) -> str:
    return (f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1)")


LI_HASH = ("md5(concat_ws(':', concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
           "epoch_us(l_shipdate)), '42'))")


def _split_cte(src: str = "lineitem", hash_expr: str = LI_HASH, key: str = LI_KEY) -> str:
    return (f"(SELECT *, row_number() OVER (ORDER BY {hash_expr}, {key}) AS split_rank, "
            f"row_number() OVER (ORDER BY {hash_expr}, {key}) <= "
            f"ceil(count(*) OVER () * 0.2) AS is_test FROM {src})")


O_HASH = "md5(concat_ws(':', concat_ws('|', o_orderkey), '42'))"

ORACLE.update({
    "impute_lineitem": (
        f"SELECT {LI_KEY}, round(coalesce(l_quantity, (SELECT median(l_quantity) FROM {LI_NULLS})), 6) "
        f"AS l_quantity, coalesce(l_returnflag, {_mode_sql('l_returnflag', LI_NULLS)}) AS l_returnflag "
        f"FROM {LI_NULLS}"),
    "fill_mean_documents": (
        f"SELECT doc_id, text, lang, source, n_chars, round(coalesce(quality::DOUBLE, (SELECT avg(quality) FROM {DOCS})), 6) "
        f"AS quality, round(coalesce(toxic::DOUBLE, (SELECT avg(toxic) FROM {DOCS})), 6) AS toxic "
        f"FROM {DOCS}"),
    "fill_median_documents": (
        f"SELECT doc_id, text, lang, source, n_chars, round(coalesce(quality::DOUBLE, (SELECT median(quality) FROM {DOCS})), 6) "
        f"AS quality, round(coalesce(toxic::DOUBLE, (SELECT median(toxic) FROM {DOCS})), 6) AS toxic "
        f"FROM {DOCS}"),
    "fill_mode_documents": (
        f"SELECT doc_id, text, source, n_chars, coalesce(lang, {_mode_sql('lang', DOCS)}) AS lang, "
        f"coalesce(quality, {_mode_sql('quality', DOCS)}) AS quality, "
        f"coalesce(toxic, {_mode_sql('toxic', DOCS)}) AS toxic FROM {DOCS}"),
    "ffill_events": (
        f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EV_GAPS}"),
    "bfill_events": (
        f"SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {EV_GAPS}"),
    "ffill_events_by_user": (
        f"SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id "
        f"ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value "
        f"FROM {EV_GAPS}"),
    "drop_null_rows_documents": (
        "SELECT d.*, l.quality, l.toxic FROM documents d "
        "JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL AND d.lang IS NOT NULL AND d.source IS NOT NULL "
        "AND d.n_chars IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL"),
    "dedup_orders": f"SELECT DISTINCT * FROM {O_DUP}",
    "dedup_first_lineitem": (
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity, "
        "round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, "
        "round(l_tax, 6) AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem "
        "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
        "ORDER BY l_shipdate, l_partkey, l_suppkey) = 1"),
    "outliers_lineitem": (
        f"WITH t AS {LI}, s AS (SELECT avg(l_extendedprice) AS m1, stddev_samp(l_extendedprice) AS s1, "
        f"avg(net_price) AS m2, stddev_samp(net_price) AS s2 FROM t) "
        f"SELECT {LI_KEY}, round(l_extendedprice, 6) AS l_extendedprice, round(net_price, 6) AS net_price "
        f"FROM t, s WHERE abs(l_extendedprice - m1) <= 3 * s1 AND abs(net_price - m2) <= 3 * s2"),
    "select_features_lineitem": (
        f"SELECT {LI_KEY}, round(l_extendedprice, 6) AS l_extendedprice, "
        f"round(l_discount, 6) AS l_discount, round(net_price, 6) AS net_price FROM {LI}"),
    "capped_sample_lineitem": (
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity, "
        "round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, "
        "round(l_tax, 6) AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem "
        f"ORDER BY {LI_HASH}, {LI_KEY} LIMIT 5000"),
    "split_lineitem": f"SELECT {LI_KEY}, is_test FROM {_split_cte()}",
    "hash_split_lineitem": (
        f"SELECT {LI_KEY}, substring({LI_HASH}, 1, 8) < '33333333' AS is_test FROM lineitem"),
    "folds_lineitem": (
        f"WITH s AS {_split_cte()}, c AS (SELECT count(*) FILTER (WHERE is_test) AS nt, "
        f"count(*) FILTER (WHERE NOT is_test) AS ntr FROM s) "
        f"SELECT {LI_KEY}, is_test, CASE WHEN is_test THEN NULL ELSE CAST(CASE "
        f"WHEN split_rank - nt - 1 < (ntr % 5) * (ntr // 5 + 1) "
        f"THEN (split_rank - nt - 1) // (ntr // 5 + 1) "
        f"ELSE (ntr % 5) + (split_rank - nt - 1 - (ntr % 5) * (ntr // 5 + 1)) // (ntr // 5) "
        f"END AS INTEGER) END AS fold FROM s, c"),
    "onehot_lineitem": (
        f"SELECT {LI_KEY}, CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, "
        f"CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R, "
        f"CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus_O FROM lineitem"),
    "label_orders": (
        "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) "
        "AS o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) "
        "AS o_orderpriority FROM orders"),
    "target_encode_orders": (
        f"WITH s AS {_split_cte('orders', O_HASH, 'o_orderkey')}, "
        "tr AS (SELECT * FROM s WHERE NOT is_test), g AS (SELECT avg(o_totalprice) AS g FROM tr), "
        "a AS (SELECT o_orderstatus AS v, (sum(o_totalprice) + 10 * (SELECT g FROM g)) / "
        "(count(*) + 10) AS enc FROM tr GROUP BY 1), "
        "b AS (SELECT o_orderpriority AS v, (sum(o_totalprice) + 10 * (SELECT g FROM g)) / "
        "(count(*) + 10) AS enc FROM tr GROUP BY 1) "
        "SELECT o_orderkey, is_test, round(coalesce(a.enc, (SELECT g FROM g)), 6) AS o_orderstatus, "
        "round(coalesce(b.enc, (SELECT g FROM g)), 6) AS o_orderpriority FROM s "
        "LEFT JOIN a ON s.o_orderstatus = a.v LEFT JOIN b ON s.o_orderpriority = b.v"),
    "scale_lineitem": (
        f"WITH s AS {_split_cte()}, m AS (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in
                    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
        + " FROM s WHERE NOT is_test) SELECT " + LI_KEY + ", "
        + ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) AS {c}"
                    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
        + " FROM s, m"),
})


# --- single-feature OLS ------------------------------------------------------

from regressa.functions.stats import KS_EXACT_ROWS, ks_pvalue_sql, norm_ppf_sql  # noqa: E402
from regressa.plans.queries import WHOLE_DRIFT  # noqa: E402

OLS = (f"WITH s AS {_split_cte(LI)}, "
       "fit AS (SELECT regr_slope(net_price, l_extendedprice) AS b, "
       "regr_intercept(net_price, l_extendedprice) AS a FROM s WHERE NOT is_test), "
       f"allp AS (SELECT {LI_KEY}, is_test, l_extendedprice AS x, net_price AS y, "
       "a + b * l_extendedprice AS prediction FROM s, fit), "
       "t AS (SELECT * FROM allp WHERE is_test) ")

_R2 = ("CASE WHEN var_pop(y) * count(y) > 0 THEN 1 - sum((y - prediction) * (y - prediction)) / "
       "(var_pop(y) * count(y)) WHEN sum((y - prediction) * (y - prediction)) = 0 THEN 1.0 "
       "ELSE 0.0 END")


def _metrics_select(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return (f"SELECT {g}count(*) AS n, round({_R2}, 6) AS r2, "
            "round(sqrt(avg((y - prediction) * (y - prediction))), 4) AS rmse, "
            "round(avg(abs(y - prediction)), 4) AS mae, "
            "round(CASE WHEN count_if(y = 0) > 0 THEN 'inf'::DOUBLE "
            "ELSE avg(abs((y - prediction) / y)) * 100 END, 5) AS mape, "
            f"CAST(count_if(y = 0) AS BIGINT) AS zero_targets FROM {src}{gb}")


_HET = (OLS + ", n AS (SELECT count(*) AS n FROM t), "
        f"r AS (SELECT *, row_number() OVER (ORDER BY prediction, {LI_KEY}) AS rn FROM t), "
        "g AS (SELECT CAST(least(2, (rn - 1) // greatest(n // 3, 1)) AS INTEGER) AS \"group\", "
        "count(*) AS n, var_samp(y - prediction) AS variance FROM r, n GROUP BY 1) "
        "SELECT \"group\", n, round(variance, 2) AS variance, "
        "round(max(variance) OVER () / min(variance) OVER (), 6) AS ratio, "
        "coalesce(max(variance) OVER () / min(variance) OVER () > 3, false) AS detected FROM g")

_BREAK = (OLS + ", q AS (SELECT quantile_cont(prediction, 0.25) AS q1, "
          "quantile_cont(prediction, 0.5) AS q2, quantile_cont(prediction, 0.75) AS q3 FROM t), "
          "b AS (SELECT t.*, CASE WHEN prediction <= q1 THEN 'Low' WHEN prediction <= q2 "
          "THEN 'Medium-Low' WHEN prediction <= q3 THEN 'Medium-High' ELSE 'High' END AS range "
          "FROM t, q) SELECT range, count(*) AS count, round(" + _R2 + ", 6) AS r2, "
          "round(sqrt(avg((y - prediction) * (y - prediction))), 4) AS rmse, "
          "round(avg(abs(y - prediction)), 4) AS mae FROM b GROUP BY range")

_HIST = (OLS + ", r AS (SELECT y - prediction AS r FROM t), "
         "m AS (SELECT min(r) AS lo, max(r) AS hi, CASE WHEN max(r) > min(r) THEN "
         "(max(r) - min(r)) / 30 ELSE 1.0 END AS w FROM r), "
         "b AS (SELECT CAST(least(30, CAST(floor((r - lo) / w) AS INTEGER) + 1) AS INTEGER) "
         "AS bin, lo, w FROM r, m) "
         "SELECT bin, round(any_value(lo) + (bin - 1) * any_value(w), 3) AS lower, "
         "round(any_value(lo) + bin * any_value(w), 3) AS upper, count(*) AS count "
         "FROM b GROUP BY bin")

_QQ = (OLS + ", n AS (SELECT count(*) AS n FROM t), "
       f"r AS (SELECT row_number() OVER (ORDER BY y - prediction, {LI_KEY}) AS i, "
       "y - prediction AS sample FROM t) "
       "SELECT i, round(" + norm_ppf_sql("(CAST(0.01 AS DOUBLE) + CAST(0.98 AS DOUBLE) * (i - 1) / (n - 1))") +
       ", 6) AS theoretical, round(sample, 2) AS sample FROM r, n")


def _ks_exact(d: str, n: str, m: str) -> str:
    """Exact two-sample p-value by lattice paths, one diagonal a step of the fold: the list holds the
    first point inside the lines, then the chances to have met a line by each point inside."""
    h = f"round({d} * {n} * {m})"
    first = f"greatest(0, x[1] - {m}, floor((x[1] * {n} - {h}) / ({n} + {m})) + 1)"
    last = f"least(x[1], {n}, ceil((x[1] * {n} + {h}) / ({n} + {m})) - 1)"
    return (f"(list_reduce(list_transform(range(1, {n} + {m} + 1), lambda s: [s::DOUBLE]), lambda a, x: "
            f"list_concat([{first}], list_transform(range({first}::BIGINT, {last}::BIGINT + 1), lambda i: "
            "(i * CASE WHEN i - 1 < a[1] THEN 1.0 ELSE coalesce(a[(i + 1 - a[1])::BIGINT], 1.0) END "
            "+ (x[1] - i) * coalesce(a[(i + 2 - a[1])::BIGINT], 1.0)) / x[1])), "
            "[0.0::DOUBLE, 0.0::DOUBLE])[-1])")


def _ks_sql(shift: float) -> str:
    val = f"CASE WHEN is_ref THEN value ELSE value * {shift} END" if shift != 1.0 else "value"
    lam = "(sqrt(n_ref * n_new / (n_ref + n_new)) * d)"
    # Beyond lambda = 5 the p-value is below 1e-20 either way.
    p = (f"CASE WHEN {lam} > 5 THEN 0.0 WHEN greatest(n_ref, n_new) <= {KS_EXACT_ROWS} THEN "
         f"{_ks_exact('d', 'n_ref', 'n_new')} ELSE {ks_pvalue_sql(lam, dialect='duckdb')} END")
    return ("WITH ev AS (SELECT *, day(ts) <= 15 AS is_ref FROM events), "
            f"long AS (SELECT 'value' AS feature, ({val})::DOUBLE AS v, is_ref FROM ev "
            "UNION ALL SELECT 'user_id', user_id::DOUBLE, is_ref FROM ev), "
            "c AS (SELECT feature, v, count_if(is_ref) AS r, count_if(NOT is_ref) AS w "
            "FROM long WHERE v IS NOT NULL GROUP BY feature, v), "
            "cum AS (SELECT feature, "
            "sum(r) OVER (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING) AS cr, "
            "sum(w) OVER (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING) AS cw, "
            "sum(r) OVER (PARTITION BY feature) AS nr, sum(w) OVER (PARTITION BY feature) AS nw "
            "FROM c), "
            "st AS (SELECT feature, max(abs(cr / nr - cw / nw)) AS d, "
            "CAST(any_value(nr) AS BIGINT) AS n_ref, CAST(any_value(nw) AS BIGINT) AS n_new "
            f"FROM cum GROUP BY feature), pv AS (SELECT *, {p} AS p FROM st) "
            f"SELECT feature, 'kolmogorov_smirnov' AS test, round(d, 6) AS statistic, "
            "round(p, 6) AS p_value, n_ref, n_new, p < 0.05 AS drifted FROM pv")


_CHISQ = ("WITH ev AS (SELECT *, day(ts) <= 15 AS is_ref FROM events), "
          "a AS (SELECT event_type AS c, count(*) AS o FROM ev WHERE is_ref AND event_type "
          "IS NOT NULL GROUP BY 1), b AS (SELECT event_type AS c, count(*) AS o FROM ev "
          "WHERE NOT is_ref AND event_type IS NOT NULL GROUP BY 1), "
          "j AS (SELECT coalesce(a.o, 0) AS o_ref, coalesce(b.o, 0) AS o_new FROM a "
          "FULL OUTER JOIN b ON a.c = b.c), "
          "tot AS (SELECT sum(o_ref) AS n_ref, sum(o_new) AS n_new, count(*) AS k FROM j) "
          "SELECT 'event_type' AS feature, 'chi_square' AS test, round(sum(CASE WHEN e > 0 "
          "THEN (o_new - e) * (o_new - e) / e WHEN o_new > 0 THEN 'inf'::DOUBLE ELSE 0 END), 6) "
          "AS statistic, CAST(any_value(k) - 1 AS INTEGER) AS dof, "
          "CAST(any_value(n_ref) AS BIGINT) AS n_ref, CAST(any_value(n_new) AS BIGINT) AS n_new "
          "FROM (SELECT j.*, tot.*, o_ref * n_new / n_ref AS e FROM j, tot)")

_MEANSHIFT = ("WITH ev AS (SELECT *, day(ts) <= 15 AS is_ref, CASE WHEN day(ts) <= 15 THEN value "
              "ELSE value * 1.5 END AS v2 FROM events), "
              "x AS (SELECT 'value' AS feature, avg(v2) FILTER (WHERE NOT is_ref) AS rm, "
              "avg(v2) FILTER (WHERE is_ref) AS fm, stddev_samp(v2) FILTER (WHERE is_ref) AS fs "
              "FROM ev UNION ALL SELECT 'user_id', avg(user_id) FILTER (WHERE NOT is_ref), "
              "avg(user_id) FILTER (WHERE is_ref), stddev_samp(user_id) FILTER (WHERE is_ref) "
              "FROM ev) SELECT feature, round(rm, 6) AS recent_mean, round(fm, 6) AS reference_mean, "
              "round(fs, 6) AS reference_std, round(abs(rm - fm) / fs, 6) AS drift_magnitude, "
              "coalesce(abs(rm - fm) > 2 * fs, false) AS drifted FROM x")

_MET3 = ("SELECT 'r2' AS metric, {r2} AS value FROM {src} UNION ALL "
         "SELECT 'rmse', sqrt(avg((y - prediction) * (y - prediction))) FROM {src} UNION ALL "
         "SELECT 'mae', avg(abs(y - prediction)) FROM {src}")

_DEGR = (OLS + ", cur_t AS (SELECT t.*, a + b * x * 1.1 AS p2 FROM t, fit), "
         "cur AS (" + _MET3.format(r2=_R2.replace("prediction", "p2"), src="cur_t")
         .replace("(y - prediction)", "(y - p2)") + "), "
         "base AS (" + _MET3.format(r2=_R2, src="t") + "), "
         "d AS (SELECT cur.metric, cur.value AS current, base.value AS baseline, "
         "CASE WHEN cur.metric = 'r2' THEN base.value - cur.value ELSE cur.value - base.value END "
         "/ abs(base.value) * 100 AS degradation_pct FROM cur JOIN base ON cur.metric = base.metric) "
         "SELECT metric, round(current, 4) AS current, round(baseline, 4) AS baseline, "
         "round(degradation_pct, 4) AS degradation_pct, coalesce(degradation_pct > 10, false) "
         "AS degraded, CASE WHEN max(CASE WHEN degradation_pct > 10 THEN degradation_pct END) "
         "OVER () IS NULL THEN 'none' WHEN max(CASE WHEN degradation_pct > 10 THEN "
         "degradation_pct END) OVER () > 25 THEN 'high' WHEN max(CASE WHEN degradation_pct > 10 "
         "THEN degradation_pct END) OVER () > 15 THEN 'medium' ELSE 'low' END AS severity FROM d")

_ALERTS = (OLS + ", fed AS (SELECT t.*, CAST(year(l_shipdate) AS INTEGER) AS batch_year, "
           "a + b * CASE WHEN year(l_shipdate) >= 2000 THEN x * 1.1 ELSE x END AS p2 "
           "FROM t, fit), "
           "per AS (SELECT batch_year, " + _R2.replace("prediction", "p2") + " AS r2, "
           "sqrt(avg((y - p2) * (y - p2))) AS rmse, avg(abs(y - p2)) AS mae FROM fed "
           "GROUP BY batch_year), "
           "base AS (" + _MET3.format(r2=_R2, src="t") + "), "
           "lng AS (SELECT batch_year, 'r2' AS metric, r2 AS current FROM per UNION ALL "
           "SELECT batch_year, 'rmse', rmse FROM per UNION ALL SELECT batch_year, 'mae', mae "
           "FROM per), "
           "al AS (SELECT lng.batch_year, lng.metric, lng.current, base.value AS baseline, "
           "CASE WHEN lng.metric = 'r2' THEN base.value - lng.current ELSE lng.current - "
           "base.value END / abs(base.value) * 100 AS degradation_pct FROM lng JOIN base "
           "ON lng.metric = base.metric) ")
_ALERT_ROWS = ("SELECT batch_year, metric, round(current, 4) AS current, "
               "round(baseline, 4) AS baseline, round(degradation_pct, 4) AS degradation_pct, "
               "CASE WHEN degradation_pct > 25 THEN 'high' ELSE 'medium' END AS severity "
               "FROM al WHERE degradation_pct > 10")

ORACLE.update({
    "ols_metrics_lineitem": OLS + _metrics_select("t"),
    "score_lineitem": (
        f"WITH s AS {_split_cte(LI)}, "
        "fit AS (SELECT regr_slope(net_price, l_extendedprice) AS b, "
        "regr_intercept(net_price, l_extendedprice) AS a, avg(net_price) AS m, "
        "stddev_pop(net_price) AS sd FROM s WHERE NOT is_test) "
        f"SELECT {LI_KEY}, round(a + b * l_extendedprice, 1) AS predicted_net_price, "
        "CAST(0.8 AS DOUBLE) AS confidence, round((a + b * l_extendedprice - m) / sd, 4) AS z_vs_training, "
        "coalesce(abs((a + b * l_extendedprice - m) / sd) > 1, false) AS unusual FROM s, fit"),
    "prediction_summary_lineitem": (
        OLS + "SELECT count(prediction) AS count, round(avg(prediction), 4) AS mean, "
        "round(stddev_pop(prediction), 4) AS std FROM allp"),
    "residual_stats_lineitem": (
        OLS + "SELECT round(avg(y - prediction), 4) AS mean, "
        "round(stddev_samp(y - prediction), 4) AS std, round(skewness(y - prediction), 4) "
        "AS skewness, round(kurtosis(y - prediction), 4) AS kurtosis FROM t"),
    "residual_cards_lineitem": (
        OLS + "SELECT round(avg(y - prediction), 4) AS mean, "
        "round(stddev_pop(y - prediction), 4) AS std, round(min(y - prediction), 2) AS min, "
        "round(max(y - prediction), 2) AS max FROM t"),
    "heteroscedasticity_lineitem": _HET,
    "performance_breakdown_lineitem": _BREAK,
    "residual_histogram_lineitem": _HIST,
    "qq_points_lineitem": _QQ,
    "standardized_residuals_lineitem": (
        OLS + f"SELECT {LI_KEY}, round(prediction, 1) AS prediction, "
        "round((y - prediction) / (SELECT stddev_samp(y - prediction) FROM t), 4) "
        "AS std_residual FROM t"),
    "predicted_vs_actual_lineitem": (
        OLS + f"SELECT {LI_KEY}, round(y, 6) AS actual, round(prediction, 1) AS predicted, "
        "round(abs(y - prediction), 1) AS abs_error FROM t"),
    "identity_line_lineitem": (
        OLS + "SELECT round(least(min(y), min(prediction)), 2) AS lo, "
        "round(greatest(max(y), max(prediction)), 2) AS hi FROM t"),
    "prediction_range_lineitem": (
        OLS + "SELECT round(min(prediction), 2) AS min, round(max(prediction), 2) AS max FROM t"),
    "chisq_events": _CHISQ,
    "degradation_lineitem": _DEGR,
    "batch_monitor_lineitem": (
        OLS + "SELECT count(*) AS batch_size, count(prediction) AS successful_predictions, "
        "CAST(count(*) - count(prediction) AS BIGINT) AS failed_predictions, "
        f"round({_R2}, 6) AS r2, round(sqrt(avg((y - prediction) * (y - prediction))), 4) "
        "AS rmse, round(avg(abs(y - prediction)), 4) AS mae FROM t"),
    "batch_alerts_lineitem": _ALERTS + _ALERT_ROWS,
    "monitoring_recent_lineitem": (
        _ALERTS + ", rows AS (" + _ALERT_ROWS + ") SELECT * FROM rows ORDER BY batch_year * 10 + "
        "CASE WHEN metric = 'r2' THEN 2 WHEN metric = 'rmse' THEN 1 ELSE 0 END DESC LIMIT 10"),
    "monitoring_totals_lineitem": (
        _ALERTS + ", rows AS (" + _ALERT_ROWS + ") SELECT count(*) AS total_alerts, "
        "CAST(count_if(severity = 'high') AS BIGINT) AS high_severity, "
        "CAST(count_if(severity = 'medium') AS BIGINT) AS medium_severity FROM rows"),
})


_DOCS6 = ("(SELECT d.*, l.quality, l.toxic FROM documents d "
          "LEFT JOIN labels l ON d.doc_id = l.doc_id)")
_LI_WIDTH = {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4,
             "l_quantity": 8, "l_extendedprice": 8, "l_discount": 8, "l_tax": 8,
             "l_returnflag": None, "l_linestatus": None, "l_shipdate": 8}


def _mem_expr(c, w):
    return (f"CAST(coalesce(sum(octet_length({c}::BLOB)), 0) AS BIGINT)" if w is None
            else f"CAST(count({c}) * {w} AS BIGINT)")


ORACLE.update({
    "memory_usage_lineitem": (
        " UNION ALL ".join(f"SELECT '{c}' AS column, {_mem_expr(c, w)} AS bytes FROM lineitem"
                           for c, w in _LI_WIDTH.items())
        + " UNION ALL SELECT '__total__', CAST(" +
        " + ".join(_mem_expr(c, w) for c, w in _LI_WIDTH.items()) + " AS BIGINT) FROM lineitem"),
    "null_counts_documents": " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) - count({c}) AS null_count FROM {_DOCS6}"
        for c in ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]),
    "row_change_documents": (
        f"SELECT (SELECT count(*) FROM {_DOCS6}) AS original_rows, "
        f"(SELECT count(*) FROM {_DOCS6} WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND "
        "n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL) AS processed_rows, "
        f"(SELECT count(*) FROM {_DOCS6}) - (SELECT count(*) FROM {_DOCS6} WHERE text IS NOT NULL AND lang IS NOT NULL "
        "AND source IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT "
        "NULL) AS removed_rows"),
    "scoring_input_check_lineitem": (
        "SELECT 'missing_feature' AS check, 'error' AS severity, 'l_comment' AS column_name, "
        "true AS failed UNION ALL SELECT 'extra_feature', 'warning', 'l_shipdate', true "
        "UNION ALL SELECT 'all_null_feature', 'error', 'l_quantity', true UNION ALL "
        + " UNION ALL ".join(f"SELECT 'all_null_feature', 'error', '{c}', count({c}) = 0 "
                             "FROM lineitem" for c in ["l_extendedprice", "l_discount", "l_tax",
                                                       "l_returnflag", "l_linestatus"])),
})


_FOLDS = (f"WITH s AS {_split_cte(LI)}, c AS (SELECT count(*) FILTER (WHERE is_test) AS nt, "
          "count(*) FILTER (WHERE NOT is_test) AS ntr FROM s), "
          "tr AS (SELECT l_extendedprice AS x, net_price AS y, CAST(CASE "
          "WHEN split_rank - nt - 1 < (ntr % 5) * (ntr // 5 + 1) "
          "THEN (split_rank - nt - 1) // (ntr // 5 + 1) "
          "ELSE (ntr % 5) + (split_rank - nt - 1 - (ntr % 5) * (ntr // 5 + 1)) // (ntr // 5) "
          "END AS INTEGER) AS fold FROM s, c WHERE NOT is_test), "
          "fs AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, "
          "sum(x * y) AS sxy FROM tr GROUP BY fold), "
          "tot AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, "
          "sum(sxy) AS sxy FROM fs), "
          "co AS (SELECT fs.fold, tot.n - fs.n AS n, tot.sx - fs.sx AS sx, tot.sy - fs.sy AS sy, "
          "tot.sxx - fs.sxx AS sxx, tot.sxy - fs.sxy AS sxy FROM fs, tot), "
          "fit AS (SELECT fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, sx, sy, n FROM co), "
          "fit2 AS (SELECT fold, b, (sy - b * sx) / n AS a FROM fit), "
          "p AS (SELECT tr.fold, y, a + b * x AS prediction FROM tr JOIN fit2 ON tr.fold = fit2.fold), "
          "sc AS (SELECT fold, " + _R2 + " AS score FROM p GROUP BY fold) ")

ORACLE.update({
    "cv_scores_ols_lineitem": _FOLDS + "SELECT 'linear' AS Model, fold, round(score, 6) AS score FROM sc",
    "cv_summary_ols_lineitem": (
        _FOLDS + "SELECT 'linear' AS Model, round(avg(score), 6) AS mean_cv_score, "
        "round(stddev_pop(score), 6) AS std_dev, round(min(score), 6) AS min_score, "
        "round(max(score), 6) AS max_score FROM sc"),
})


def _poly_sql(coefs, x: str) -> str:
    return "(" + " + ".join(f"{c!r} * pow({x}, {i})" for i, c in enumerate(coefs)) + ")"


# Published AS R94 weight polynomials (Royston 1995), constant term first.
_SW_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_SW_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)

_PART = ("(SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', concat_ws('|', p_partkey), "
         "'42')), p_partkey) <= ceil(count(*) OVER () * 0.2) AS is_test FROM part)")
_SHAPIRO = (
    f"WITH s AS {_PART}, fit AS (SELECT regr_slope(p_retailprice, p_partkey) AS b, "
    "regr_intercept(p_retailprice, p_partkey) AS a FROM s WHERE NOT is_test), "
    "r AS (SELECT p_partkey, p_retailprice - (a + b * p_partkey) AS r FROM s, fit WHERE is_test), "
    "k AS (SELECT count(*) AS n FROM r), "
    "o AS (SELECT r, row_number() OVER (ORDER BY r, p_partkey) AS i FROM r), "
    "m AS (SELECT r, i, n, " + norm_ppf_sql("(CAST(i AS DOUBLE) - 0.375) / (n + 0.25)") +
    " AS m FROM o, k), "
    "c AS (SELECT sum(m * m) AS summ2, any_value(n) AS n FROM m), "
    "w AS (SELECT summ2, n, 1 / sqrt(n) AS u, " +
    norm_ppf_sql("(n - 0.375) / (n + 0.25)") + " AS mn, " +
    norm_ppf_sql("(n - 1 - 0.375) / (n + 0.25)") + " AS mn1 FROM c), "
    "w2 AS (SELECT *, mn / sqrt(summ2) + " + _poly_sql(_SW_C1, "u") + " AS an, "
    "mn1 / sqrt(summ2) + " + _poly_sql(_SW_C2, "u") + " AS an1 FROM w), "
    "w3 AS (SELECT *, sqrt((summ2 - 2 * mn * mn - 2 * mn1 * mn1) / "
    "(1 - 2 * an * an - 2 * an1 * an1)) AS fac FROM w2), "
    "agg AS (SELECT sum(CASE WHEN i = w3.n THEN an WHEN i = 1 THEN -an WHEN i = w3.n - 1 "
    "THEN an1 WHEN i = 2 THEN -an1 ELSE m.m / fac END * r) AS num, "
    "var_pop(r) * count(r) AS den, any_value(w3.n) AS n FROM m, w3) "
    "SELECT n, round(least(1.0, num * num / den), 6) AS statistic FROM agg")


ORACLE.update({
    "shapiro_statistic_part": _SHAPIRO,
    # With far more than a hundred categories the 5% limit is the normal one to four digits;
    # a new user (infinite statistic) is drift at once.
    "chisq_users_events": (
        "SELECT * REPLACE (round(statistic, 4) AS statistic), CASE WHEN isinf(statistic) THEN true "
        "ELSE 9 * dof * pow(pow(statistic / dof, 1 / 3.0) - 1 + 2 / (9.0 * dof), 2) / 2 > 1.352745 "
        "AND statistic > dof END AS drifted FROM (" + _CHISQ.replace("'event_type'", "'user_id'")
        .replace("event_type", "user_id::VARCHAR") + ")"),
})


def _chi2_sf_sql(x: str, dof: str) -> str:
    """Chi-square survival function for any degrees of freedom: one less the series of the lower
    incomplete gamma function, whose terms vanish well beyond ``x / 2``."""
    return (f"(CASE WHEN isinf({x}) THEN 0.0 WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum("
            f"list_transform(range(0, CAST({x} AS BIGINT) + 1000), lambda i: exp(-({x}) / 2 + "
            f"({dof} / 2.0 + i) * ln({x} / 2) - lgamma({dof} / 2.0 + i + 1))))) END)")


def _ks_all_sql(shift: float) -> str:
    return _ks_sql(shift).replace(
        "), c AS (", " UNION ALL SELECT 'event_id', event_id::DOUBLE, is_ref FROM ev), c AS (", 1)


def _chisq_of(column: str) -> str:
    return _CHISQ.replace("'event_type'", "'@'").replace("event_type", f"{column}::VARCHAR") \
        .replace("'@'", f"'{column}'")


_DRIFT_ALL = (
    "SELECT feature, test, statistic, p_value, drifted FROM (" + _ks_all_sql(1.5) + ") UNION ALL "
    "SELECT feature, test, statistic, round(p, 6), p < 0.05 FROM (SELECT *, " +
    _chi2_sf_sql("statistic", "dof") + " AS p FROM (" +
    " UNION ALL ".join(f"({_chisq_of(c)})" for c in ("ts", "event_type", "props")) + "))")

#: All common columns of events: three numbers and, of the others, the time, type and properties.
ORACLE.update({
    "ks_drift_events_all": _ks_all_sql(1.0),
    "ks_drift_events_shifted_all": _ks_all_sql(1.5),
    "mean_shift_events_all": _MEANSHIFT.replace(
        "FROM ev) SELECT feature", "FROM ev UNION ALL SELECT 'event_id', avg(event_id) FILTER "
        "(WHERE NOT is_ref), avg(event_id) FILTER (WHERE is_ref), stddev_samp(event_id) FILTER "
        "(WHERE is_ref) FROM ev) SELECT feature"),
    "drift_report_events_all": _DRIFT_ALL,
    "drift_summary_events_all": (
        "SELECT coalesce(bool_or(drifted), false) AS drift_detected, coalesce(string_agg(feature, ',' "
        f"ORDER BY feature) FILTER (drifted), '') AS drift_features FROM ({_DRIFT_ALL})"),
})
ORACLE.update({name: ORACLE[f"{name}_all"] for name in WHOLE_DRIFT})


def _positive_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB's round can
    return -0.0 where Spark's returns 0.0, and a value hash tells them apart."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _positive_zero(sql[j + len(key):k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


ORACLE = {name: _positive_zero(sql) for name, sql in ORACLE.items()}
