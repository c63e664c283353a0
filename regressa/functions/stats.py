"""Statistical column expressions that stay inside the JVM (no Python UDFs).

The SQL-text builders emit plain SQL (CASE, ln, sqrt, exp) that both Spark
SQL and DuckDB accept, so a query and its oracle can share one formula.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Wichura (1988), Algorithm AS 241 (PPND16), coefficients in
# natural order (highest power first), numerator then denominator.
_AS241_CENTRAL_NUM = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
                      45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
                      133.14166789178437745, 3.387132872796366608)
_AS241_CENTRAL_DEN = (5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
                      21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
                      42.313330701600911252, 1.0)
_AS241_MID_NUM = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
                  1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
                  4.6303378461565452959, 1.42343711074968357734)
_AS241_MID_DEN = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
                  0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
                  2.05319162663775882187, 1.0)
_AS241_TAIL_NUM = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
                   0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
                   5.4637849111641143699, 6.6579046435011037772)
_AS241_TAIL_DEN = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
                   7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
                   0.59983220655588793769, 1.0)


def _horner(coefs, x: str) -> str:
    expr = repr(coefs[0])
    for c in coefs[1:]:
        expr = f"({expr}) * ({x}) + {c!r}"
    return f"({expr})"


def norm_ppf_sql(p: str) -> str:
    """Inverse standard normal CDF of the SQL expression ``p`` (0 < p < 1)."""
    q = f"(({p}) - 0.5)"
    r_c = f"(0.180625 - {q} * {q})"
    central = f"({q} * {_horner(_AS241_CENTRAL_NUM, r_c)} / {_horner(_AS241_CENTRAL_DEN, r_c)})"
    tail_r = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN ({p}) ELSE 1.0 - ({p}) END))"
    r_m = f"({tail_r} - 1.6)"
    r_t = f"({tail_r} - 5.0)"
    mid = f"({_horner(_AS241_MID_NUM, r_m)} / {_horner(_AS241_MID_DEN, r_m)})"
    tail = f"({_horner(_AS241_TAIL_NUM, r_t)} / {_horner(_AS241_TAIL_DEN, r_t)})"
    outer = f"(CASE WHEN {tail_r} <= 5.0 THEN {mid} ELSE {tail} END)"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{outer} ELSE {outer} END)")


def norm_ppf(p: str) -> Column:
    """Column form of :func:`norm_ppf_sql`; ``p`` is a column name or SQL text."""
    return F.expr(norm_ppf_sql(p))


def ks_pvalue_sql(lam: str, dialect: str = "spark", terms: int = 100) -> str:
    """Asymptotic Kolmogorov survival function Q(lam) = 2 sum (-1)^(k-1) exp(-2 k^2 lam^2),
    clamped to [0, 1]; 1 for lam < 0.05 where the series has not converged."""
    term = "power(-1, k - 1) * exp(-2.0 * k * k * ({l}) * ({l}))".format(l=lam)
    if dialect == "spark":
        series = f"aggregate(sequence(1, {terms}), CAST(0 AS DOUBLE), (acc, k) -> acc + {term})"
    else:
        series = f"list_sum(list_transform(range(1, {terms + 1}), lambda k: {term}))"
    return (f"(CASE WHEN ({lam}) < 0.05 THEN 1.0 "
            f"ELSE least(1.0, greatest(0.0, 2.0 * {series})) END)")


#: Values of the larger sample up to which the reference's test takes the exact p-value.
KS_EXACT_ROWS = 10_000


def ks_exact_scalar(d: float, n: int, m: int) -> float:
    """P(D >= d) of the two-sample Kolmogorov-Smirnov statistic for samples of ``n`` and ``m``.

    A random merge of the samples is a lattice path from (0, 0) to (n, m); D reaches ``d`` where a
    path meets a point with |i m - j n| >= d n m. Backwards from the end, the last step came from the
    first sample with probability i / (i + j), so the chance of having met such a point by (i, j) is
    that mean of the chances at its two predecessors, and 1 on the points themselves. One diagonal
    i + j = s after the other, and only between the two lines: no term is subtracted, so tiny chances
    keep their digits."""
    if n <= 0 or m <= 0 or d != d:
        return float("nan")
    h = round(d * n * m)  # the statistic is a multiple of 1 / (n m)
    if h <= 0:
        return 1.0
    low, met = 0, np.zeros(1)  # chances at i = low, low + 1, ... of the last diagonal
    for s in range(1, n + m + 1):
        # Inside the lines: |i m - (s - i) n| < h, and on the grid.
        first = max(0, s - m, (s * n - h) // (n + m) + 1)
        last = min(s, n, -((-s * n - h) // (n + m)) - 1)
        if last < first:
            return 1.0
        i = np.arange(first, last + 1)
        wide = np.ones(len(i) + 1)  # chances at i - 1 and i before; 1 outside the lines
        a, b = max(first - 1, low), min(last, low + len(met) - 1)
        if a <= b:
            wide[a - first + 1:b - first + 2] = met[a - low:b - low + 1]
        met = (i * wide[:-1] + (s - i) * wide[1:]) / s
        low = first
    return float(min(1.0, met[n - low]))


@F.pandas_udf(DoubleType())
def ks_exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Exact p-values of result rows, one a tested column; null where ``d`` is."""
    return pd.Series([ks_exact_scalar(float(a), int(b), int(c)) if pd.notna(a) and b and c else None
                      for a, b, c in zip(d, n, m, strict=True)], dtype="float64")


def skewness_unbiased(c: Column | str) -> Column:
    """Adjusted Fisher-Pearson skewness G1 (pandas ``skew``); aggregate."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    return F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2)


def kurtosis_unbiased(c: Column | str) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurt``); aggregate."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.try_divide(((n + 1) * g2 + 6) * (n - 1), (n - 2) * (n - 3))


def chi2_sf_scalar(x: float, dof: int) -> float:
    """Chi-square survival function: the regularised upper incomplete gamma
    Q(dof / 2, x / 2), with its factor in log space, so neither a large
    statistic nor many degrees of freedom over- or underflow. Below the mean
    by the series of P, above it by the continued fraction of Q; both need
    about sqrt(dof) terms."""
    if x is None or dof is None or dof <= 0 or x != x:
        return float("nan")
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, h = dof / 2.0, x / 2.0
    log_factor = a * math.log(h) - h - math.lgamma(a)
    if h < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1.0
            term *= h / k
            total += term
        return min(1.0, max(0.0, 1.0 - math.exp(min(0.0, log_factor + math.log(total)))))
    tiny = 1e-300
    b = h + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    f, k = d, 0
    while True:
        k += 1
        an = -k * (k - a)
        b += 2.0
        d = an * d + b
        c = b + an / c
        d, c = 1.0 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
        step = d * c
        f *= step
        if abs(step - 1.0) < 1e-15 or k > 10_000_000:
            break
    log_q = log_factor + math.log(f)
    return min(1.0, math.exp(log_q)) if log_q > -745.0 else 0.0


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Vectorised chi-square survival function; applied to per-feature result
    rows only (one row per tested column), never to table rows."""
    return pd.Series([chi2_sf_scalar(float(a), int(b)) if pd.notna(a) and pd.notna(b)
                      else None for a, b in zip(x, dof)], dtype="float64")
