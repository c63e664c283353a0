"""Profiling (P1-P13): every statistic of a table in as few scans as possible.

Per-column reductions are fused into one ``agg`` (one scan, partial
aggregation on the map side) and then unpivoted; exact quantiles go through
the distributed ranking in :mod:`regressa.operators.ranking`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.functions.columns import (categorical_columns, col, fingerprint, normalise_nan,
                                        numeric_columns, role_of)
from regressa.operators.ranking import exact_quantiles


def _num(c: str):
    """A numeric column as double with NaN as missing (pandas semantics)."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def null_counts(df: DataFrame) -> DataFrame:
    """Rows ``(column, null_count)`` from one aggregation; NaN counts as null."""
    df = normalise_nan(df)
    agg = df.agg(*[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_count"))
        for i, c in enumerate(df.columns)])).alias("r")).select("r.*")


def repeated(df: DataFrame, names=("__f1", "__f2")) -> tuple[DataFrame, DataFrame]:
    """``df`` with the two halves of its rows' fingerprints, and the fingerprints that occur more
    than once (narrow rows, counted map-side)."""
    marks = fingerprint([(col(f.name), f.dataType) for f in df.schema.fields])
    marked = df.select(*[col(c) for c in df.columns],
                       *[m.alias(n) for m, n in zip(marks, names, strict=True)])
    twice = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("__k")).where("__k > 1").select(*names)
    return marked, twice


def _surplus(df: DataFrame) -> DataFrame:
    """Rows after the first of equal ones. Only rows whose fingerprint repeats are shuffled whole
    and compared in full; copies combine map-side."""
    marked, twice = repeated(df)
    few = marked.join(twice, ["__f1", "__f2"], "left_semi")
    return few.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__k")).agg(
        F.coalesce(F.sum(F.col("__k") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows after the first occurrence (nulls compare equal), one row."""
    return _surplus(df)


def table_summary(df: DataFrame) -> DataFrame:
    """P1 + P10 + P13 + P3: one row ``(n_rows, n_columns, n_numeric,
    n_categorical, n_other, total_missing, duplicate_rows)``; NaN counts as missing.

    Row count and missing cells are one aggregation without a shuffle of rows; duplicates are
    counted as in :func:`duplicate_row_count`."""
    df = normalise_nan(df)
    roles = [role_of(f.dataType) for f in df.schema.fields]
    missing = sum((col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("total_missing"))
    # Two rows, one of each side.
    both = counts.withColumn("duplicate_rows", F.lit(None).cast("long")).unionByName(
        _surplus(df).select(F.lit(None).cast("long").alias("n_rows"),
                            F.lit(None).cast("long").alias("total_missing"), "duplicate_rows"))
    return both.agg(
        F.max("n_rows").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(roles.count("numeric")).alias("n_numeric"),
        F.lit(roles.count("categorical")).alias("n_categorical"),
        F.lit(roles.count("other")).alias("n_other"),
        F.max("total_missing").alias("total_missing"),
        F.max("duplicate_rows").alias("duplicate_rows"))


# Bytes per value of fixed-width types (strings are measured per value).
_FIXED_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
                "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def memory_usage(df: DataFrame) -> DataFrame:
    """P1 memory: ``(column, bytes)`` estimated from the data in one scan:
    fixed-width types count their width per non-null value, strings their
    UTF-8 length. Plus a ``__total__`` row."""
    exprs = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "string":
            e = F.coalesce(F.sum(F.octet_length(col(f.name))), F.lit(0))
        elif t in _FIXED_WIDTH:
            e = F.count(col(f.name)) * F.lit(_FIXED_WIDTH[t])
        else:
            e = F.coalesce(F.sum(F.octet_length(col(f.name).cast("string"))), F.lit(0))
        exprs.append(e.cast("long").alias(f"c{len(exprs)}"))
    agg = df.agg(*exprs)
    names = [f.name for f in df.schema.fields]
    long = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("bytes"))
        for i, c in enumerate(names)])).alias("r")).select("r.*")
    total = agg.select(F.lit("__total__").alias("column"),
                       sum((F.col(f"c{i}") for i in range(len(names))), F.lit(0)).cast("long")
                       .alias("bytes"))
    return long.unionByName(total)


def dtype_counts(df: DataFrame) -> dict[str, int]:
    """P1 dtypes: number of columns per Spark type (schema only)."""
    out: dict[str, int] = {}
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        out[t] = out.get(t, 0) + 1
    return out


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    """P10: role lists from the schema."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "other": []}
    for f in df.schema.fields:
        out[role_of(f.dataType)].append(f.name)
    return out


def describe(df: DataFrame, columns=None, approx: bool = False,
             relative_error: float = 1e-4) -> DataFrame:
    """Per numeric column ``count, mean, std (ddof=1), min, q25, q50, q75,
    max``. Quantiles are exact with linear interpolation unless ``approx``."""
    cols = list(columns) if columns else numeric_columns(df)
    # NaN counts as missing, as in pandas.
    df = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(c)
                     if dict(df.dtypes)[c] in ("double", "float") else col(c) for c in cols])
    moments = df.agg(*[
        F.struct(F.count(col(c)).alias("count"), F.avg(col(c)).alias("mean"),
                 F.stddev_samp(col(c)).alias("std"),
                 F.min(col(c)).cast("double").alias("min"),
                 F.max(col(c)).cast("double").alias("max")).alias(f"m{i}")
        for i, c in enumerate(cols)])
    long = moments.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("m"))
        for i, c in enumerate(cols)])).alias("r")).select("r.column", "r.m.*")
    if approx:
        qs = df.agg(*[F.percentile_approx(col(c).cast("double"), [0.25, 0.5, 0.75],
                                          int(1 / relative_error)).alias(f"q{i}")
                      for i, c in enumerate(cols)])
        q = qs.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"q{i}")[0].alias("q25"),
                     F.col(f"q{i}")[1].alias("q50"), F.col(f"q{i}")[2].alias("q75"))
            for i, c in enumerate(cols)])).alias("r")).select("r.*")
    else:
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).groupBy("column").agg(
            F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q25"),
            F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("q50"),
            F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q75"))
    return long.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def distinct_counts(df: DataFrame, columns=None) -> DataFrame:
    """Distinct non-null values of all columns: rows ``(column, distinct)``, none for a column
    without values. One narrow shuffle: each row gives the 128-bit fingerprints of its values, equal
    ones combine map-side, and what is left is counted per column."""
    cols = list(columns) if columns is not None else df.columns
    marks = []
    for i, c in enumerate(cols):
        one, two = fingerprint([(col(c), df.schema[c].dataType)])
        marks.append(F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("i"), one.alias("a"), two.alias("b"))))
    seen = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*").distinct()
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1)
    return seen.groupBy("i").agg(F.count(F.lit(1)).alias("distinct")).select(names.alias("column"), "distinct")


def column_profile(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """P5: ``(column, dtype, non_null, null_count, unique_values)``; distinct counts exact, or from
    mergeable sketches in the same pass with ``approx_distinct``."""
    counts = [F.count(col(c)) for c in df.columns]
    if approx_distinct:
        counts = [F.struct(n.alias("nn"), F.approx_count_distinct(col(c)).alias("u"))
                  for n, c in zip(counts, df.columns, strict=True)]
    else:
        counts = [F.struct(n.alias("nn"), F.lit(None).cast("long").alias("u")) for n in counts]
    agg = df.agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    long = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 F.col(f"c{i}.nn").alias("non_null"),
                 (F.col("n") - F.col(f"c{i}.nn")).alias("null_count"),
                 F.col(f"c{i}.u").alias("unique_values"))
        for i, c in enumerate(df.columns)])).alias("r")).select("r.*")
    if approx_distinct:
        return long
    # One row a column on both sides.
    return long.join(distinct_counts(df), "column", "left").select(
        "column", "dtype", "non_null", "null_count", F.coalesce("distinct", F.lit(0)).alias("unique_values"))


def missing_report(df: DataFrame) -> DataFrame:
    """``(column, missing_count, missing_pct)`` for columns with nulls,
    percentage rounded to 2 digits, most missing first; NaN counts as missing. One scan."""
    df = normalise_nan(df)
    agg = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    long = agg.select("n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("missing_count"))
        for i, c in enumerate(df.columns)])).alias("r")).select("n", "r.*")
    return (long.where(F.col("missing_count") > 0)
            .select("column", "missing_count",
                    F.round(F.col("missing_count") / F.col("n") * 100, 2).alias("missing_pct"))
            .orderBy(F.desc("missing_count"), "column"))


def correlation_matrix(df: DataFrame, columns=None) -> DataFrame:
    """Pearson correlation of every numeric pair (pairwise complete),
    long form ``(column_a, column_b, corr)``, both orders, no diagonal; one scan."""
    cols = list(columns) if columns else numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    found = _correlations(df.select(*[_num(c).alias(f"c{i}") for i, c in enumerate(cols)]))
    entries = [F.struct(F.lit(cols[a]).alias("column_a"), F.lit(cols[b]).alias("column_b"),
                        F.lit(r).cast("double").alias("corr"))
               for (i, j), r in found.items() for a, b in ((i, j), (j, i))]
    return df.sparkSession.range(1).select(F.explode(F.array(*entries)).alias("r")).select("r.*")


#: Share of the squares that must be left after centring on a pair's own rows; below, the digits do
#: not suffice, and the pair is summed anew by Spark's running moments.
LEFT = 1e-6


def _correlations(data: DataFrame) -> dict[tuple, float | None]:
    """Pearson correlation of every pair of double columns over the rows that have both: null for
    fewer than two of them or a side that does not vary, NaN where a value is infinite. Tasks sum
    products around the columns' means as matrices; the driver gets a few numbers a pair."""
    names, k = data.columns, len(data.columns)
    finite = [F.when(F.abs(c) < math.inf, F.col(c)) for c in names]
    means = data.agg(*[F.avg(v).alias(c) for v, c in zip(finite, names, strict=True)]).first()
    centre = np.array([means[c] if means[c] is not None and math.isfinite(means[c]) else 0.0 for c in names])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, k, k))
        for batch in batches:
            z = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            has, far = ~np.isnan(z), np.isinf(z)
            z = np.where(has & ~far, z - centre, 0.0)
            has = has.astype(float)
            for place, x, y in ((0, has, has), (1, z, has), (2, z * z, has), (3, z, z)):
                total[place] += x.T @ y
            if far.any():
                total[4] += far.T.astype(float) @ has
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())],
                                         names=["at", "v"])

    flat = np.zeros(5 * k * k)
    for r in data.mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        flat[r["at"]] = r["v"]
    n, s, q, xy, far = flat.reshape(5, k, k)
    out, again = {}, []
    for i, j in combinations(range(k), 2):
        if n[i, j] < 2:
            out[i, j] = None
        elif far[i, j] or far[j, i]:
            out[i, j] = math.nan
        else:
            sx, sy = s[i, j], s[j, i]
            vx, vy = q[i, j] - sx * sx / n[i, j], q[j, i] - sy * sy / n[i, j]
            if not (vx > LEFT * q[i, j] and vy > LEFT * q[j, i]):
                again.append((i, j))
            out[i, j] = float((xy[i, j] - sx * sy / n[i, j]) / math.sqrt(vx * vy)) if vx * vy > 0 else None
    if again:
        aggs = []
        for i, j in again:
            x, y = (F.when(F.col(names[i]).isNotNull() & F.col(names[j]).isNotNull(), F.col(names[a])) for a in (i, j))
            aggs.append(F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)),
                               F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
                        .alias(f"p{i}_{j}"))
        exact = data.agg(*aggs).first()
        out |= {(i, j): exact[f"p{i}_{j}"] for i, j in again}
    return out


def target_correlation(df: DataFrame, target: str, columns=None) -> DataFrame:
    """P8 (and C12 ranking): ``(feature, corr, abs_corr)`` with the target,
    strongest first."""
    cols = [c for c in (columns or numeric_columns(df)) if c != target]
    agg = df.agg(*[F.corr(_num(c), _num(target)).alias(f"c{i}") for i, c in enumerate(cols)])
    out = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")
    return out.withColumn("abs_corr", F.abs("corr")).orderBy(
        F.desc_nulls_last("abs_corr"), "feature")


def head(df: DataFrame, order_by, n: int = 100) -> DataFrame:
    """First ``n`` rows in key order (TakeOrderedAndProject: a top-k per
    partition, then a merge of k rows per partition)."""
    return df.orderBy(*order_by).limit(n)


def row_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(original_rows, processed_rows, removed_rows)``; two counts,
    combined through a two-row union rather than a join."""
    both = before.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(0)).unionByName(
        after.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(1)))
    return both.agg(
        F.max(F.when(F.col("side") == 0, F.col("n"))).alias("original_rows"),
        F.max(F.when(F.col("side") == 1, F.col("n"))).alias("processed_rows"),
    ).withColumn("removed_rows", F.col("original_rows") - F.col("processed_rows"))


def numeric_domain(df: DataFrame, columns=None) -> DataFrame:
    """P12 numeric part: ``(column, min, max, mean)``."""
    cols = list(columns) if columns else numeric_columns(df)
    agg = df.agg(*[F.struct(F.min(_num(c)).alias("min"), F.max(_num(c)).alias("max"),
                            F.avg(_num(c)).alias("mean")).alias(f"c{i}")
                   for i, c in enumerate(cols)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("s"))
        for i, c in enumerate(cols)])).alias("r")).select("r.column", "r.s.*")


def categorical_domain(df: DataFrame, columns=None) -> DataFrame:
    """P12 categorical part: distinct ``(column, value)`` pairs, with counts;
    aggregated per value so a hot category is one row."""
    cols = list(columns) if columns else categorical_columns(df)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in cols]))
        .alias("r")).select("r.*")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count"))
