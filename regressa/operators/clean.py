"""Cleaning (C1-C14): sampling, null handling, fills, dedup, outliers.

Fills are *fitted* once (one distributed aggregation, a handful of scalars
collected) and then applied as literals, so the same values serve the
training split and later scoring batches (fit on train only)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from regressa import messages as M
from regressa.functions.columns import (categorical_columns, col, normalise_nan, numeric_columns,
                                        role_of)
from regressa.operators.ranking import exact_quantiles, range_buckets, unpivot_numeric
from regressa.session import cut_lineage

# Fixed value: fill for a categorical column that has no mode.
UNKNOWN = "Unknown"


# A missing key part, which no text of a key holds.
NULL_KEY = "\0"


def key_text_cols(df: DataFrame, key_cols):
    """Key columns as text; timestamps as epoch microseconds so the text is the
    same in every engine. Nulls get a mark of their own, and separators inside a
    text are escaped, so that different keys have different texts."""
    out = []
    for c in key_cols:
        t = df.schema[c].dataType.simpleString()
        if t == "timestamp_ntz":
            # Wall-clock microseconds since 1970-01-01: pure arithmetic, so the
            # text does not depend on the session time zone.
            text = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                    col(c)).cast("string")
        elif t.startswith("timestamp"):
            text = F.unix_micros(col(c)).cast("string")
        else:
            text = col(c).cast("string")
            if role_of(df.schema[c].dataType) != "numeric":
                text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        out.append(F.coalesce(text, F.lit(NULL_KEY)))
    return out


def hash_of_keys(df: DataFrame, key_cols, seed: int):
    """``md5(k1|k2|...:seed)``: a seeded, partitioning-independent row order."""
    return F.md5(F.concat_ws(":", F.concat_ws("|", *key_text_cols(df, key_cols)),
                             F.lit(str(seed))))


def capped_sample(df: DataFrame, key_cols, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, reproducible
    under any partitioning: the ``n`` smallest seeded key hashes (exact for a
    unique key). The n-th smallest hash comes from a few histogram passes;
    the sample is then a narrow filter, no row is sorted or shuffled."""
    from regressa.operators.ranking import hash_prefix_histogram, hash_rank_thresholds

    h = hash_of_keys(df, key_cols, seed)
    hist = hash_prefix_histogram(df, h, 4)
    total = sum(c for _, c in hist)
    if n >= total:
        return df
    if n <= 0:
        return df.limit(0)
    (t,) = hash_rank_thresholds(df, h, [n - 1], histogram=hist)
    return df.where(h <= F.lit(t))


def drop_null_rows(df: DataFrame, subset=None) -> DataFrame:
    """C2."""
    return df.na.drop(how="any", subset=subset)


def _modes(df: DataFrame, cols) -> dict:
    """Most frequent non-null value per column, smallest value on ties.

    Value counts are a distributed ``groupBy`` (a hot value combines
    map-side); the per-column winner is a ``min`` over structs, so nothing
    collects a column's values in one place. Values come back as strings and
    are cast back by the caller."""
    if not cols:
        return {}
    names = {f"c{i}": c for i, c in enumerate(cols)}
    long = df.select(*[col(c).cast("string").alias(k) for k, c in names.items()]).unpivot(
        [], list(names), "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("b"))
    return {names[r["column"]]: r["b"]["v"] for r in best.collect()}


def _numeric_modes(df: DataFrame, cols) -> dict:
    """Mode of numeric columns ordered numerically (smallest on ties)."""
    if not cols:
        return {}
    long = unpivot_numeric(df, cols).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("b"))
    return {r["column"]: r["b"]["v"] for r in best.collect()}


def medians(df: DataFrame, cols) -> dict:
    if not cols:
        return {}
    q = exact_quantiles(df, cols, [0.5]).collect()
    return {r["column"]: r["value"] for r in q}


def means(df: DataFrame, cols) -> dict:
    if not cols:
        return {}
    r = df.agg(*[F.avg(col(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return {c: r[f"c{i}"] for i, c in enumerate(cols)}


@dataclass
class FillModel:
    """Fitted fill values; ``transform`` is a narrow projection (no shuffle)."""

    values: dict = field(default_factory=dict)
    steps: list = field(default_factory=list)
    # Fractional fills (mean, median) turn integral columns into doubles, as a
    # pandas column holding NaN is float64.
    widen_integral: bool = False
    # Fills of the columns that were complete in training; used only at
    # scoring, when a batch has nulls there.
    spare: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, spare: bool = False) -> DataFrame:
        out = []
        values = {**self.spare, **self.values} if spare else self.values
        for c in df.columns:
            v = values.get(c)
            if v is None:
                out.append(col(c))
                continue
            dtype = df.schema[c].dataType
            if self.widen_integral and role_of(dtype) == "numeric":
                out.append(F.coalesce(col(c).cast("double"), F.lit(float(v))).alias(c))
            else:
                out.append(F.coalesce(col(c), F.lit(v).cast(dtype)).alias(c))
        return df.select(*out)


def fit_impute(df: DataFrame, target: str | None, spare: bool = False) -> FillModel:
    """C3 + C4 (``handle_missing`` = 'impute' or 'auto'): numeric features that
    have nulls get their median, string features their mode ('Unknown' when
    the column has no value). The target is never filled. With ``spare`` the
    medians and modes of the complete columns are kept as well (C13)."""
    feats = [c for c in df.columns if c != target]
    nulls = df.agg(*[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(feats)]).first()
    with_nulls = {c for i, c in enumerate(feats) if nulls[f"c{i}"] > 0}
    fitted = feats if spare else [c for c in feats if c in with_nulls]
    num = [c for c in fitted if role_of(df.schema[c].dataType) == "numeric"]
    cat = [c for c in fitted if isinstance(df.schema[c].dataType, StringType)]
    found, modes = medians(df, num), _modes(df, cat)
    found.update((c, modes.get(c, UNKNOWN)) for c in cat)
    steps = [(M.STEP_FILLED_MEDIAN if c in num else M.STEP_FILLED_MODE).format(column=c)
             for c in feats if c in with_nulls and (c in num or c in cat)]
    return FillModel({c: v for c, v in found.items() if c in with_nulls}, steps, bool(num),
                     {c: v for c, v in found.items() if c not in with_nulls})


def fit_fill(df: DataFrame, method: str, columns=None) -> FillModel:
    """C5 'mean' / C6 'median' over numeric columns (target included), C7
    'mode' over all columns (untouched when a column has no mode). Only columns
    that have nulls are fitted; the others stay as they are."""
    df = normalise_nan(df)
    wanted = list(columns) if columns else df.columns if method == "mode" else numeric_columns(df)
    nulls = df.agg(*[F.count_if(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(wanted)]).first()
    cols = [c for i, c in enumerate(wanted) if nulls[f"c{i}"]]
    if method == "mean":
        return FillModel(means(df, cols), ["Filled numeric columns with mean"], True)
    if method == "median":
        return FillModel(medians(df, cols), ["Filled numeric columns with median"], True)
    if method == "mode":
        num = [c for c in cols if role_of(df.schema[c].dataType) == "numeric"]
        rest = [c for c in cols if c not in num]
        vals = {**_numeric_modes(df, num), **_modes(df, rest)}
        return FillModel(vals, ["Filled all columns with mode"])
    raise ValueError(f"unknown fill method {method!r}")


def fill_ordered(df: DataFrame, columns, order_by, partition_by=(), direction: str = "forward",
                 num_buckets: int | None = None) -> DataFrame:
    """C8 forward fill / C9 backward fill along an explicit total order.

    Distributed: rows are range-partitioned on ``(partition_by, order_by)`` and
    checkpointed; each range partition fills locally with a partitioned
    window; the last (first) non-null value of every range partition is
    carried into the next (previous) one through a table of at most
    ``#partitions x #groups`` rows. A hot group simply spans several range
    partitions."""
    columns, order_by, partition_by = list(columns), list(order_by), list(partition_by)
    # Backward is forward in the reversed order: the frame always ends at the current row and
    # grows by one, so each range is filled in one pass.
    fwd = direction == "forward"
    turn = F.asc_nulls_first if fwd else F.desc_nulls_last
    groups, order = [col(c) for c in partition_by], [col(c) for c in order_by]
    b = range_buckets(df, num_buckets)
    ranged = cut_lineage(df.repartitionByRange(b, *groups, *order)
                         .withColumn("__pid", F.spark_partition_id()))
    w = Window.partitionBy("__pid", *groups).orderBy(*[turn(c) for c in order]) \
        .rowsBetween(Window.unboundedPreceding, 0)
    edge = F.max_by if fwd else F.min_by
    ends = ranged.groupBy("__pid", *[g.alias(f"__g_{i}") for i, g in enumerate(groups)]).agg(*[
        edge(col(c), F.when(col(c).isNotNull(), F.struct(*order))).alias(f"__e_{i}")
        for i, c in enumerate(columns)])
    gnames = [f"__g_{i}" for i in range(len(groups))]
    cw = (Window.partitionBy(*gnames) if gnames else Window).orderBy(turn(F.col("__pid"))) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("__pid").alias("__at"), *gnames, *[
        F.last(F.col(f"__e_{i}"), ignorenulls=True).over(cw).alias(f"__c_{i}")
        for i in range(len(columns))])
    if not partition_by:
        carry = F.broadcast(carry)  # one row per range partition
    filled = ranged.select(*[col(c) for c in ranged.columns], *[
        F.last(col(c), ignorenulls=True).over(w).alias(f"__l_{i}")
        for i, c in enumerate(columns)])
    same = F.col("__pid") == F.col("__at")
    for g, name in zip(groups, gnames, strict=True):
        same = same & g.eqNullSafe(F.col(name))  # rows of a null group are a group, too
    joined = filled.join(carry, same, "inner")
    return joined.select(*[
        F.coalesce(F.col(f"__l_{columns.index(c)}"), F.col(f"__c_{columns.index(c)}")).alias(c)
        if c in columns else col(c) for c in df.columns])


def drop_duplicates(df: DataFrame, subset=None, order_by=None) -> DataFrame:
    """Keep the first row of each duplicate group.

    Whole-row duplicates: 128-bit fingerprints of all rows are counted (narrow,
    combined map-side); only rows whose fingerprint repeats are shuffled whole and
    compared in full. With ``subset``, the first row by ``order_by`` (else by the other
    columns, so that reruns agree) is chosen with ``min_by`` in a partial
    aggregation, so a hot key never sorts its rows in one task."""
    if subset is None:
        from regressa.operators.profile import repeated

        # Rows whose fingerprint is the only one of its kind stay where they are.
        marked, twice = repeated(df)
        alone = marked.join(twice, ["__f1", "__f2"], "left_anti")
        few = marked.join(twice, ["__f1", "__f2"], "left_semi").drop("__f1", "__f2").dropDuplicates()
        return alone.select(*[col(c) for c in df.columns]).unionByName(few)
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.dropDuplicates(list(subset))
    ordkey = F.struct(*[col(c) for c in (order_by or rest)])
    names = {c: f"__v{i}" for i, c in enumerate(df.columns)}
    agg = df.groupBy(*[col(c).alias(names[c]) for c in subset]).agg(
        F.min_by(F.struct(*[col(c).alias(names[c]) for c in rest]), ordkey).alias("__r"))
    return agg.select(*[(F.col(names[c]) if c in subset else F.col(f"__r.{names[c]}")).alias(c)
                        for c in df.columns])


def fit_outlier_bounds(df: DataFrame, columns=None, k: float = 3.0) -> dict:
    cols = list(columns) if columns else numeric_columns(df)
    r = df.agg(*[F.struct(F.avg(col(c)).alias("m"), F.stddev_samp(col(c)).alias("s")).alias(f"c{i}")
                 for i, c in enumerate(cols)]).first()
    return {c: (r[f"c{i}"]["m"], r[f"c{i}"]["s"], k) for i, c in enumerate(cols)}


def remove_outliers(df: DataFrame, bounds: dict) -> DataFrame:
    """C11: keep rows with ``|x - mean| <= k * std`` in every fitted column;
    nulls are kept (they are not outliers)."""
    cond = F.lit(True)
    for c, (m, s, k) in bounds.items():
        if m is None or s is None:
            continue
        cond = cond & (col(c).isNull() | (F.abs(col(c) - F.lit(m)) <= F.lit(k * s)))
    return df.where(cond)


def select_features_by_correlation(df: DataFrame, target: str, k: int, columns=None) -> list[str]:
    """The ``k`` numeric features with the largest |corr| with the target
    (one aggregation; the ranking is over column names, not rows)."""
    from regressa.operators.profile import target_correlation

    ranked = target_correlation(df, target, columns).limit(k).collect()
    return [r["feature"] for r in ranked]


def select_features_by_importance(importance: DataFrame, k: int) -> list[str]:
    """The ``k`` features of the largest importance, of any of the importance operators (the
    ranking is over features, not rows)."""
    top = importance.orderBy(F.desc_nulls_last("importance"), "feature").limit(k)
    return [r["feature"] for r in top.collect()]


def steps_frame(spark, steps) -> DataFrame:
    """C14: preprocessing log as ``(step_no, step)`` rows."""
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(steps)],
                                 "step_no int, step string")


def categorical_features(df: DataFrame, target: str | None) -> list[str]:
    return categorical_columns(df, exclude=(target,) if target else ())
