"""Feature engineering (E1-E10): encoders, scaler, alignment, split, folds.

Encoders are fitted on the training side only and applied to any later
batch. Category lists for one-hot encoding come to the driver because they
define output columns; label and target encodings stay DataFrames and are
joined back (adaptive execution picks the join by measured bytes)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.functions.columns import col
from regressa.operators.clean import hash_of_keys
from regressa.operators.ranking import (hash_prefix_histogram, hash_rank_thresholds,
                                        with_row_number)

# Rows up to which a fitted mapping counts as small in its metadata. Joins carry
# no hint: adaptive execution broadcasts a mapping by its measured bytes.
BROADCAST_MAX_ROWS = 1_000_000
# Fixed value: string that pandas' ``astype(str)`` gives a missing value.
NULL_LABEL = "nan"
# Label code of a value that training has not seen.
UNSEEN = -1


# One-hot output columns a single categorical column may create. Categories
# become columns, so their list must reach the driver; beyond this the fit
# stops with an error (use the vector form, label or target encoding) instead of
# collecting an unbounded list.
MAX_ONE_HOT_CATEGORIES = 10_000


def _category_lists(df: DataFrame, cols, wide: list | None = None) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column (distributed distinct),
    after checking their number against ``MAX_ONE_HOT_CATEGORIES``: columns
    beyond it go to ``wide``, or are an error without such a list."""
    if not cols:
        return {}
    names = {f"c{i}": c for i, c in enumerate(cols)}
    long = df.select(*[col(c).cast("string").alias(k) for k, c in names.items()]).unpivot(
        [], list(names), "column", "value").where(F.col("value").isNotNull()).distinct()
    sizes = {r["column"]: r["k"] for r in
             long.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    big = {names[c]: k for c, k in sizes.items() if k > MAX_ONE_HOT_CATEGORIES}
    if big and wide is not None:
        wide.extend(c for c in cols if c in big)
        long = long.where(~F.col("column").isin([k for k, c in names.items() if c in big]))
        cols = [c for c in cols if c not in big]
    elif big:
        raise ValueError(f"too many categories for one-hot encoding: {big}; "
                         "use encode_categorical='label' or 'target'")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in long.collect():
        out[names[r["column"]]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


@dataclass
class OneHotModel:
    """Pandas ``get_dummies(drop_first=True)`` semantics: columns
    ``<col>_<value>`` for every sorted category but the first, 0/1 ints; a
    null or unseen value gives all zeros."""

    categories: dict = field(default_factory=dict)

    def output_columns(self) -> list[str]:
        return [f"{c}_{v}" for c, vals in self.categories.items() for v in vals[1:]]

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [col(c) for c in df.columns if c not in self.categories]
        dummies = [F.coalesce((col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0))
                   .alias(f"{c}_{v}")
                   for c, vals in self.categories.items() if c in df.columns for v in vals[1:]]
        return df.select(*keep, *dummies)


def fit_one_hot(df: DataFrame, cols) -> OneHotModel:
    return OneHotModel(_category_lists(df, cols))


#: Share of the rows from which on a category counts as heavy (so at most 200 a column), and keys that
#: the rows of heavy and of null categories are spread over in a join.
HEAVY_SHARE, SPREAD = 0.005, 4096


def _heavy(counted: DataFrame, result: str) -> dict[str, dict]:
    """The measured heavy categories ``{column: {value: result}}`` of rows (column, value, n,
    result)."""
    total = counted.groupBy("column").agg(F.sum("n").alias("t"))
    rows = counted.join(F.broadcast(total), "column").where(F.col("n") >= HEAVY_SHARE * F.col("t"))
    out: dict[str, dict] = {}
    for r in rows.select("column", "value", result).collect():  # at most 200 rows a column
        out.setdefault(r["column"], {})[r["value"]] = r[result]
    return out


def _look_up(df: DataFrame, value, mapping: DataFrame, heavy: dict, name: str) -> DataFrame:
    """``df`` with ``name``: the result that ``mapping (value, name)`` has for ``value``, else null.

    Heavy categories are answered from a small literal map. Their rows, and those without a value,
    enter the join under keys that match nothing, spread over ``SPREAD`` of them, so that neither a
    hot nor a null category gathers in one task."""
    known = F.lit(None)
    if heavy:
        known = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])[F.col("__v")]
    aside = F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("string"))
    out = df.withColumn("__v", value).withColumn("__known", known) \
        .withColumn("__k", F.when(F.col("__v").isNull() | F.col("__known").isNotNull(), aside)
                    .otherwise(F.col("__v")))
    m = mapping.select(F.col("value").alias("__k"), F.col(name).alias("__found"))
    return out.join(m, "__k", "left").withColumn(name, F.when(F.col("__v").isNotNull(), F.coalesce(
        "__known", "__found"))).drop("__k", "__v", "__known", "__found")


@dataclass
class OneHotVectorModel:
    """E1 as one sparse vector ``<col>_onehot`` a column: position ``i`` is the
    sorted category ``i + 1`` (the first is dropped); a null or unseen value
    gives all zeros. Any number of categories: they stay in ``mapping`` rows
    ``(column, value, code)``, and only their number reaches the driver."""

    mapping: DataFrame
    widths: dict
    heavy: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out, codes = df, [f"__code{i}" for i in range(len(self.widths))]
        for (c, width), code in zip(self.widths.items(), codes, strict=True):
            m = self.mapping.where(F.col("column") == c).select("value", F.col("code").alias(code))
            out = _look_up(out, col(c).cast("string"), m, self.heavy.get(c), code)
            # The last code is the one that the encoder drops.
            out = out.withColumn(code, F.when(F.col(code) > 0, F.col(code) - 1).otherwise(width - 1)
                                 .cast("double"))
        sizes = df.sparkSession.range(1).select(
            *[F.lit(float(w - 1)).alias(k) for w, k in zip(self.widths.values(), codes, strict=True)])
        encoder = OneHotEncoder(inputCols=codes, outputCols=[f"{c}_onehot" for c in self.widths])
        return encoder.fit(sizes).transform(out).select(
            *[col(c) for c in df.columns], *[col(f"{c}_onehot") for c in self.widths])


def fit_one_hot_vector(df: DataFrame, cols) -> OneHotVectorModel:
    """Codes from a distributed row number over the distinct values; a column
    needs two of them at least, as one category says nothing."""
    cols = list(cols)
    names = {f"c{i}": c for i, c in enumerate(cols)}
    long = df.select(*[col(c).cast("string").alias(k) for k, c in names.items()]).unpivot(
        [], list(names), "column", "value").where(F.col("value").isNotNull()) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    ranked = with_row_number(long.withColumn("column", named[F.col("column")]), ["value"],
                             partition_by=["column"], name="__rn")
    mapping = ranked.select("column", "value", "n", (F.col("__rn") - 1).cast("int").alias("code")).cache()
    found = {r["column"]: r["n"] for r in
             mapping.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    if few := [c for c in cols if found.get(c, 0) < 2]:
        raise ValueError(f"columns with fewer than two categories: {few}")
    return OneHotVectorModel(mapping.drop("n"), {c: found[c] for c in cols}, _heavy(mapping, "code"))


@dataclass
class MixedOneHotModel:
    """E1 for columns of any size: 0/1 columns up to ``MAX_ONE_HOT_CATEGORIES``
    categories (``narrow``), one sparse vector a column beyond (``wide``)."""

    narrow: OneHotModel
    wide: OneHotVectorModel

    def output_columns(self) -> list[str]:
        return self.narrow.output_columns() + self.vector_columns()

    def vector_columns(self) -> list[str]:
        return [f"{c}_onehot" for c in self.wide.widths]

    def transform(self, df: DataFrame) -> DataFrame:
        # A wide column that the batch lacks gives all zeros.
        lacking = {c: F.lit(None).cast("string") for c in self.wide.widths if c not in df.columns}
        return self.wide.transform(self.narrow.transform(df.withColumns(lacking)))

    def names_of(self, column: str) -> list[str]:
        """The categories behind the positions of a vector, as names."""
        c = column.removesuffix("_onehot")
        rows = self.wide.mapping.where((F.col("column") == c) & (F.col("code") > 0)).collect()
        return [f"{c}_{r['value']}" for r in sorted(rows, key=lambda r: r["code"])]


def fit_one_hot_any(df: DataFrame, cols) -> OneHotModel | MixedOneHotModel:
    wide: list = []
    narrow = OneHotModel(_category_lists(df, cols, wide))
    return MixedOneHotModel(narrow, fit_one_hot_vector(df, wide)) if wide else narrow


@dataclass
class LabelModel:
    """code = 0-based position of ``astype(str)`` value among the sorted
    distinct values (a null becomes the string 'nan'); unseen values get the
    reserved code ``UNSEEN``.
    ``mapping`` rows: ``(column, value, code)``."""

    mapping: DataFrame
    columns: list
    broadcastable: bool
    heavy: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            m = self.mapping.where(F.col("column") == c).select("value", F.col("code").alias("__code"))
            out = _look_up(out, F.coalesce(col(c).cast("string"), F.lit(NULL_LABEL)), m,
                           self.heavy.get(c), "__code") \
                .withColumn(c, F.coalesce(F.col("__code"), F.lit(UNSEEN))).drop("__code")
        return out.select(*[col(c) for c in df.columns])


def fit_label(df: DataFrame, cols) -> LabelModel:
    """Codes from a distributed row number over the distinct values, so even a
    column with one value per row is encoded without a one-task window."""
    cols = list(cols)
    counted = _category_counts(df, cols, F.lit(NULL_LABEL))
    ranked = with_row_number(counted, ["value"], partition_by=["column"], name="__rn")
    mapping = ranked.select("column", "value", "n", (F.col("__rn") - 1).cast("int").alias("code"))
    mapping = mapping.cache()
    n = mapping.count()
    return LabelModel(mapping.drop("n"), cols, n <= BROADCAST_MAX_ROWS, _heavy(mapping, "code"))


def _category_counts(df: DataFrame, cols, missing, *others) -> DataFrame:
    """Rows ``(column, value, n, ...)``: the values of all columns as text with their counts, nulls as
    ``missing`` (left out where that is null); ``others`` are further aggregates."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(
        col(c).cast("string"), missing.cast("string")).alias("value")) for c in cols])
    long = df.select("*", F.explode(entries).alias("__e"))
    return long.where("__e.value IS NOT NULL").groupBy(
        F.col("__e.column").alias("column"), F.col("__e.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), *others)


@dataclass
class TargetModel:
    """Smoothed mean target per category,
    ``(n_c * mean_c + m * global_mean) / (n_c + m)``; null or unseen category
    -> global mean. Fitted on the training rows only."""

    mapping: DataFrame
    columns: list
    global_mean: float
    smoothing: float
    broadcastable: bool
    heavy: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            m = self.mapping.where(F.col("column") == c).select("value", F.col("enc").alias("__enc"))
            out = _look_up(out, col(c).cast("string"), m, self.heavy.get(c), "__enc") \
                .withColumn(c, F.coalesce(F.col("__enc"), F.lit(self.global_mean))).drop("__enc")
        return out.select(*[col(c) for c in df.columns])


def fit_target(df: DataFrame, cols, target: str, smoothing: float = 10.0) -> TargetModel:
    cols = list(cols)
    g = df.agg(F.avg(col(target)).alias("g")).first()["g"]
    stats = _category_counts(df.where(col(target).isNotNull()), cols, F.lit(None),
                             F.sum(col(target)).alias("s"))
    m = float(smoothing)
    mapping = stats.select("column", "value", "n", ((F.col("s") + F.lit(m * (g or 0.0))) /
                                                   (F.col("n") + F.lit(m))).alias("enc")).cache()
    n = mapping.count()
    return TargetModel(mapping.drop("n"), cols, g, m, n <= BROADCAST_MAX_ROWS, _heavy(mapping, "enc"))


@dataclass
class ScalerModel:
    """``(x - mean) / std`` with the population std (ddof 0); a constant
    column is only centred (scale 1)."""

    stats: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.stats:
                m, s = self.stats[c]
                s = s if s and s > 0 else 1.0
                out.append(((col(c) - F.lit(m)) / F.lit(s)).alias(c))
            else:
                out.append(col(c))
        return df.select(*out)


def fit_scaler(df: DataFrame, cols) -> ScalerModel:
    cols = list(cols)
    r = df.agg(*[F.struct(F.avg(col(c)).alias("m"), F.stddev_pop(col(c)).alias("s")).alias(f"c{i}")
                 for i, c in enumerate(cols)]).first()
    return ScalerModel({c: (r[f"c{i}"]["m"], r[f"c{i}"]["s"]) for i, c in enumerate(cols)})


def fit_vector_scales(df: DataFrame, cols) -> dict:
    """E4 for vectors: ``1 / std`` (population) of each position, 1 for a constant one. They are
    not centred and so stay sparse, which moves only a model's intercept."""
    n, out = df.count(), {}
    for c in cols:
        std = StandardScaler(withMean=False, inputCol=c, outputCol="__scaled").fit(df).std.toArray()
        pop = std * math.sqrt((n - 1) / n) if n > 1 else std * 0.0
        out[c] = [1.0 / x if x > 0 else 1.0 for x in pop.tolist()]
    return out


def scale_vectors(df: DataFrame, scales: dict) -> DataFrame:
    out = df
    for c, values in scales.items():
        out = ElementwiseProduct(scalingVec=Vectors.dense(values), inputCol=c, outputCol="__scaled") \
            .transform(out).withColumn(c, F.col("__scaled")).drop("__scaled")
    return out.select(*[col(c) for c in df.columns])


def features_and_target(df: DataFrame, target: str, features=None):
    """E5: (features DataFrame, target column name)."""
    feats = list(features) if features else [c for c in df.columns if c != target]
    return df.select(*[col(c) for c in feats]), target


def align_columns(df: DataFrame, expected, fill=0) -> DataFrame:
    """Add expected columns missing from a batch as ``fill`` and order the
    result as ``expected``; extra columns are dropped."""
    return df.select(*[col(c) if c in df.columns else F.lit(fill).alias(c) for c in expected])


def select_features(df: DataFrame, feature_names) -> DataFrame:
    """Required features in training order (missing ones raise)."""
    return df.select(*[col(c) for c in feature_names])


def exact_split(df: DataFrame, key_cols, test_size: float = 0.2, seed: int = 42,
                folds: int | None = None, hashed: str | None = None) -> DataFrame:
    """E9 (+ E10 when ``folds``): the ``ceil(n * test_size)`` rows with the
    smallest seeded key hash are the test set (``is_test``); the training rows,
    in hash order, are cut into ``folds`` contiguous folds (KFold without
    shuffle on the seeded order: the first ``n_train % k`` folds hold one row
    more). Test rows get a null fold.

    Distributed and exact: one count and a few histogram passes find the hash
    values at the boundary ranks (:func:`hash_rank_thresholds`), then the split
    is a narrow projection comparing each row's hash with them; no row is
    shuffled. Sizes are exact when the key is unique (copies of one key share
    a hash and always land on the same side). ``hashed`` names a column of ``df``
    that holds :func:`hash_of_keys` already; it is dropped."""
    h = F.col(hashed) if hashed else hash_of_keys(df, list(key_cols), seed)
    hist = hash_prefix_histogram(df, h, 4)  # also gives the row count
    n = sum(c for _, c in hist)
    n_test = math.ceil(n * test_size)
    ranks = [n_test - 1] if n_test > 0 else []
    sizes = []
    if folds:
        q, rem = divmod(n - n_test, folds)
        sizes = [q + 1 if j < rem else q for j in range(folds)]
        pos = n_test
        for s in sizes[:-1]:
            pos += s
            ranks.append(pos - 1)
    ranks = [r for r in ranks if 0 <= r < n]
    th = hash_rank_thresholds(df, h, ranks, histogram=hist) if ranks else []
    out = df.withColumn("__h", h)
    if n_test > 0:
        t_test, th_f = th[0], th[1:]
        is_test = F.col("__h") <= F.lit(t_test)
    else:
        th_f = th
        is_test = F.lit(False)
    out = out.withColumn("is_test", is_test)
    if folds:
        fold = F.lit(folds - 1)
        for j in reversed(range(len(th_f))):
            fold = F.when(F.col("__h") <= F.lit(th_f[j]), F.lit(j)).otherwise(fold)
        out = out.withColumn("fold", F.when(~F.col("is_test"), fold.cast("int")))
    return out.drop("__h", *([hashed] if hashed else []))


def hash_split(df: DataFrame, key_cols, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """E9 one-pass variant: test when the first 8 hex digits of the seeded hash
    fall below ``test_size * 16^8``; about, not exactly, ``test_size``."""
    thr = format(int(test_size * 16 ** 8), "08x")
    h = hash_of_keys(df, list(key_cols), seed)
    return df.withColumn("is_test", F.substring(h, 1, 8) < F.lit(thr))


def assign_folds(df: DataFrame, key_cols, k: int = 5, test_size: float = 0.2,
                 seed: int = 42) -> DataFrame:
    """Split plus ``fold`` (see :func:`exact_split`)."""
    return exact_split(df, key_cols, test_size, seed, folds=k)
