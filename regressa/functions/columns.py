"""Column roles and small schema helpers (driver-side, schema only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DecimalType, DoubleType, FloatType, IntegerType,
                               LongType, ShortType, StringType)

NUMERIC_TYPES = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)


def col(name: str):
    """Column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def role_of(dtype) -> str:
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, StringType):
        return "categorical"
    return "other"


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if role_of(f.dataType) == "numeric" and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if role_of(f.dataType) == "categorical" and f.name not in exclude]


def feature_columns(df: DataFrame, target: str) -> list[str]:
    return [c for c in df.columns if c != target]


def dtype_name(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def fingerprint(columns) -> list:
    """128 bits over columns as two hashes; equal rows have equal ones (nulls, NaN and the two
    zeros included), different rows with all but certainty."""
    parts = []
    for c, dtype in columns:
        v = c + F.lit(0.0) if isinstance(dtype, (FloatType, DoubleType)) else c
        # A null leaves a hash as it was, so its place is told apart.
        parts += [v, c.isNull()]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def normalise_nan(df: DataFrame, cols=None) -> DataFrame:
    """NaN -> NULL for floating columns (pandas treats both as missing)."""
    cols = cols or [f.name for f in df.schema.fields
                    if isinstance(f.dataType, (FloatType, DoubleType))]
    return df.select(*[F.nanvl(col(c), F.lit(None).cast(df.schema[c].dataType)).alias(c)
                       if c in cols else col(c) for c in df.columns])


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (result tables compared across engines)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
