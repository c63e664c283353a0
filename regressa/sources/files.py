"""CSV / Parquet sources (S1-S3) and prediction / report sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regressa.functions.columns import col, normalise_nan


# The texts that the reference's CSV reader takes as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
           "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema=None, infer: bool = True,
             multi_line: bool = False, missing=MISSING) -> DataFrame:
    """Header row, doubled quotes inside quoted fields, missing-value
    texts as NULL; integers, doubles and booleans are inferred (dates stay
    strings), or an explicit schema is applied, the better choice at scale
    (inference reads the data an extra time). ``multi_line`` lets a quoted
    field hold line ends, at the price of unsplittable files."""
    rows = spark.read.option("header", True).option("escape", '"') \
        .option("multiLine", multi_line).option("inferSchema", False).csv(path)
    rows = rows.select(*[F.when(~col(c).isin(*missing), col(c)).alias(c) for c in rows.columns])
    if schema is not None:
        kinds = {f.name: f.dataType for f in (
            schema.fields if hasattr(schema, "fields") else spark.createDataFrame([], schema).schema)}
    else:
        kinds = _inferred(rows) if infer else {}
    return normalise_nan(rows.select(*[col(c).cast(kinds.get(c, "string")).alias(c)
                                       for c in rows.columns]))


def _inferred(rows: DataFrame) -> dict[str, str]:
    """The narrowest of int, bigint, double and boolean that all values of a
    column have, in one pass; a column without values is a double."""
    kinds = ("int", "bigint", "double", "boolean")

    def fits(c: str, kind: str):
        value = F.trim(col(c))
        if kind == "boolean":
            return F.count_if(F.lower(value).isin("true", "false"))
        number = F.count_if(value.try_cast(kind).isNotNull())
        # A cast to an integer would cut decimals off.
        return number if kind == "double" else F.count_if(
            value.rlike(r"^[+-]?[0-9]+$") & value.try_cast(kind).isNotNull())

    counts = rows.agg(*[a.alias(f"{i}_{k}") for i, c in enumerate(rows.columns) for k, a in (
        ("n", F.count(col(c))), *((kind, fits(c, kind)) for kind in kinds))]).first()
    out = {}
    for i, c in enumerate(rows.columns):
        n = counts[f"{i}_n"]
        out[c] = "double" if not n else next((k for k in kinds if counts[f"{i}_{k}"] == n), "string")
    return out


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scoring input in any Spark file format."""
    return normalise_nan(spark.read.format(fmt).load(path))


def from_pandas(spark: SparkSession, pdf) -> DataFrame:
    """S3: an in-memory pandas table (Arrow transfer); NaN -> NULL."""
    return normalise_nan(spark.createDataFrame(pdf))


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Input rows plus ``predicted_<target>``; written by every task in
    parallel (one file per partition)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_report(spark: SparkSession, path: str, result, params) -> None:
    """Summary, all-model metrics, CV scores, dataset info and config as
    JSON (the comparison and CV tables are written by Spark)."""
    import dataclasses

    summary = {
        "best_model": result.best_name,
        "success": result.success,
        "stages": result.stages,
        "preprocessing_steps": result.steps,
        "config": dataclasses.asdict(params),
    }
    spark.createDataFrame([(json.dumps(summary, default=str),)], "summary string") \
        .coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    if result.comparison is not None:
        result.comparison.coalesce(1).write.mode("overwrite").json(f"{path}/models")
    if result.cv_scores is not None:
        result.cv_scores.coalesce(1).write.mode("overwrite").json(f"{path}/cross_validation")
    if result.summary is not None:
        result.summary.coalesce(1).write.mode("overwrite").json(f"{path}/dataset")


def with_prediction_column(df: DataFrame, pred: DataFrame, key_cols, target: str) -> DataFrame:
    """Join scored keys back to the input rows (S7 layout)."""
    return df.join(pred, list(key_cols), "left")
