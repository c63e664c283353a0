"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regressa.session import ensure_checkpoint_dir

#: Java and Python pattern of the white space that the contracts name.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(quoted(name)), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def keep(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, so that later jobs read the
    rows back whichever executors are lost meanwhile."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values in a sorted array."""
    if len(keys):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        yield from zip(edges[:-1], edges[1:], strict=True)


def row_numbers(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its 1-based position in ``order`` (a total order) as column ``name``.

    Rows are range-sorted and checkpointed, so the ranges stay as they are; each range then adds
    the number of rows before it. Only one row a range meets in one task.
    """
    from pyspark.sql import Window

    ranged = keep(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(name, within).join(before.select("__range", "__before"), "__range") \
        .withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def split_join(rows: DataFrame, others: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``others (key, ..., n)``: one row a key (never null), which ``n``
    of the ``total`` rows have. Keys of at least a thousandth of all rows, of which there are a
    thousand at most, are broadcast, so their rows stay where they are."""
    limit = max(1, total // 1000)
    hot = F.broadcast(others.where(F.col("n") >= limit))
    there = rows.join(hot, key)
    return there.unionByName(rows.join(hot.select(key), key, "left_anti").join(
        others.where(F.col("n") < limit), key))
