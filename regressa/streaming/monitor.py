"""Streaming monitor: D6 (mean-shift drift) and D7 (batch metrics) applied to
each micro-batch of a Structured Streaming source through ``foreachBatch``.

Each micro-batch is an ordinary DataFrame, so the batch operators run
unchanged. A batch's results are the folder ``batch_id=<id>`` of the result table: when
a batch is run again after a failure, it replaces its own folder, so every batch
is in the table once. Progress relies on the query's checkpoint location,
which must be a shared folder on a cluster. The reference statistics are
fitted once (one aggregation) and broadcast as literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.functions.columns import col
from regressa.operators import drift


def reference_stats(reference: DataFrame, columns) -> dict:
    """Per column ``(mean, sample std)`` of the reference data."""
    cols = list(columns)
    r = reference.agg(*[F.struct(F.avg(col(c)).alias("m"), F.stddev_samp(col(c)).alias("s")).alias(f"c{i}")
                        for i, c in enumerate(cols)]).first()
    return {c: (r[f"c{i}"]["m"], r[f"c{i}"]["s"]) for i, c in enumerate(cols)}


def mean_shift_batch(batch: DataFrame, stats: dict, batch_id: int) -> DataFrame:
    """D6 for one micro-batch against fitted reference statistics."""
    cols = list(stats)
    agg = batch.agg(*[F.avg(col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = []
    for i, c in enumerate(cols):
        m, s = stats[c]
        diff = F.abs(F.col(f"c{i}") - F.lit(m))
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.col(f"c{i}").alias("recent_mean"),
            F.lit(m).cast("double").alias("reference_mean"),
            F.lit(s).cast("double").alias("reference_std"),
            F.try_divide(diff, F.lit(s)).alias("drift_magnitude"),
            F.coalesce(diff > F.lit(2.0 * (s or 0.0)), F.lit(False)).alias("drifted")))
    return agg.select(F.lit(batch_id).cast("long").alias("batch_id"),
                      F.explode(F.array(*rows)).alias("r")).select("batch_id", "r.*")


def start_monitor(stream: DataFrame, reference: DataFrame, columns, output_path: str,
                  checkpoint_location: str, prediction_col: str | None = None,
                  label_col: str | None = None, key_cols=(), trigger: dict | None = None):
    """Start a streaming query that, per micro-batch, writes D6 drift rows to
    ``<output_path>/drift`` and, when ``prediction_col`` is given, D7 batch
    metrics to ``<output_path>/batches``; both have the column ``batch_id``.
    Returns the ``StreamingQuery``."""
    run = batch_writer(reference_stats(reference, columns), output_path, prediction_col, label_col, key_cols)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def batch_writer(stats: dict, output_path: str, prediction_col: str | None = None,
                 label_col: str | None = None, key_cols=()):
    """The function that writes a micro-batch's results; a repeated batch id replaces them."""

    def put(rows: DataFrame, table: str, batch_id: int) -> None:
        rows.drop("batch_id").write.mode("overwrite").parquet(f"{output_path}/{table}/batch_id={batch_id}")

    def per_batch(batch: DataFrame, batch_id: int):
        put(mean_shift_batch(batch, stats, batch_id), "drift", batch_id)
        if prediction_col:
            preds = batch.select(*[col(c) for c in key_cols], col(prediction_col).alias("prediction"))
            actual = None
            if label_col:
                actual = batch.select(*[col(c) for c in key_cols], col(label_col).alias("y"))
            put(drift.monitor_batch(preds, actual, key_cols), "batches", batch_id)

    return per_batch
