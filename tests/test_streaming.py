import tempfile

from pyspark.sql import functions as F

from regressa.streaming.monitor import start_monitor
from tests.conftest import SF0001


def test_foreach_batch_monitor_on_events(spark):
    """events parquet replayed as a stream: drift and batch rows per micro-batch."""
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    src = tempfile.mkdtemp(prefix="regressa-stream-src-")
    ev.where(F.dayofmonth("ts") > 15).withColumn("value", F.col("value") * 1.5) \
        .withColumn("prediction", F.col("value")).write.mode("overwrite").parquet(src)
    out = tempfile.mkdtemp(prefix="regressa-stream-out-")
    ck = tempfile.mkdtemp(prefix="regressa-stream-ck-")
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_monitor(stream, ev.where(F.dayofmonth("ts") <= 15), ["value"], out, ck,
                      prediction_col="prediction", label_col="value", key_cols=["event_id"],
                      trigger={"availableNow": True})
    q.awaitTermination(120)
    drift_rows = spark.read.parquet(f"{out}/drift").collect()
    assert drift_rows and all(r["feature"] == "value" for r in drift_rows)
    batches = spark.read.parquet(f"{out}/batches").collect()
    assert sum(r["batch_size"] for r in batches) == spark.read.parquet(src).count()
    assert all(abs(r["r2"] - 1.0) < 1e-12 for r in batches if r["r2"] is not None)


def test_a_repeated_batch_replaces_its_results(spark, tmp_path):
    from regressa.streaming.monitor import batch_writer, reference_stats

    df = spark.range(60).select("id", F.col("id").cast("double").alias("v.x"),
                                F.col("id").cast("double").alias("prediction"), F.lit(1.0).alias("y"))
    write = batch_writer(reference_stats(df, ["v.x"]), str(tmp_path), "prediction", "y", ["id"])
    for batch_id in (0, 1, 1, 0):  # both batches are run again
        write(df.where(f"id % 2 = {batch_id}"), batch_id)
    rows = spark.read.parquet(f"{tmp_path}/batches").collect()
    assert sorted((r["batch_id"], r["batch_size"]) for r in rows) == [(0, 30), (1, 30)]
    assert spark.read.parquet(f"{tmp_path}/drift").count() == 2
