"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; a row's fractional rank in its source,
(rank - 1/2) / rows of the source, places it among all rows. Cutting that order into equal counts
gives every shard each source in its share of the whole. Ranks are exact without a sort in one
task: rows go to slices of the order, a slice adds the rows of the slices before it, and a source
of any size has its rows spread over ``SLICES`` of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regressa.llm.common import keep, quoted, text_or_empty

SLICES, SEED = 4096, 42


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", shards: int = 8, seed: int = SEED,
           slices: int = SLICES) -> DataFrame:
    """doc_id, size, text_crc32, source, fraction, position, shard, slot; one row for each row.

    Shards are numbered from 0 and hold counts at most one apart (law ``rows``); slots are gapless
    from 0. Null texts are empty, null sources one more source; rows that repeat an id are ordered
    by their text's hash, and rows that are equal altogether are interchangeable. An empty table
    gives none; further columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(quoted(id_col))).alias("dice"), F.xxhash64(text).alias("tie"))
    # 52 bits of the hash as a fraction, exactly.
    even = F.shiftrightunsigned("dice", 12) / F.lit(float(1 << 52))
    rows = keep(rows.withColumn("slice", F.floor(even * slices)))
    counts = rows.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("m"))
    per = Window.partitionBy("source")
    counts = counts.withColumn("before", F.sum("m").over(per.orderBy("slice")) - F.col("m")) \
        .withColumn("rows", F.sum("m").over(per))
    r, c = rows.alias("r"), counts.alias("c")
    order = Window.partitionBy("r.source", "r.slice").orderBy(
        F.shiftrightunsigned("dice", 1), "dice", "doc_id", "tie")
    ranked = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")) &
                    (F.col("r.slice") == F.col("c.slice"))) \
        .withColumn("rank", F.row_number().over(order) + F.col("before")) \
        .select("doc_id", "r.source", "size", "text_crc32", "dice", "tie",
                ((F.col("rank") - 0.5) / F.col("rows")).alias("fraction"))
    ranked = keep(ranked.withColumn("slice", F.floor(F.col("fraction") * slices)))
    counts = ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("m")).withColumn(
        "before", F.sum("m").over(Window.orderBy("slice")) - F.col("m")) \
        .withColumn("total", F.sum("m").over(Window.partitionBy()))  # at most ``slices`` rows
    order = Window.partitionBy("slice").orderBy(
        "fraction", F.xxhash64(F.lit(seed), "source"), "source", "doc_id", "tie")
    placed = ranked.join(counts, "slice").withColumn(
        "position", F.row_number().over(order) + F.col("before") - 1)
    # A shard begins at the ceiling of shard * total / shards.
    return placed.withColumn("shard", F.expr(f"(position * {shards}) div total")) \
        .withColumn("slot", F.col("position") - F.expr(f"(shard * total + {shards - 1}) div {shards}")) \
        .select("doc_id", "size", "text_crc32", "source", "fraction", "position",
                F.col("shard").cast("int").alias("shard"), "slot")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``)."""
    return assign(docs, **options).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
