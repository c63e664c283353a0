"""A corpus pipeline of five operators: quality, exact and near duplicates, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before has kept. All but
the last return the columns of ``docs``; rows that a stage rejects are gone for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regressa.llm import exact_dedup, mixing, packing, quality, simhash
from regressa.llm.common import quoted, read, shared_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier accepts; it is fitted on ``labels``."""
    return quality.accepted(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near SimHash fingerprints, the document with the smallest id.

    Rows whose id is null, or repeats with another text, are no duplicates by that alone: a row
    stays if its own id is its component's.
    """
    found = simhash.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))) \
        .select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.select(*[F.col(quoted(c)) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the entropy-balanced mixture takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]

#: A trained classifier has no SQL; ``tests/llm/test_pipeline.py`` checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
