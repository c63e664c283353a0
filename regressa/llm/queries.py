"""The dealt operators applied, with production parameters, to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regressa.llm import (byte_bpe, chat, embedding_dedup, exact_dedup, lexical, licenses, mixing,
                          packing, quality, sharding, simhash, token_counts, whitening)
from regressa.llm.common import read


def op1_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all conversations; spans as ``start:end`` lists."""

    def spans(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(
            ":", s.start.cast("string"), s.end.cast("string"))), ",").alias(name)

    convs = chat.conversations(read(spark, sf_dir, "conversations"))
    made = chat.format_preferences(chat.preference_pairs(convs))
    return made.select("conv_id", "chosen_id", "kind", "common_turns", "prompt", "chosen",
                       "rejected", spans("chosen_loss"), spans("rejected_loss"), "usable")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op8_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preference_formatting": op1_preference_formatting,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_entropy_mixing": op3_entropy_mixing,
    "op4_curve_packing": op4_curve_packing,
    "op5_license_scan": op5_license_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_quality_attention": op7_quality_attention,
    "op8_stratified_sharding": op8_stratified_sharding,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_lexical_search": op13_lexical_search,
}
