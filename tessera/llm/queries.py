"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    html_density,
    langid_ppm,
    lexical_blocks,
    mixing_pivotal,
    mpeg_media,
    quality_ftrl,
    rlz_spans,
    secret_novelty,
    signature_tree,
    simhash_decontam,
    suffix_buckets,
    token_alignment,
    toxicity_channel,
)
from tessera.llm.common import table
from tessera.llm.oracles import ORACLES


def op1_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_langid_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_ppm.language_digest(table(spark, sf_dir, "documents"))


def op3_media_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_media.media_digest(table(spark, sf_dir, "documents"))


def op4_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_buckets.repeats_digest(table(spark, sf_dir, "documents"))


def op5_rlz_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_spans.spans_digest(table(spark, sf_dir, "documents"))


def op6_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_pivotal.mix_digest(table(spark, sf_dir, "documents"))


def op7_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(table(spark, sf_dir, "pages"))


def op8_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.jaccard_digest(table(spark, sf_dir, "documents"))


def op9_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_novelty.scan(table(spark, sf_dir, "documents"))


def op10_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_decontam.leaks_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digest(table(spark, sf_dir, "documents"))


def op12_lexical_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_blocks.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_channel.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_ftrl,
        op2_langid_ppm,
        op3_media_mpeg,
        op4_suffix_buckets,
        op5_rlz_spans,
        op6_mix_pivotal,
        op7_html_density,
        op8_signature_tree,
        op9_secret_novelty,
        op10_simhash_decontam,
        op11_token_alignment,
        op12_lexical_blocks,
        op13_toxicity_channel,
    )
}

__all__ = ["ORACLES", "QUERIES"]
