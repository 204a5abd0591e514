"""The queries over the operators, and their SQL for the checking engine."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .bpe_codec import encode_documents
from .clustering import clustered
from .common import table
from .fingerprints import fingerprint_documents
from .language_id import identify_languages
from .lexical_search import search
from .mixing import mix_sources
from .near_dedup import Settings, near_duplicates
from .quality_classifier import score_quality
from .quality_rules import judge_quality
from .sharding import shard_documents
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .url_filter import filter_urls

#: The rules that op3 judges by.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digest=True)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=4))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))["digest"]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


QUERIES = [
    op1_fingerprints,
    op2_bpe_codec,
    op3_url_filter,
    op4_near_dedup,
    op5_quality_rules,
    op6_mixing,
    op7_sharding,
    op8_toxicity,
    op9_quality_classifier,
    op10_token_counts,
    op11_language_id,
    op12_lexical_search,
    op13_clustering,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """By query; the others are tested against brute force, round trips or held-out labels."""
    return {
        "op3_url_filter": oracle.op3(RULES),
        "op4_near_dedup": oracle.OP4,
        "op5_quality_rules": oracle.op5(),
        "op6_mixing": oracle.op6(),
        "op12_lexical_search": oracle.op12(),
        "op13_clustering": oracle.op13(),
    }
