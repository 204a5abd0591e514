"""The corpus pipeline: quality rules, toxicity, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what a stage
returns is written as Parquet in the shared folder and read again as the next one's ``docs``. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curatrix.functions.session import Tables, collecting
from curatrix.llm.bpe_codec import encode_documents
from curatrix.llm.common import materialize, table
from curatrix.llm.mixing import repeat_by_mix
from curatrix.llm.near_dedup import drop_near_duplicates
from curatrix.llm.quality_rules import drop_low_quality
from curatrix.llm.toxicity import drop_toxic

#: Of each thread, the place of the stage that it ran last and the tables that this stage's result reads.
_LEFT = threading.local()


def _stage(place: int) -> Callable:
    """A stage's result is written before the next stage starts, so when the stage that follows it starts in the same
    thread, what else it wrote is deleted. Any other order deletes nothing."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before, left = getattr(_LEFT, "last", (None, Tables()))
            if before == place - 1:
                left.release(spark)
            with collecting() as own:
                out = f(spark, docs, sf_dir)
            _LEFT.last = (place, own)
            return out

        return run_stage

    return wrap


@_stage(0)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the quality rules, each judged by its own text. Null, empty and short texts go; rows that
    share a doc_id, equal rows and rows without lang or source are judged each. No rows give no rows."""
    return drop_low_quality(docs)


@_stage(1)
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that don't score as toxic, each scored by its own text. Without usable labels, and for null and
    empty texts, the base rate decides. No rows give no rows."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


@_stage(2)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id, and one of rows equal in all columns. Null,
    empty and wordless texts have no copies. No rows give no rows."""
    return drop_near_duplicates(docs)


@_stage(3)
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its document; rows without words go. A null source is a source; rows
    that share a doc_id are repeated alike. No rows give no rows."""
    return repeat_by_mix(docs)


@_stage(4)
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; null and empty texts have no ids. No rows give no rows."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near-dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Classifier votes and BPE are not SQL; the tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next. What a stage wrote, and its predecessor's result, goes once its own result
    is written; the last stage's result reads only what that stage wrote, which stays. A run keeps all this to itself, so
    runs side by side don't touch each other's tables."""
    docs, result = table(spark, sf_dir, "documents"), Tables()
    for name, stage in STAGES[:-1]:
        with collecting() as own:
            out = stage.__wrapped__(spark, docs, sf_dir)
        with collecting() as kept:
            docs = materialize(out, name.replace(" ", "-"))
        own.release(spark)
        result.release(spark)
        result = kept
    out = STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
    result.release(spark)
    return out
