"""A store of vectors by key that grows by what it lacks.

``vectors`` has a folder per bucket of the key's hash: an update reads and overwrites only the buckets
that it has rows for. ``filter`` has a blocked Bloom filter of the keys that are done: a block is 4 KB of bits, and a key
sets a few bits of one block. Most new keys are told as new by it, without a look at the vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut
from ..sources.tables import read_table, write_table
from .features import check_compatible, embed_keys

#: Bits of a block, as Spark's bitmaps have them, and how many of them a key sets.
BITS, HASHES = 1 << 15, 6
VECTORS = "key string, vector array<float>, status string, reason string, round int, bucket int"


def create_store(spark: SparkSession, path: str, buckets: int = 64, blocks: int = 256, **meta: str) -> None:
    """An empty store. ``meta`` says what its vectors are of: model, revision, pooling and so on. A block holds some
    3,000 keys with few false answers; more cost time, never rows."""
    rows = [*meta.items(), ("buckets", str(buckets)), ("blocks", str(blocks))]
    write_table(spark.createDataFrame(rows, "key string, value string").coalesce(1), f"{path}/meta", mode="error")


def _numbers(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    meta = read_table(spark, f"{path}/meta", schema="key string, value string")
    told = {r.key: r.value for r in meta.where("key in ('buckets', 'blocks')").collect()}
    return meta, int(told["buckets"]), int(told["blocks"])


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All that the store knows: ``key, vector, status, reason, round, bucket``; ``ok``, ``skip_permanent`` or ``retry``."""
    at = f"{path}/vectors"
    return read_table(spark, at, schema=VECTORS) if _there(spark, at) else spark.createDataFrame([], VECTORS)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), "key"), F.lit(blocks))


def _bits() -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(BITS)) for i in range(HASHES)]


def filter_of(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, bits`` of the keys; those of two tables are the ``bitmap_or_agg`` of both."""
    set_ = keys.select(_block(blocks).alias("block"), F.explode(F.array(*_bits())).alias("bit"))
    return set_.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_known(keys: DataFrame, filters: DataFrame, blocks: int) -> DataFrame:
    """Adds ``known``: false for keys that surely aren't in the filter, true for all that are and for few others."""
    whole = filters.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")).select(F.col("block").alias("__block"), "bits")
    byte = lambda at: F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.lit(True)
    for i in range(HASHES):
        there = there & (F.call_function("getbit", byte(F.col(f"__{i}")), (F.col(f"__{i}") % 8).cast("int")) == 1)
    asked = keys.withColumns({f"__{i}": b for i, b in enumerate(_bits())})
    met = asked.join(whole, _block(blocks) == F.col("__block"), "left")
    return met.select(*keys.columns, F.coalesce(there, F.lit(False)).alias("known"))


def pending_keys(df: DataFrame, key: str, path: str) -> DataFrame:
    """``key, bucket``: distinct keys that are neither stored nor skipped for good. Null keys are left out."""
    spark = df.sparkSession
    _, buckets, blocks = _numbers(spark, path)
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"))
    keys = keys.withColumns({"bucket": _bucket(buckets), "digest": F.sha2("key", 256)})
    # One shuffle by digest finds copies and what is done; of what is stored, digests alone move.
    once = keys.dropDuplicates(["digest"])
    if not _there(spark, f"{path}/filter"):
        return once.drop("digest")
    asked = maybe_known(keys.select("key", "bucket"), read_table(spark, f"{path}/filter", schema="block long, bits binary"), blocks)
    # Buckets in which nothing is known aren't read.
    near = [r.bucket for r in asked.where("known").select("bucket").distinct().collect()]
    done = read_vectors(spark, path).where("status <> 'retry'").where(F.col("bucket").isin(near)).select(F.sha2("key", 256).alias("digest"))
    return once.join(done, "digest", "left_anti").select("key", "bucket")


def upsert(rows: DataFrame, path: str) -> int:
    """Put ``rows`` (of ``VECTORS``, a row a key; read twice, so better a table) into the store, in place of its rows of these
    keys. Only their buckets are read and overwritten; returns how many. What is new meets what is there in the one shuffle
    that deals rows to buckets. Spark writes beside the buckets and renames at the end, so they can be read meanwhile."""
    spark = rows.sparkSession
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most all buckets
    if not touched:
        return 0
    old = read_vectors(spark, path).where(F.col("bucket").isin(touched)).withColumn("fresh", F.lit(0))
    dealt = old.unionByName(rows.withColumn("fresh", F.lit(1))).repartition(len(touched), "bucket")
    last = dealt.groupBy("bucket", "key").agg(F.max_by(F.struct("vector", "status", "reason", "round"), "fresh").alias("row")).select("key", "row.*", "bucket")
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/vectors")
    return len(touched)


def update_vectors(df: DataFrame, key: str, path: str, embed: Callable[[list[str]], np.ndarray], most: int = 2000, **meta: str) -> dict[str, int]:
    """Embed the keys of ``df`` that the store lacks and put them in; how many are now ok, skipped for good or to be tried again.

    ``meta`` must be what the store was made with. A run that dies before its filter is written leaves keys that are
    embedded again, with the same result; one that is repeated adds nothing.
    """
    spark = df.sparkSession
    known, buckets, blocks = _numbers(spark, path)
    check_compatible(known, **meta)
    todo = cut(pending_keys(df, key, path))
    last = read_vectors(spark, path).agg(F.max("round").alias("r")).first().r or 0
    found = cut(embed_keys(todo.select("key"), embed, most).withColumns({"round": F.lit(last + 1), "bucket": _bucket(buckets)}))
    upsert(found.select("key", "vector", "status", "reason", "round", "bucket"), path)
    filter_of(found.where("status <> 'retry'").select("key"), blocks).write.mode("append").parquet(f"{path}/filter")
    counts = {r.status: r.n for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return {s: counts.get(s, 0) for s in ("ok", "skip_permanent", "retry")}
