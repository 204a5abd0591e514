"""Labelled rows to learn from, and a test of which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; the held-out part is one remainder."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def examples(labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """At most ``most`` labelled rows outside the held-out part, the first by hash: ``doc_id, label``.

    Labels other than 0 and 1 are ignored. Of a document's several labels the highest counts.
    """
    good = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    one = good.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
