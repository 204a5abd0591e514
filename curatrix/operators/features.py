"""Fingerprints, vectors and feature tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_missing, let, valid_vector
from .dedup import build_model_ready, flag_duplicates
from .joins import pending


def fingerprint(value: Column, n_bits: int = 2048, k: int = 3) -> Column:
    """The distinct set bits, sorted, of a text's k-word shingles folded to ``n_bits``, at most 2^31 (X1): the first 32
    bits of a shingle's MD5 modulo ``n_bits``, which any engine computes alike."""
    words = F.filter(F.split(F.coalesce(value, F.lit("")), r"\s+"), lambda w: w != "")
    none = F.array().cast("array<string>")

    def shingles(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
        return F.when(F.size(w) > 0, F.transform(places, lambda i: F.array_join(F.slice(w, i + 1, k), " "))).otherwise(none)

    return F.array_sort(F.array_distinct(F.transform(let(words, shingles), lambda s: (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % n_bits).cast("int"))))


def pack_bits(bits: Column, n_bits: int = 2048) -> Column:
    """Set bits to ``n_bits / 8`` bytes, most significant bit first (X2): masks of 32 bits, each summed in one pass."""
    nothing = F.array().cast("array<int>")

    def whole(own: Column) -> Column:
        mask = lambda i: F.aggregate(own, F.lit(0).cast("long"), lambda s, b: s + F.when(F.shiftright(b, 5) == i, F.call_function("shiftleft", F.lit(1).cast("long"), 31 - b % 32)).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit(n_bits // 32 - 1)), lambda i: F.lpad(F.hex(mask(i)), 8, "0"))

    return F.unhex(F.array_join(let(F.array_distinct(F.coalesce(bits, nothing)), whole), ""))


def unpack_bits(packed: Column, n_bits: int = 2048) -> Column:
    """The inverse: sorted set bits (X3). Of the hex digits only those that have a bit are looked into."""
    digits = F.transform(F.split(F.hex(packed), ""), lambda x, i: F.struct((F.instr(F.lit("0123456789ABCDEF"), x) - 1).alias("v"), (i * 4).alias("at")))
    bits = lambda d: F.filter(F.sequence(d["at"], d["at"] + 3), lambda b: F.floor(d["v"] / F.pow(F.lit(2), 3 - b % 4)) % 2 == 1)
    return F.flatten(F.transform(F.filter(digits, lambda d: d["v"] > 0), bits))


@F.pandas_udf(T.BinaryType())
def pack_bits_fast(bits: pd.Series) -> pd.Series:
    """As ``pack_bits`` for 2048 bits, by numpy over Arrow batches."""
    out = np.zeros((len(bits), 2048), np.uint8)
    for i, own in enumerate(bits):
        out[i, np.asarray(own, int)] = 1
    return pd.Series([r.tobytes() for r in np.packbits(out, axis=1)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpack_bits_fast(packed: pd.Series) -> pd.Series:
    return pd.Series([np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8))).astype(np.int32) for p in packed])


def descriptors(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Named numbers over a record (X4); one that is null becomes NaN and the row stays."""
    return df.withColumns({name: F.coalesce(e.cast("double"), F.lit(float("nan"))) for name, e in exprs.items()})


def featurize(df: DataFrame, row_id: str, value: str, key: Column, exprs: dict[str, Column], n_bits: int = 2048) -> DataFrame:
    """All rows with flags, descriptors and set bits."""
    flagged = df.withColumns({"is_missing": is_missing(F.col(value)), "key": key})
    flagged = flagged.withColumn("is_valid", ~F.col("is_missing") & F.col("key").isNotNull())
    return flag_duplicates(descriptors(flagged, exprs).withColumn("bits", fingerprint(F.col(value), n_bits)), "key")


def featurize_job(full: DataFrame, row_id: str, label: str) -> dict[str, DataFrame]:
    """The tables of a feature job: full, model, conflicts, label_review, and a row of counts.

    ``full`` should be persisted or read from a table, as four outputs share it.
    """
    model, conflicts, review = build_model_ready(full.where("is_valid"), row_id, "key", label)
    counts = [t.agg(F.count("*").alias(f"n_{name}")) for name, t in (("full", full), ("model", model), ("conflicts", conflicts), ("label_review", review))]
    meta = counts[0]
    for c in counts[1:]:
        meta = meta.crossJoin(c)  # one row each
    return {"full": full, "model": model, "conflicts": conflicts, "label_review": review, "meta": meta}


def check_compatible(meta: DataFrame, **wanted: str) -> None:
    """A store made by another model, revision or pooling is an error (X7). ``meta``: key, value."""
    have = {r.key: r.value for r in meta.where(F.col("key").isin(*wanted)).collect()}
    if bad := {k: (have[k], v) for k, v in wanted.items() if k in have and have[k] != v}:
        raise ValueError(f"the vector store differs: {bad}")


def embed_pending(df: DataFrame, key: str, store: DataFrame, skipped: DataFrame, embed: Callable[[list[str]], np.ndarray], most: int = 2000) -> DataFrame:
    """Vectors of the keys that are neither stored nor skipped (X7, E4): ``key, vector, status, reason``.

    Status ok, skip_permanent (too long; to be kept) or retry (failed; to be tried again). A batch
    that fails is retried key by key.
    """
    return embed_keys(pending(df.select(F.col(key).alias("key")), "key", store.select("key"), skipped.select("key")), embed, most)


def embed_keys(work: DataFrame, embed: Callable[[list[str]], np.ndarray], most: int = 2000) -> DataFrame:
    """The same of the distinct keys of ``work(key)``. Rows are dealt by length, so that batches are of like lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            fits = [k for k in batch["key"] if len(k) <= most]
            try:
                rows = [(k, v.tolist(), "ok", None) for k, v in zip(fits, embed(fits), strict=True)] if fits else []
            except Exception:
                for k in fits:
                    try:
                        rows.append((k, embed([k])[0].tolist(), "ok", None))
                    except Exception as e:  # the key's own failure is its result
                        rows.append((k, None, "retry", f"{type(e).__name__}: {e}"))
            rows += [(k, None, "skip_permanent", "too long") for k in batch["key"] if len(k) > most]
            yield pd.DataFrame(rows, columns=["key", "vector", "status", "reason"])

    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = work.repartitionByRange(parts, F.length("key")).sortWithinPartitions(F.length("key"))
    return ordered.mapInPandas(run, "key string, vector array<float>, status string, reason string")


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of an array of vectors where the mask is set, per dimension."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    sums = F.aggregate(weighted, F.transform(vectors[0], lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(sums, lambda x: x / total)


def masked_mean_rows(df: DataFrame, by: str, vector: str, mask: str) -> DataFrame:
    """The same over rows of a group (X8): sums by dimension, combined before the shuffle."""
    long = df.select(by, F.col(mask).cast("double").alias("m"), F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(by, "dim").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("mean"))


def build_combined(df: DataFrame, store: DataFrame, key: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid vector, and the others with the reason."""
    joined = df.join(store.select(key, "vector"), key, "left")
    good = valid_vector(F.col("vector"), dim)
    reason = F.when(F.col("vector").isNull(), "no vector").otherwise("invalid vector")
    return joined.where(good), joined.where(~good).select(*df.columns, reason.alias("reason"))


def cache_key(df: DataFrame, columns: Sequence[str]) -> str:
    """A name for a table's content, whatever its order (X11): counts and sums of row hashes."""
    h = F.xxhash64(*columns)
    r = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("b")).first()
    return f"{r.n}-{int(r.a or 0) & (1 << 64) - 1:016x}-{(r.b or 0) & (1 << 64) - 1:016x}"
