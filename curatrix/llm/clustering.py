"""Centroid clustering of whole-number vectors by scalar lookup tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a block, whose occurring values are tabulated together.
BLOCK = 8192


@dataclass(frozen=True)
class Settings:
    """``dim`` components a vector, times ``scale`` and rounded down; ``k`` centroids, ``rounds`` rounds; ``seed``
    goes into the hash that picks the first centroids."""

    dim: int = 64
    scale: int = 1024
    k: int = 8
    rounds: int = 10
    seed: int = 3

    @property
    def largest(self) -> int:
        """Whole numbers below it have squared distances that fit in 64 bits."""
        return min(1 << 30, math.isqrt(((1 << 63) - 1) // self.dim) // 2)


def whole_vectors(df: DataFrame, row_id: str, vector: str, s: Settings) -> DataFrame:
    """``id, v``: rows whose vectors have just ``s.dim`` components, all finite, as whole numbers."""
    x = F.col("v")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == s.dim) & finite)
    near = F.forall(x, lambda c: F.abs(c) * s.scale < s.largest)
    checked = F.when(near, x).otherwise(F.raise_error(F.lit(f"a component times {s.scale} is {s.largest} or more: squared distances don't fit in 64 bits")))
    return rows.select("id", F.transform(checked, lambda c: F.floor(c * s.scale)).alias("v"))


def first_centroids(whole: DataFrame, s: Settings) -> np.ndarray:
    """The ``s.k`` vectors of the least hashes, in their order; of equal ids the least vectors."""
    label: Column = F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = whole.select(F.sha2(label, 256).alias("h"), "v").orderBy("h", "v").limit(s.k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), s.dim)


def _blocks(dim: int):
    """Blocks of vectors, each with the values that occur in it by dimension and every component's place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                v = np.asarray(part["v"].flatten(), np.int64).reshape(len(part), dim)
                values, codes = zip(*(np.unique(v[:, d], return_inverse=True) for d in range(dim)), strict=True)
                row = {
                    "ids": part["id"].to_pylist(),
                    "n_values": [len(x) for x in values],
                    "occurring": np.concatenate(values).astype("<i4").tobytes(),
                    "codes": np.stack(codes).astype("<u2").tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

    return run


BLOCK_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("n_values", pa.list_(pa.int32())), ("occurring", pa.binary()), ("codes", pa.binary())])
BLOCK_DDL = "ids array<long>, n_values array<int>, occurring binary, codes binary"


def nearest(values: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: the smaller number) and its squared distance.

    By dimension a table has the squared difference of every occurring value from every centroid; a vector's
    distances are the sums of the rows that its components name.
    """
    far = np.zeros((codes.shape[1], len(centroids)), np.int64)
    for d, own in enumerate(values):
        far += np.square(own[:, None] - centroids[None, :, d]).take(codes[d], axis=0)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def _read(row: dict, dim: int) -> tuple[list[np.ndarray], np.ndarray]:
    values = np.split(np.frombuffer(row["occurring"], "<i4").astype(np.int64), np.cumsum(row["n_values"])[:-1])
    return values, np.frombuffer(row["codes"], "<u2").reshape(dim, -1)


def _sums(centroids: np.ndarray):
    """Per block and centroid: its vectors' number and the sums of their components."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                values, codes = _read(row, dim)
                best, _ = nearest(values, codes, centroids)
                count += np.bincount(best, minlength=k)
                for d, own in enumerate(values):
                    # How often each occurring value meets each centroid, as whole numbers; at most BLOCK each.
                    met = np.bincount(best * len(own) + codes[d], minlength=k * len(own)).reshape(k, -1)
                    total[:, d] += met @ own
        some = np.flatnonzero(count)
        if len(some):
            place = np.repeat(some, dim + 1).astype(np.int32)
            at = np.tile(np.arange(-1, dim, dtype=np.int32), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(at), pa.array(np.column_stack([count, total])[some].ravel())], ["cluster", "at", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best, far = nearest(*_read(row, centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(best, pa.int32()), pa.array(far)], ["id", "cluster", "distance"])

    return run


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the rounded-down mean of its vectors; one without vectors stays. k x dim sums come to the driver."""
    sums = blocks.mapInArrow(_sums(centroids), "cluster int, at int, total long")
    # A task's sums fit: fewer than 2^36 vectors. Those of all tasks may not.
    told = sums.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by = {(r.cluster, r["at"]): int(r.total) for r in told}
    out = centroids.copy()
    for c in range(len(centroids)):
        if n := by.get((c, -1)):
            out[c] = [by[c, d] // n for d in range(centroids.shape[1])]
    return out


def cluster_vectors(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> dict:
    """Cluster the rows of ``df`` whose vectors have ``s.dim`` finite components.

    Returns ``rows`` (``row_id, cluster, distance``), ``centroids`` (whole numbers, one row each) and ``clusters``
    (``cluster, cluster_inertia, centroid_sha256`` of every centroid). The vectors are written once as blocks of at most
    8,192 with the values that occur in them, two bytes a component; a round reads the blocks, tabulates
    squared differences for what occurs and shuffles a row per task, centroid and dimension. All numbers are
    whole and exact: any number of tasks gives the same rows.

    Vectors that are null or of another length, and those with a null, infinite or undefined component, have no
    row. Rows with equal ids are clustered each; a null id is hashed as empty text. Fewer vectors than ``s.k``
    are as many centroids; equal first centroids leave the later ones without vectors, which stay. No vectors give
    no rows. A component whose whole number is ``s.largest`` or more is an error, as distances wouldn't fit. Other columns are ignored.
    """
    spark = df.sparkSession
    whole = whole_vectors(df, row_id, vector, s)
    blocks = materialize(whole.mapInArrow(_blocks(s.dim), BLOCK_DDL), "blocks")
    centroids = first_centroids(whole, s)
    if not len(centroids):
        none = spark.createDataFrame([], f"{row_id} long, cluster int, distance long")
        return {"rows": none, "centroids": centroids, "clusters": spark.createDataFrame([], "cluster int, cluster_inertia long, centroid_sha256 string")}
    for _ in range(s.rounds):
        centroids = moved(blocks, centroids)
    rows = materialize(blocks.mapInArrow(_assigned(centroids), "id long, cluster int, distance long"), "assigned")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame(list(enumerate(digest)), "cluster int, centroid_sha256 string")
    spread = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia"))
    clusters = known.join(spread, "cluster", "left").fillna(0, ["cluster_inertia"])
    return {"rows": rows.withColumnRenamed("id", row_id), "centroids": centroids, "clusters": clusters}


def clustered(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """``row_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every clustered vector."""
    found = cluster_vectors(df, row_id, vector, s)
    told = found["clusters"].collect()  # a row per centroid
    whole = found["clusters"].sparkSession.createDataFrame(
        [(r.cluster, r.cluster_inertia, sum(x.cluster_inertia for x in told), r.centroid_sha256) for r in told],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found["rows"].join(F.broadcast(whole), "cluster").select(row_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
