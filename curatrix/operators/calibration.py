"""Ensembles, calibration and conformal sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import cut


def ensemble_mean(df: DataFrame, row_id: str, score: str) -> DataFrame:
    """Mean score of a row over its members, nulls left out (L1)."""
    return df.groupBy(row_id).agg(F.avg(score).alias("score"), F.count(score).alias("n_members"))


def ensemble_oof(df: DataFrame, row_id: str, score: str, n_seeds: int) -> DataFrame:
    """Out-of-fold means; ``complete`` where every seed scored the row (L2)."""
    return ensemble_mean(df, row_id, score).withColumn("complete", F.col("n_members") == n_seeds)


def seed_disagreement(df: DataFrame, row_id: str, score: str, alert: float = 0.15) -> DataFrame:
    """Rows, mean and largest deviation over seeds, and how many exceed ``alert`` (L3)."""
    each = df.groupBy(row_id).agg(F.stddev_pop(score).alias("sd"))
    return each.agg(F.count("*").alias("n_rows"), F.avg("sd").alias("mean_sd"), F.max("sd").alias("max_sd"), F.count_if(F.col("sd") > alert).alias("n_alert"))


@dataclass(frozen=True)
class IsotonicMap:
    """A monotone, piecewise linear map: at the scores ``at`` (ascending) it has the values ``value``."""

    at: tuple[float, ...]
    value: tuple[float, ...]


#: Blocks of scores with one frequency; hulls of so many ranges are merged at a time.
BLOCKS, TOGETHER = "r long, lo double, hi double, n long, pos long", 8


def pooled(blocks: Iterable[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Blocks ``lo, hi, n, pos`` in order, neighbours joined until frequencies rise: the edges of the lower hull of the
    running sums. Pooling parts first and then what they give pools the whole."""
    out: list[tuple[float, float, int, int]] = []
    for lo, hi, n, pos in blocks:
        while out and out[-1][3] * n >= pos * out[-1][2]:  # whole numbers, so equal frequencies are equal
            first = out.pop()
            lo, n, pos = first[0], n + first[2], pos + first[3]
        out.append((lo, hi, n, pos))
    return out


def _as_batch(r: int, blocks: list) -> pa.RecordBatch:
    columns = list(zip(*blocks, strict=True)) or [(), (), (), ()]
    kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r] * len(blocks), pa.int64()), *map(pa.array, columns, kinds)], ["r", "lo", "hi", "n", "pos"])


def _hull_of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hull of a range's scores, which come in order."""
    rows = (x for b in batches for x in zip(b["s"].to_pylist(), b["s"].to_pylist(), b["n"].to_pylist(), b["pos"].to_pylist(), strict=True))
    yield _as_batch(TaskContext.get().partitionId(), pooled(rows))


def _hull_of_hulls(key: tuple, table: pa.Table) -> pa.Table:
    own = table.sort_by("lo")
    return pa.Table.from_batches([_as_batch(key[0].as_py(), pooled(zip(*(own[c].to_pylist() for c in ("lo", "hi", "n", "pos")), strict=True)))])


def isotonic_blocks(df: DataFrame, score: str, label: str) -> DataFrame:
    """``lo, hi, n, pos``: the ranges of scores that share a frequency, of labelled and scored rows (L4).

    Equal scores are counted once. Ranges of the score give the lower hull of their running sums; hulls of neighbouring
    ranges are merged, ``TOGETHER`` at a time, until one is left. A hull of n rows has at most some n^(2/3) edges, so no
    task sees all scores.
    """
    s = F.col(score).cast("double")
    rows = df.where(F.col(label).isin(0, 1) & s.isNotNull() & ~F.isnan(s)).groupBy(s.alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hulls = cut(rows.repartitionByRange(parts, "s").sortWithinPartitions("s").mapInArrow(_hull_of_range, BLOCKS))
    while parts > 1:
        parts = -(-parts // TOGETHER)
        hulls = cut(hulls.withColumn("r", F.floor(F.col("r") / TOGETHER)).groupBy("r").applyInArrow(_hull_of_hulls, BLOCKS))
    return hulls.select("lo", "hi", "n", "pos")


def fit_isotonic(df: DataFrame, score: str, label: str) -> IsotonicMap:
    """A monotone map from scores to frequencies (L4): constant within a block, linear between blocks. Only the hull comes to the driver."""
    at, value = [], []
    for r in isotonic_blocks(df, score, label).orderBy("lo").collect():
        for x in dict.fromkeys((r.lo, r.hi)):
            at.append(x)
            value.append(r.pos / r.n)
    return IsotonicMap(tuple(at), tuple(value))


def apply_isotonic(model: IsotonicMap, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    """Interpolates between the fitted points and holds the ends beyond them; nulls stay. Nothing fitted: all null."""
    at, value = np.array(model.at), np.array(model.value)

    @F.pandas_udf("double")
    def calibrated(x: pd.Series) -> pd.Series:
        return pd.Series(np.interp(x.to_numpy(), at, value)).where(x.notna()) if len(at) else pd.Series([None] * len(x), dtype=float)

    return df.withColumn(out, F.when(F.col(score).isNotNull(), calibrated(F.col(score).cast("double"))))


def nonconformity(df: DataFrame, score: str, label: str) -> DataFrame:
    """``class, nc``: one less the probability of the true class."""
    c = F.col(label).cast("int")
    return df.where(c.isin(0, 1) & F.col(score).isNotNull()).select(c.alias("class"), F.when(c == 1, 1 - F.col(score)).otherwise(F.col(score)).alias("nc"))


def conformal_pvalues(test: DataFrame, row_id: str, score: str, calibration: DataFrame, ranges: int = 1024) -> DataFrame:
    """``row_id, class, p`` for both classes (L6): (1 + calibration values as high) / (n + 1).

    Calibration values are counted per distinct value and put in one order with the test's; running
    counts go by ranges of the value, so there is no cross join and no class in one task.
    """
    both = F.explode(F.array(F.struct(F.lit(0).alias("class"), F.col(score).alias("nc")), F.struct(F.lit(1).alias("class"), (1 - F.col(score)).alias("nc"))))
    asked = test.where(F.col(score).isNotNull()).select(F.col(row_id).alias("id"), both.alias("x")).select("id", "x.class", "x.nc", F.lit(1).alias("k"), F.lit(0).cast("long").alias("n"))
    known = calibration.groupBy("class", "nc").agg(F.count("*").alias("n")).select(F.lit(None).cast("long").alias("id"), "class", "nc", F.lit(0).alias("k"), "n")
    rows = known.unionByName(asked.withColumn("id", F.col("id").cast("long"))).withColumn("__r", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("nc"))) * ranges))
    sums = rows.groupBy("class", "__r").agg(F.sum("n").alias("m"))
    above = Window.partitionBy("class").orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("class")
    offsets = sums.select("class", "__r", F.coalesce(F.sum("m").over(above), F.lit(0)).alias("__off"), F.sum("m").over(whole).alias("__all"))
    own = Window.partitionBy("class", "__r").orderBy(F.desc("nc"), "k").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("__own", F.sum("n").over(own)).join(offsets, ["class", "__r"]).where("k = 1")
    return counted.select(F.col("id").alias(row_id), "class", ((1 + F.col("__off") + F.col("__own")) / (F.col("__all") + 1)).alias("p"))


def prediction_sets(pvalues: DataFrame, row_id: str, alpha: float = 0.10) -> DataFrame:
    """``row_id, classes, abstain``: classes whose p exceeds alpha; abstain unless there is just one."""
    sets = pvalues.groupBy(row_id).agg(F.array_sort(F.collect_list(F.when(F.col("p") > alpha, F.col("class")))).alias("classes"))
    return sets.withColumn("abstain", F.size("classes") != 1)


def uncertainty(sets: DataFrame) -> DataFrame:
    """How many rows abstain, and their share."""
    return sets.agg(F.count("*").alias("n_rows"), F.count_if("abstain").alias("n_abstain"), F.avg(F.col("abstain").cast("int")).alias("abstain_rate"))
