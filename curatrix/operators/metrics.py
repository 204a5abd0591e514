"""Exact ranking and threshold metrics from score histograms.

Scores are first counted by distinct value; only then is anything running. Where scores are
continuous the histogram is as long as the data, so its running sums go by ranges of the scores
that occur: sums per range are few, and each range is summed by a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import cut


def histogram(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, s, pos, neg`` per distinct score of labelled, scored rows."""
    rows = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return rows.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def running(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds the positives and negatives of higher scores, ``pos_above`` and ``neg_above``.

    Ranges hold about as many distinct scores each, wherever the scores lie and whichever group they are of. They are
    written once, as both their sums and the rows within them must see the same ranges. A null group is a group.
    """
    n = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(hist.repartitionByRange(n, *by, F.desc("s")).withColumn("__r", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__r").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    over = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    zero = F.lit(0).cast("long")
    groups = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    offsets = sums.select(*groups, F.col("__r").alias("__q"), F.coalesce(F.sum("p").over(over), zero).alias("__p"), F.coalesce(F.sum("n").over(over), zero).alias("__n"))
    own = Window.partitionBy(*by, "__r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumns({"__ip": F.coalesce(F.sum("pos").over(own), zero), "__in": F.coalesce(F.sum("neg").over(own), zero)})
    same = F.col("__r") == F.col("__q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = inner.join(offsets, same)
    return out.withColumns({"pos_above": F.col("__p") + F.col("__ip"), "neg_above": F.col("__n") + F.col("__in")}).select(*hist.columns, "pos_above", "neg_above")


def _two_classes(value: Column) -> Column:
    return F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), value)


def ranking(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``n_pos, n_neg, auc, ap`` (M1, M2): ties count half in the area; precision steps over distinct
    scores. Both null where a class is absent (F14)."""
    # Positives of the whole group are needed per step; they divide the sum, so one pass does.
    n_at = F.col("pos_above") + F.col("pos")
    all_at = n_at + F.col("neg_above") + F.col("neg")
    return running(histogram(df, score, label, by), by).groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        _two_classes(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)) / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"),
        _two_classes(F.sum(F.col("pos") * n_at / all_at) / F.sum("pos")).alias("ap"),
    )


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking(df, score, label, by).select(*by, "auc")


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking(df, score, label, by).select(*by, "ap")


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def _mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (tp + fp, tp + fn, tn + fp, tn + fn))
    product = a * b * c * d
    return F.when(product > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / F.sqrt(product)).otherwise(0.0)


def f1_mcc(df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """``tp, fp, fn, tn, f1, mcc`` at a threshold, score >= threshold being positive (M3); 0 where undefined."""
    up, one = F.col(score) >= threshold, F.col(label) == 1
    counts = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).groupBy(*by).agg(
        F.count_if(up & one).alias("tp"), F.count_if(up & ~one).alias("fp"), F.count_if(~up & one).alias("fn"), F.count_if(~up & ~one).alias("tn")
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"f1": _f1(tp, fp, fn), "mcc": _mcc(tp, fp, fn, tn)})


def threshold_sweep(df: DataFrame, score: str, label: str, lo: float = 0.1, hi: float = 0.9, steps: int = 81) -> DataFrame:
    """``k, threshold, f1, mcc`` for evenly spaced thresholds (M4).

    A row is counted once, at the highest threshold it reaches; running sums over the thresholds
    (a fixed number) give all confusion counts, so rows are never multiplied by thresholds.
    """
    spark = df.sparkSession
    marks = [lo + (hi - lo) * k / (steps - 1) for k in range(steps)]
    # The grid's own values decide, so that a score equal to one counts as reaching it.
    reached = F.size(F.filter(F.array(*map(F.lit, marks)), lambda t: t <= F.col("s"))) - 1
    counts = histogram(df, score, label).groupBy(reached.alias("k")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = spark.createDataFrame([(-1, None), *enumerate(marks)], "k int, threshold double").join(counts, "k", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("k"))  # a row per threshold
    whole = Window.partitionBy()
    tp, fp = F.sum("pos").over(above), F.sum("neg").over(above)
    sums = grid.withColumns({"tp": tp, "fp": fp, "p": F.sum("pos").over(whole), "n": F.sum("neg").over(whole)}).where("k >= 0")
    args = (F.col("tp"), F.col("fp"), F.col("p") - F.col("tp"))
    return sums.select("k", "threshold", _f1(*args).alias("f1"), _mcc(*args, F.col("n") - F.col("fp")).alias("mcc"))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The first threshold of the highest F1, and of the highest MCC (M4)."""
    first = lambda m: F.min_by(F.struct("threshold", m), F.struct(-F.round(m, 12), F.col("k")))
    best = threshold_sweep(df, score, label).agg(first("f1").alias("a"), first("mcc").alias("b"))
    return best.select(F.col("a.threshold").alias("f1_threshold"), F.col("a.f1").alias("f1"), F.col("b.threshold").alias("mcc_threshold"), F.col("b.mcc").alias("mcc"))


def brier(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of a probability (M5)."""
    return df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def ece(df: DataFrame, score: str, label: str, bins: int = 10, closed_last: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over bins [lo, hi) (M6). A score of 1 is in no bin, yet counts in n,
    unless ``closed_last``."""
    s = F.col(score).cast("double")
    edges = F.array(*[F.lit(k / bins) for k in range(bins)])
    place = F.when(s < 1, F.size(F.filter(edges, lambda e: e <= s)) - 1)
    place = F.when(s == 1, bins - 1).otherwise(place) if closed_last else place
    rows = df.where(F.col(label).isin(0, 1) & s.isNotNull()).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(s).alias("conf"), F.avg(F.col(label).cast("double")).alias("acc"))
    part = F.when(F.col("bin") >= 0, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return rows.groupBy(*by).agg((F.sum(part) / F.sum("n")).alias("ece"))


def binary_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5, calibrated: str | None = None, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """All metrics of a group in one row, rounded half to even (M7, M9). An undefined one is null and
    harms no other. Threshold metrics, Brier and calibration error use ``calibrated`` where given."""
    prob = calibrated or score
    parts = [ranking(df, score, label, by), f1_mcc(df, prob, label, threshold, by), brier(df, prob, label, by), ece(df, prob, label, by=by)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(by)) if by else out.crossJoin(p)  # one row each
    return out.select(*by, "n_pos", "n_neg", *[F.bround(c, digits).alias(c) for c in ("auc", "ap", "f1", "mcc", "brier", "ece")])


def rescore(df: DataFrame, score: str, label: str, saved: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fresh and saved areas side by side, with one minus it (M8); which is right is for the reader."""
    fresh = ranking(df, score, label, by).select(*by, "auc", (1 - F.col("auc")).alias("auc_flipped"))
    return fresh.join(saved, list(by), "left").withColumn("drift", F.col("auc") - F.col("saved_auc"))
