"""Duplicates and what their labels say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import running
from ..functions.scalars import label_ok
from .cleaning import ELIGIBLE


def key_groups(df: DataFrame, key: str, row_id: str, label: str | None = None, where: Column | None = None) -> DataFrame:
    """``key, n, first_row, n_labels`` of the keys that occur at least twice; nulls are no key.

    Counts are combined before the shuffle, so a key on a third of all rows costs a row per task.
    """
    rows = df.where(F.col(key).isNotNull() & (F.lit(True) if where is None else where))
    labels = F.count_distinct(label) if label else F.lit(0).cast("long")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(row_id).alias("first_row"), labels.alias("n_labels")).where("n >= 2")


def number_groups(groups: DataFrame, order: str = "first_row", name: str = "duplicate_group_id") -> DataFrame:
    """Dense numbers from 0 in the order of ``order`` (W2), by ranges of it: counts per range give the
    offsets, so no task sorts all groups, however sparse the row ids are."""
    return running(groups, [F.col(order)], {name: F.lit(1)})


def resolve_duplicates_a(df: DataFrame, row_id: str, key: str, label: str | None = None, status: str = "status") -> DataFrame:
    """Policy A (W1): adds ``duplicate_group_id``, ``duplicate_reason`` and the resolved ``status``.

    Among eligible rows with a key, in groups of two or more: without a label column all members are
    duplicates; with several distinct non-null labels all are, for conflict; else all but the first row.
    """
    eligible = F.col(status).isin(*ELIGIBLE)
    groups = number_groups(key_groups(df, key, row_id, label, eligible))
    met = df.join(groups.withColumnRenamed(key, "__key"), eligible & (F.col(key) == F.col("__key")), "left")
    hit = F.col("__key").isNotNull()
    unverifiable, conflict = hit & F.lit(label is None), hit & (F.col("n_labels") > 1)
    demoted = unverifiable | conflict | (hit & (F.col(row_id) != F.col("first_row")))
    reason = (
        F.when(unverifiable, "duplicate; labels cannot be compared")
        .when(conflict, "duplicate with conflicting labels")
        .when(demoted, F.concat(F.lit("duplicate of row "), F.col("first_row").cast("string")))
    )
    return met.select(*[c for c in df.columns if c != status], F.when(demoted, "duplicate").otherwise(F.col(status)).alias(status), "duplicate_group_id", reason.alias("duplicate_reason"))


def duplicate_stats(df: DataFrame, row_id: str, key: str, label: str, where: Column | None = None) -> DataFrame:
    """Groups, flagged rows, conflicting groups and rows, from the group table."""
    groups = key_groups(df, key, row_id, label, where)
    clash = F.col("n_labels") > 1
    zero = F.lit(0).cast("long")
    return groups.agg(
        F.count("*").alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(clash, F.col("n")).otherwise(F.col("n") - 1)), zero).alias("duplicate_rows_flagged"),
        F.count_if(clash).alias("conflicting_groups"),
        F.coalesce(F.sum(F.when(clash, F.col("n"))), zero).alias("conflicting_rows"),
    )


def build_model_ready(df: DataFrame, row_id: str, key: str, label: str, allowed=(0, 1)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Policy B (W4): (model, conflicts, label_review).

    Rows with unusable labels go to review first. Of the rest, a key whose labels agree keeps its
    first row; a key whose labels disagree is a conflict as a whole. Rows without key are no group.
    """
    good = label_ok(F.col(label), allowed)
    rows = df.where(good)
    groups = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row_id).alias("__first"), F.count_distinct(label).alias("__labels"))
    met = rows.join(groups, key, "left")
    model = met.where(F.col(key).isNull() | ((F.col("__labels") == 1) & (F.col(row_id) == F.col("__first"))))
    return model.select(df.columns), met.where("__labels > 1").select(df.columns), df.where(~good)


def flag_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Adds ``is_duplicate``: every row of a key that occurs twice or more (W5); null keys never."""
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") > 1).alias("is_duplicate"))
    return df.join(groups, key, "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def distinct_first(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """The first row of each key by ``row_id`` (W6): a combined minimum, not a sort. Nulls are one key."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(row_id)).alias("__r"))
    return best.select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in df.columns])


def dup_count(df: DataFrame, column: str) -> DataFrame:
    """Rows less distinct values, nulls counting as one value."""
    distinct = F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))
    return df.agg((F.count("*") - F.coalesce(distinct, F.lit(0))).alias("n_duplicates"))
