"""Joins between tables of one dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_vectors(df: DataFrame, store: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a vector, and the rows without."""
    joined = df.join(store.select(key, "vector"), key, "left")
    return joined.where("vector is not null"), joined.where("vector is null").select(df.columns)


def pending(df: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Distinct keys that none of the tables has (J2): the work list of an incremental job."""
    left = df.select(key).where(F.col(key).isNotNull()).distinct()
    for table in done:
        left = left.join(table.select(key), key, "left_anti")
    return left


def exclude(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the other table; null keys stay."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def leakage_report(df: DataFrame, split: str, key: str) -> DataFrame:
    """``split_a, split_b, n_keys`` per pair of splits that share keys.

    One aggregation per key; pairs are formed within a key's few splits, not by a self-join of rows.
    """
    seen = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where("size(splits) > 1")
    pairs = F.flatten(F.transform("splits", lambda a: F.transform(F.filter("splits", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return seen.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("n_keys"))


def group_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups in more than one split (J5); an honest split has none."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def assert_no_group_leakage(df: DataFrame, group: str, split: str) -> None:
    bad = group_leaks(df, group, split).limit(5).collect()
    if bad:
        raise ValueError(f"groups in several splits, such as {[r[0] for r in bad]}")


def merge_recovered(clean: DataFrame, review: DataFrame, recovery: DataFrame, row_id: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(clean with the recovered rows, review without them) (J6). By row_id, so a second run changes nothing.

    ``recovery``: row_id, recommendation, recovered_value. Keys are to be derived anew afterwards.
    """
    auto = recovery.where("recommendation = 'auto_recoverable'").select(row_id, "recovered_value")
    fresh = review.join(auto, row_id).withColumn(value, F.col("recovered_value")).join(clean.select(row_id), row_id, "left_anti")
    merged = clean.unionByName(fresh.select([c for c in clean.columns if c in fresh.columns]), allowMissingColumns=True)
    return merged.select(clean.columns), review.join(auto.select(row_id), row_id, "left_anti")


def assemble(df: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Columns of several tables side by side, by key and never by position (J7). Rows that a part lacks stay, with nulls."""
    for part in parts:
        df = df.join(part, key, "left")
    return df


def first_name(df: DataFrame, names: DataFrame, key: str, name: str, row_id: str, prefix: str = "row ") -> DataFrame:
    """Each row with its key's first name, else a made one."""
    firsts = names.where(F.col(name).isNotNull()).groupBy(key).agg(F.min_by(name, row_id).alias("display_name"))
    return df.join(firsts, key, "left").withColumn("display_name", F.coalesce("display_name", F.concat(F.lit(prefix), F.col(row_id).cast("string"))))


def gap_report(metrics: DataFrame, market: DataFrame, on: str, metric: str, reference: str) -> DataFrame:
    """Adds ``gap``, the metric less the market's reference, null where there is none."""
    return metrics.join(market.select(on, reference), on, "left").withColumn("gap", F.col(metric) - F.col(reference))


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows, columns matched by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def union_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows, of the columns that both tables have."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(common).union(b.select(common))


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both tables."""
    return a.select(key).intersect(b.select(key))


def name_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, repeats counted (U4)."""
    return a.exceptAll(b)


def is_subset(c: Column, allowed: Sequence) -> Column:
    """Aggregate: whether all non-null values are allowed."""
    return F.count_if(c.isNotNull() & ~c.isin(*allowed)) == 0


def schema_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``same_order, added, removed`` of two tables of ``pos, name``."""
    both = previous.select(F.col("pos").alias("p"), "name").join(current.select(F.col("pos").alias("q"), "name"), "name", "full")
    named = lambda cond: F.array_sort(F.array_agg(F.when(cond, F.col("name"))))
    return both.agg(
        F.coalesce(F.bool_and(F.coalesce(F.col("p") == F.col("q"), F.lit(False))), F.lit(True)).alias("same_order"),
        F.array_join(named(F.col("p").isNull()), ",").alias("added"),
        F.array_join(named(F.col("q").isNull()), ",").alias("removed"),
    )
