"""Counts, profiles and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import cut
from .cleaning import STATUSES

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def shape(df: DataFrame) -> DataFrame:
    """``n_rows, n_columns`` (A1)."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def value_counts(df: DataFrame, column: str, dropna: bool = False) -> DataFrame:
    """``value, n``, nulls as a value unless dropped, most frequent first (A2)."""
    rows = df.where(F.col(column).isNotNull()) if dropna else df
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def label_balance(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and fractions of non-null labels (A3)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def column_stats(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``column, n_unique, n_null`` (A4, A6), one pass: rows are unpivoted, then grouped by column and value,
    so no column's distinct values meet in one task."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    if approximate:
        return long.groupBy("column").agg(F.approx_count_distinct("v").alias("n_unique"), F.count_if(F.col("v").isNull()).alias("n_null"))
    counts = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.count("v").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))


def profile_columns(df: DataFrame, columns: Sequence[str], max_levels: int = 10, samples: int = 5, most: int = 15) -> DataFrame:
    """``column, n_unique, n_null, lo, hi, mean, levels`` (A5).

    Numeric columns of many values have their range and mean; columns of at most ``max_levels`` have
    value counts in ``levels``, others ``samples`` least values. Beyond ``most`` columns no levels.
    """
    numeric = [c for c, t in df.dtypes if c in columns and (t in NUMERIC or t.startswith("decimal"))]
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"), (F.col(c) if c in numeric else F.lit(None)).cast("double").alias("x")) for c in columns]
    counts = df.select(F.explode(F.array(*parts)).alias("p")).select("p.*").groupBy("column", "v", "x").agg(F.count("*").alias("n"))
    level = F.concat(F.coalesce("v", F.lit("null")), F.lit("="), F.col("n").cast("string"))
    sums = counts.groupBy("column").agg(
        F.count("v").alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        (F.sum(F.col("x") * F.col("n")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("mean"),
    )
    # Of a column's values each task passes on the least few only.
    first_few = F.row_number().over(Window.partitionBy("column").orderBy(F.asc_nulls_last("v")))
    least = counts.select("column", "v", "n", first_few.alias("k")).where(F.col("k") <= max(max_levels + 1, samples)) if len(columns) <= most else counts.select("column", "v", "n", F.lit(0).alias("k")).limit(0)
    shown = least.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= max_levels + 1, F.struct("k", level.alias("s"))))), lambda e: e["s"]), "; ").alias("counts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("k") <= samples) & F.col("v").isNotNull(), F.struct("k", "v")))), lambda e: e["v"]), "; ").alias("first"),
    )
    stats = sums.join(shown, "column", "left")
    few = F.col("n_unique") <= max_levels
    levels = F.when(F.lit(len(columns) > most), "").when(few, F.col("counts")).when(F.col("lo").isNotNull(), "").otherwise(F.col("first"))
    return stats.select("column", "n_unique", "n_null", F.when(~few, F.col("lo")).alias("lo"), F.when(~few, F.col("hi")).alias("hi"), F.when(~few, F.col("mean")).alias("mean"), levels.alias("levels"))


def multi_component_rate(df: DataFrame, value: str, delim: str, by: str) -> DataFrame:
    """Rows with the delimiter, by dataset, in one pass."""
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if(F.col(value).contains(delim)).alias("n_multi"))


def status_counts(df: DataFrame, status: str = "status", enum: Sequence[str] = STATUSES) -> DataFrame:
    """``status, n`` of every status, 0 included."""
    names = df.sparkSession.createDataFrame([(s,) for s in enum], "status string")
    counts = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def status_moves(df: DataFrame, before: str, after: str) -> DataFrame:
    """Counts by status before and after duplicate resolution."""
    return df.groupBy(F.col(before).alias("status_before"), F.col(after).alias("status_after")).agg(F.count("*").alias("n"))


def curation_report(df: DataFrame, status: str = "status", reason: str = "duplicate_reason", group: str = "duplicate_group_id", marks: str = "n_marks") -> DataFrame:
    """One row of totals over resolved records (A10), in a single aggregation."""
    n = lambda s: F.count_if(F.col(status) == s)
    clash = F.col(reason).contains("conflicting")
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col(status) != "invalid_smiles").alias("valid_records"),
        *[n(s).alias(f"n_{s}") for s in STATUSES],
        F.count_distinct(group).alias("duplicate_groups"),
        F.count_distinct(F.when(clash, F.col(group))).alias("conflicting_groups"),
        F.count_if(clash).alias("conflicting_rows"),
        F.count_if(F.coalesce(marks, F.lit(0)) > 0).alias("rows_with_marks"),
        F.count_if(F.col(status).isin("clean", "salt_removed")).alias("records_retained"),
        F.count_if(~F.col(status).isin("clean", "salt_removed")).alias("records_excluded"),
    )


def report_document(df: DataFrame, about: dict[str, str], before: str = "status_before", status: str = "status") -> DataFrame:
    """The whole report as one row (A10): what the job was ``about`` (inputs, outputs, columns, versions, times), the
    totals, and the counts of all statuses before and after duplicates were resolved, as JSON."""
    totals = curation_report(df, status)
    counted = lambda c: F.to_json(F.struct(*[F.count_if(F.col(c) == s).alias(s) for s in STATUSES]))
    statuses = df.agg(F.count("*").alias("total_records"), counted(before).alias("pre_duplicate_status_counts"), counted(status).alias("final_status_counts"), F.count_if(F.col(status) == "duplicate").alias("duplicates_flagged"))
    return totals.join(F.broadcast(statuses), "total_records").select(*[F.lit(v).alias(k) for k, v in about.items()], "*")  # a row each


def examples(df: DataFrame, by: str, row_id: str, n: int = 3) -> DataFrame:
    """The first n rows of each category (T2); Spark prunes each task's rows to n per category before the shuffle."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(row_id))).where(F.col("__k") <= n).drop("__k")


def review_summary(df: DataFrame, row_id: str, value: str, n: int = 3, status: str = "status", reason: str = "reason") -> DataFrame:
    """Per status its count, its conflicts and n shortened examples."""
    from ..functions.scalars import contains_ci, ellipsize

    counts = df.groupBy(status).agg(F.count("*").alias("n"), F.count_if(contains_ci(F.col(reason), "conflict")).alias("n_conflicts"))
    shown = examples(df, status, row_id, n).groupBy(status).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row_id, ellipsize(F.coalesce(value, F.lit("?"))).alias("v")))), lambda x: x["v"]), " / ").alias("examples"))
    return counts.join(shown, status)


def score_distribution(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Range, mean, population deviation and counts below 0.3, up to 0.7, above."""
    s = F.col(score)
    return df.groupBy(*by).agg(
        F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.count_if(s < 0.3).alias("n_low"), F.count_if((s >= 0.3) & (s <= 0.7)).alias("n_middle"), F.count_if(s > 0.7).alias("n_high")
    )


def failure_rates(df: DataFrame, failed: Column, by: Sequence[str], alert: float = 0.05) -> DataFrame:
    """Failure rate per group and whether it calls for attention."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(failed.cast("int")).alias("rate")).withColumn("alert", F.col("rate") > alert)


def select_best(df: DataFrame, metric: str, trial: str, by: Sequence[str] = ()) -> DataFrame:
    """The row of the highest metric; the first trial wins ties."""
    rest = F.struct(*[c for c in df.columns if c not in by])
    best = df.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.min_by(rest, F.struct(-F.col(metric), F.col(trial))).alias("r"))
    return best.select(*by, "r.*")


def fill_features(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nulls and NaNs become 0; and the counts of cells and rows that had any."""
    bad = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns}
    cells = sum((F.count_if(b) for b in bad.values()), F.lit(0).cast("long"))
    stats = df.agg(cells.alias("n_cells"), F.count_if(F.exists(F.array(*bad.values()), lambda x: x)).alias("n_rows"))
    return df.withColumns({c: F.when(b, 0).otherwise(F.col(c)) for c, b in bad.items()}), stats


def binary_violations(df: DataFrame, label: str) -> DataFrame:
    """``n, n_null, n_other, n_classes, ok`` of a label that must be 0 or 1."""
    c = F.col(label)
    out = df.agg(F.count("*").alias("n"), F.count_if(c.isNull()).alias("n_null"), F.count_if(c.isNotNull() & ~c.isin(0, 1)).alias("n_other"), F.count_distinct(c).alias("n_classes"))
    return out.withColumn("ok", (F.col("n") > 0) & (F.col("n_null") == 0) & (F.col("n_other") == 0))


def validate_binary(df: DataFrame, label: str) -> None:
    found = binary_violations(df, label).first()
    if not found.ok:
        raise ValueError(f"{label} is not binary: {found.n} rows, {found.n_null} null, {found.n_other} other")


def check_range(df: DataFrame, column: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """``lo, hi, n_outside`` of scores that must lie in a range; nulls and NaNs are outside."""
    c = F.col(column)
    inside = F.coalesce(c.between(lo, hi) & ~F.isnan(c), F.lit(False))
    return df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_if(~inside).alias("n_outside"))


def drop_unlabelled(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a label, and how many had none."""
    return df.where(F.col(label).isNotNull()), df.agg(F.count_if(F.col(label).isNull()).alias("n_dropped"))


def reorder(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first, then the rest (P5)."""
    return df.select([c for c in preferred if c in df.columns] + [c for c in df.columns if c not in preferred])


def export_pairs(df: DataFrame, value: str, label: str) -> DataFrame:
    """Value and label of rows with a label."""
    return df.where(F.col(label).isNotNull()).select(value, label)


def tag(df: DataFrame, **values) -> DataFrame:
    """Constant columns that say where rows come from."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(order).limit(n)


#: Bytes of values that a part of ``length_bucketed`` holds.
PART_BYTES = 64 << 20


def length_bucketed(df: DataFrame, value: str, parts: int, most: int = PART_BYTES) -> DataFrame:
    """Rows dealt and sorted by length, so that batches have rows of like length (T4).

    At least ``parts`` parts, and as many as keep each at about ``most`` bytes, however long its texts and however many are of one
    length: each length has its stretch of all bytes in the order of lengths, and its rows lie there by their hash. Distinct lengths are few,
    at most the square root of twice the characters, so they are summed up in order and broadcast.
    """
    rows = df.withColumn("__n", F.coalesce(F.length(value), F.lit(-1)))
    weight = F.coalesce(F.octet_length(value), F.lit(0)) + 16
    before = Window.orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    lengths = rows.groupBy("__n").agg(F.sum(weight).alias("__own"))
    placed = cut(lengths.withColumn("__before", F.coalesce(F.sum("__own").over(before), F.lit(0))))
    total = placed.agg(F.sum("__own").alias("n")).first().n or 1
    parts = max(parts, -(-total // most))
    own = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not any(x in kind for x in ("map<", "variant"))]), F.lit(1 << 20)) / (1 << 20)  # maps have no hash
    place = F.least(F.floor((F.col("__before") + own * F.col("__own")) * parts / total), F.lit(parts - 1)).cast("int")
    dealt = rows.join(F.broadcast(placed), "__n").withColumn("__part", place)
    return dealt.repartitionById(parts, "__part").sortWithinPartitions("__n").select(*df.columns)


def excess_snapshots(df: DataFrame, by: str, ts: str, keep: int, tie: str) -> DataFrame:
    """All but the newest ``keep`` of each dataset; none if ``keep`` is 0 or less (T5). ``tie`` tells rows of a
    dataset apart. Tasks pass on their newest ``keep`` only, and the others are what is not among those of all."""
    if keep <= 0:
        return df.limit(0)
    newest = Window.partitionBy(by).orderBy(F.desc(ts), F.desc(tie))
    kept = df.select(by, ts, tie).withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= keep).select(F.col(by).alias("__by"), F.col(tie).alias("__tie"))
    return df.join(kept, F.col(by).eqNullSafe(F.col("__by")) & F.col(tie).eqNullSafe(F.col("__tie")), "left_anti")


def latest(df: DataFrame, by: str, version: str) -> DataFrame:
    """The row of the highest version of each dataset."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), version).alias("r")).select(by, "r.*")


def benchmark_report(metrics: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """One line per dataset, in order: its metrics to three places, n/a where undefined."""
    shown = [F.concat(F.lit(f"{c}="), F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("n/a"))) for c in columns]
    return metrics.select(by, F.concat_ws(" ", F.col(by), *shown).alias("line")).orderBy(by)


#: Bits of a sketch of distinct values (its error is about 1.04 / 2^(bits / 2)) and the size of one of quantiles.
DISTINCT_BITS, QUANTILE_K = 12, 200


def profile_sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n, n_null, lo, hi, distinct, quantiles`` of an increment's numbers (A4, A5, A14): counts, ends, and sketches of
    distinct values and quantiles, some KB a column however many rows. To be stored; ``merge_profiles`` adds them up."""
    x = F.col("v")
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    return df.select(named.alias("x")).select("x.*").groupBy("column").agg(
        F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.hll_sketch_agg(F.xxhash64(x), DISTINCT_BITS).alias("distinct"), F.kll_sketch_agg_double(x, QUANTILE_K).alias("quantiles"),
    )


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of all increments' rows together, from their profiles alone; in any order."""
    whole = profiles[0]
    for p in profiles[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def read_profile(profile: DataFrame, at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``column, n, n_null, lo, hi, n_distinct`` and a column ``q<percent>`` for each quantile, of a profile. Null and NaN
    count as one value each among the distinct, as they are hashed alike."""
    quantiles = [F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q))).alias(f"q{round(100 * q)}") for q in at]
    return profile.select("column", "n", "n_null", "lo", "hi", F.hll_sketch_estimate("distinct").alias("n_distinct"), *quantiles)
