"""Group-aware and stratified splits, resampling and tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_key(c: Column) -> Column:
    """Null or blank groups are the one group '' (G2)."""
    return F.coalesce(F.trim(c), F.lit(""))


def pack_sizes(histogram: list[tuple[int, int]], n: int, fracs: Sequence[float] = (0.8, 0.1, 0.1)) -> list[tuple[int, int, int]]:
    """Per distinct group size, large first: (size, groups to train, groups to validation); the rest is test (G1).

    Groups are placed by size, each into training if it still fits its target, else validation, else
    test. Groups of one size fill up a split one after another, so a size needs two divisions, however
    many groups have it. There are at most sqrt(2 n) distinct sizes.
    """
    left = [int(fracs[0] * n), int(fracs[1] * n)]
    out = []
    for size, count in sorted(histogram, reverse=True):
        a = min(count, left[0] // size)
        b = min(count - a, left[1] // size)
        left[0] -= a * size
        left[1] -= b * size
        out.append((size, a, b))
    return out


def group_split(df: DataFrame, group: str, fracs: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42, tie: Column | None = None, buckets: int = 256) -> DataFrame:
    """Adds ``split``; whole groups only.

    Only the histogram of group sizes comes to the driver. Groups of a size are ranked by a seeded
    digest (``tie``, of as many bits, replaces it) in buckets of it, so that the many groups of size 1 are ranked by many
    tasks. Same seed, same split; sizes per split are those of the sequential placement.
    """
    spark = df.sparkSession
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    histogram = [(r.size_, r.n) for r in sizes.groupBy(F.col("size").alias("size_")).agg(F.count("*").alias("n")).collect()]
    quota = spark.createDataFrame(pack_sizes(histogram, sum(s * n for s, n in histogram), fracs), "size long, to_train long, to_val long")
    order = digest(F.coalesce(F.col(group).cast("string"), F.lit("")), seed) if tie is None else tie
    part = F.floor(order / (1 << 60) * buckets)  # buckets must follow the order: by the high bits of the digest's 60
    ranked = sizes.withColumns({"__o": order, "__b": part}).withColumn("__k", F.row_number().over(Window.partitionBy("size", "__b").orderBy("__o", group)))
    counts = ranked.groupBy("size", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    rank = F.col("__off") + F.col("__k")
    split = F.when(rank <= F.col("to_train"), "train").when(rank <= F.col("to_train") + F.col("to_val"), "val").otherwise("test")
    homes = ranked.join(offsets, ["size", "__b"]).join(F.broadcast(quota), "size").select(F.col(group).alias("__g"), split.alias("split"))
    return df.join(homes, df[group].eqNullSafe(F.col("__g"))).drop("__g")


def group_diagnostics(df: DataFrame, group: str) -> DataFrame:
    """Number and sizes of groups; ``few`` warns of under 10."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    top = sizes.orderBy(F.desc("size")).limit(5).agg(F.array_join(F.transform(F.sort_array(F.collect_list("size"), False), lambda x: x.cast("string")), ",").alias("top5"))
    whole = sizes.agg(F.count("*").alias("n_groups"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("n_singletons"))
    return whole.crossJoin(top).select("n_groups", "largest", "top5", "n_singletons", (F.col("n_singletons") / F.col("n_groups")).alias("singleton_rate"), (F.col("n_groups") < 10).alias("few"))  # one row each


def split_diagnostics(df: DataFrame, split: str, label: str, targets: dict[str, float], tolerance: float = 0.03) -> DataFrame:
    """Per split its size, fraction and balance, and whether it is off target, small or of one class."""
    wanted = df.sparkSession.createDataFrame(list(targets.items()), f"{split} string, target double")
    counts = df.groupBy(split).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), F.count_distinct(label).alias("n_classes"))
    out = wanted.join(counts, split, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # a row per split
    return out.withColumn("fraction", share).select(
        split, "n", "n_pos", "fraction", (F.abs(F.col("fraction") - F.col("target")) > tolerance).alias("off_target"), (F.col("n") < 30).alias("small"), (F.coalesce("n_classes", F.lit(0)) < 2).alias("single_class")
    )


def _stratum_rank(df: DataFrame, label: str, order: Column, buckets: int = 64) -> DataFrame:
    """Adds ``__k``, the row's place (from 0) in its class by ``order``, and ``__n``, the class's size.

    A class is ranked in ranges of the hash, so that no task sorts a whole class.
    """
    placed = df.withColumn("__o", order).withColumn("__b", F.floor(F.pmod(F.col("__o"), F.lit(10007)) * buckets / 10007))
    counts = placed.groupBy(label, "__b").agg(F.count("*").alias("__m"))
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(label).alias("__l"), F.col("__b").alias("__c"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off"), F.sum("__m").over(Window.partitionBy(label)).alias("__n"))
    own = F.row_number().over(Window.partitionBy(label, "__b").orderBy(F.pmod(F.col("__o"), F.lit(10007)), "__o")) - 1
    joined = placed.withColumn("__r", own).join(offsets, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__c")))
    return joined.withColumn("__k", F.col("__off") + F.col("__r")).drop("__o", "__b", "__l", "__c", "__off", "__r")


def stratified_holdout(df: DataFrame, label: str, frac: float, order: Column) -> DataFrame:
    """Adds ``holdout``: the first ``frac`` of each class by ``order`` (G3). See ``holdout_guard``."""
    return _stratum_rank(df, label, order).withColumn("holdout", F.col("__k") < F.floor(F.col("__n") * frac)).drop("__k", "__n")


def holdout_guard(df: DataFrame, label: str, frac: float) -> DataFrame:
    """``enabled, reason``: why a hold-out can't be had, if so."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.count("*").alias("classes"), F.min("n").alias("least"), F.min(F.floor(F.col("n") * frac)).alias("held"))
    reason = (
        F.when(F.lit(frac <= 0), "no hold-out asked for")
        .when(F.col("classes") < 2, "single class")
        .when(F.col("least") < 2, "a class has fewer than 2 rows")
        .when(F.col("held") < 1, "a class would be missing from the hold-out")
        .otherwise("")
    )
    return whole.select((reason == "").alias("enabled"), reason.alias("reason"))


def stratified_folds(df: DataFrame, label: str, k: int, order: Column) -> DataFrame:
    """Adds ``fold`` 0 to k - 1, classes spread evenly."""
    return _stratum_rank(df, label, order).withColumn("fold", (F.col("__k") % k).cast("int")).drop("__k", "__n")


def oversample(df: DataFrame, label: str, order: Column, ratio: float = 1.0) -> DataFrame:
    """Repeats minority rows until they are ``ratio`` times the majority (G5); adds ``is_copy``.

    Every minority row is taken equally often, the first by ``order`` once more, so that copies are
    made where their rows are: no draw, no join. A class that is absent or large enough: no copies.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    ends = counts.agg(F.count("*").alias("classes"), F.min(F.struct("n", label)).alias("small"), F.max("n").alias("large")).where("classes = 2")
    plan = ends.select(F.col(f"small.{label}").alias("__small"), F.greatest(F.floor(F.col("large") * ratio) - F.col("small.n"), F.lit(0)).alias("__extra"))
    ranked = _stratum_rank(df, label, order).join(F.broadcast(plan), F.col(label) == F.col("__small"))  # one row
    times = (F.floor(F.col("__extra") / F.col("__n")) + (F.col("__k") < F.col("__extra") % F.col("__n")).cast("int")).cast("int")
    copies = ranked.withColumn("__t", times).where("__t > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), "__t")))
    return df.withColumn("is_copy", F.lit(False)).unionByName(copies.select(*df.columns, F.lit(True).alias("is_copy")))


def digest(value: Column, seed: int) -> Column:
    """60 bits of a digest of seed and value, as a whole number; any engine with MD5 has the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string"))), 1, 15), 16, 10).cast("long")


def drawn(counter: Column, seed: int, n: int) -> Column:
    """A number below ``n`` for each counter. No draw depends on another."""
    return F.pmod(digest(counter, seed), F.lit(n))


def oversample_drawn(df: DataFrame, label: str, order: Column, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """As ``oversample``, but the copies are independent draws with replacement (G5): the r-th draw takes the minority row whose
    place in ``order`` the digest of ``seed`` and r names. Equal rows and seeds draw alike. Draws are made and counted where
    their numbers are and met with rows by place, so neither is held by one task."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    ends = counts.agg(F.count("*").alias("classes"), F.min(F.struct("n", label)).alias("small"), F.max("n").alias("large")).first()
    whole = df.withColumn("is_copy", F.lit(False))
    if ends.classes != 2 or (extra := int(ends.large * ratio) - ends.small.n) <= 0:
        return whole
    draws = df.sparkSession.range(extra).groupBy(drawn(F.col("id"), seed, ends.small.n).alias("__draw")).agg(F.count("*").cast("int").alias("__times"))
    rows = _stratum_rank(df.where(F.col(label) == ends.small[label]), label, order)
    copies = rows.join(draws, F.col("__k") == F.col("__draw")).withColumn("__c", F.explode(F.sequence(F.lit(1), "__times")))
    return whole.unionByName(copies.select(*df.columns, F.lit(True).alias("is_copy")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Each class's weight, the largest class's count over its own."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.max("n").over(Window.partitionBy()) / F.col("n"))  # a row per class


def pick_tier(n: Column) -> Column:
    """The configuration tier of a training set's size (G7); the bounds are fixed values."""
    return F.when(n < 400, "tiny").when(n < 1500, "small").when(n < 5000, "medium").otherwise("large")


def training_pool(df: DataFrame, strategy: str, split: str = "split") -> DataFrame:
    """Rows to learn from: train and validation merged for cross-validation, else train alone."""
    return df.where(F.col(split).isin("train", "val") if strategy == "merged" else F.col(split) == "train")


def per_split(df: DataFrame, row_id: str, key: str, label: str, split: str = "split") -> DataFrame:
    """Policy B within each split, so that a duplicate in another split has no say."""
    from .dedup import build_model_ready

    inner = df.withColumn("__key", F.when(F.col(key).isNotNull(), F.concat_ws("\x1f", F.col(split), F.col(key))))
    return build_model_ready(inner, row_id, "__key", label)[0].drop("__key")


def require_splits(df: DataFrame, names: Sequence[str], split: str = "split") -> None:
    """An empty split is an error."""
    found = {r[0] for r in df.select(split).distinct().limit(100).collect()}
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"empty splits: {missing}")
