"""Versions, hashes, promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut
from ..sources.snapshots import update
from .profiling import latest


#: Ids of a bitmap, as Spark's have them.
IDS = 1 << 15
#: The columns of a lineage.
LINEAGE = "dataset string, version int, parent_version int, type string, model_hash string, held_out_auc double, promoted boolean, ts timestamp"


def table_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``n, content_hash``, the same for any order of the rows."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("content_hash"))


def ordered_hash(df: DataFrame, value: Column, order: str, chunk: int = 4096) -> DataFrame:
    """``order_hash``: a hash of row hashes in order (R1), by chunks of the order, chunks of those, and so on, so no
    task gets more than ``chunk`` hashes of a level. ``order``: whole numbers from 0 on, nearly dense."""
    join = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["h"]), ","), 256)
    level = df.select(F.struct(F.col(order).alias("o"), F.sha2(value, 256).alias("h")).alias("r"))
    most = df.agg(F.max(order).alias("n")).first().n or 0
    while True:
        level = level.groupBy(F.floor(F.col("r.o") / chunk).alias("c")).agg(join().alias("h")).select(F.struct(F.col("c").alias("o"), "h").alias("r"))
        most //= chunk
        if most < chunk:
            return level.agg(join().alias("order_hash"))


def append_version(lineage: DataFrame, dataset: str, kind: str, model_hash: str, metric: float | None, promoted: bool, ts: Column) -> DataFrame:
    """The row that follows a dataset's latest version, with its parent (R3); to be appended."""
    rows = lineage.where(F.col("dataset") == dataset)
    parent = rows.agg(F.max("version").alias("p"))
    return parent.select(
        F.lit(dataset).alias("dataset"),
        F.coalesce(F.col("p") + 1, F.lit(0)).cast("int").alias("version"),
        F.col("p").cast("int").alias("parent_version"),
        F.lit(kind).alias("type"),
        F.lit(model_hash).alias("model_hash"),
        F.lit(metric).cast("double").alias("held_out_auc"),
        F.lit(promoted).alias("promoted"),
        ts.alias("ts"),
    )


def latest_version(lineage: DataFrame) -> DataFrame:
    """Each dataset's highest version."""
    return latest(lineage, "dataset", "version")


def verify_parent(lineage: DataFrame, files: DataFrame) -> DataFrame:
    """``dataset, version, ok``: whether the latest model is still the one recorded (R4). ``files``: dataset, file_hash."""
    now = latest_version(lineage).join(files, "dataset", "left")
    return now.select("dataset", "version", F.coalesce(F.col("model_hash") == F.col("file_hash"), F.lit(False)).alias("ok"))


def rebuild_guard(lineage: DataFrame, confirmed: bool = False) -> DataFrame:
    """``dataset, n_later, may_rebuild``: no rebuild over later rounds unless confirmed."""
    counts = lineage.groupBy("dataset").agg(F.count_if(F.col("type") == "incremental").alias("n_later"))
    return counts.withColumn("may_rebuild", (F.col("n_later") == 0) | F.lit(confirmed))


def commit_version(spark: SparkSession, path: str, dataset: str, kind: str, model_hash: str, metric: float | None, promoted: bool, ts: Column) -> int:
    """Add a round to the lineage kept as snapshots at ``path`` (R3): its version follows the latest as of the very commit that
    adds it, so two writers never share one. Returns the commit."""
    empty = spark.createDataFrame([], LINEAGE)
    follow = lambda now: append_version(empty if now is None else now, dataset, kind, model_hash, metric, promoted, ts)
    return update(spark, path, follow, "append", keep=True)


def archive_rounds(spark: SparkSession, path: str, dataset: str, confirmed: bool = False) -> int:
    """Take a dataset's rounds out of the lineage at ``path`` before it is built anew (R5); the commit before still has them.

    Later rounds would be orphaned, so with such ones it must be confirmed. Returns the commit that archives."""

    def rest(now: DataFrame | None) -> DataFrame:
        if now is None:
            raise FileNotFoundError(f"{path} has no lineage")
        guard = rebuild_guard(now.where(F.col("dataset") == dataset), confirmed).first()
        if guard is not None and not guard.may_rebuild:
            raise ValueError(f"{dataset} has {guard.n_later} later rounds; archiving them must be confirmed")
        return now.where(~F.col("dataset").eqNullSafe(dataset))

    return update(spark, path, rest, "archive", archived=dataset)


def compatibility(previous: DataFrame, current: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """``on, reasons, ok``: what differs and forbids a warm start (R6). No previous run is a reason."""
    p, c = previous.select(on, *[F.col(x).alias(f"p_{x}") for x in columns], F.lit(True).alias("p_any")), current
    differs = lambda x: F.when(~F.col(f"p_{x}").eqNullSafe(F.col(x)), F.format_string(f"{x}: %s, now %s", F.coalesce(F.col(f"p_{x}").cast("string"), F.lit("none")), F.coalesce(F.col(x).cast("string"), F.lit("none"))))
    reasons = F.when(F.col("p_any").isNull(), F.array(F.lit("no previous run"))).otherwise(F.array_compact(F.array(*map(differs, columns))))
    return c.join(p, on, "left").select(on, F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("ok"))


def ancestry(lineage: DataFrame, rounds: int = 64) -> DataFrame:
    """``dataset, version, ancestor, depth`` of every version back to 0.

    Pointers double each round: ancestors known up to depth d give those up to 2d, so n generations
    take log2(n) joins. ``rounds`` bounds a cycle.
    """
    link = lineage.where("parent_version is not null").select("dataset", "version", F.col("parent_version").alias("ancestor"), F.lit(1).alias("depth"))
    known, reach = link, 1
    while reach < 1 << min(rounds, 30):
        a, b = known.alias("a"), known.alias("b")
        far = a.join(b, (F.col("a.dataset") == F.col("b.dataset")) & (F.col("a.ancestor") == F.col("b.version"))).where(F.col("a.depth") == reach)
        new = cut(far.select("a.dataset", "a.version", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth")))
        if new.isEmpty():
            break
        known, reach = cut(known.union(new)), 2 * reach
    return known


def promote(metrics: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Adds ``delta`` and ``decision``: promoted if the candidate is no worse than ``tolerance``.

    ``metrics``: dataset, candidate_auc, baseline_auc, both on rows that neither has trained on. An
    undefined one is no ground for promotion."""
    delta = F.col("candidate_auc") - F.col("baseline_auc")
    return metrics.withColumn("delta", delta).withColumn("decision", F.when(F.coalesce(delta >= -tolerance, F.lit(False)), "promoted").otherwise("rejected"))


def membership(trained: DataFrame, row_id: str) -> DataFrame:
    """``dataset, version, bucket, bits``: which ids each version was trained on (N8), as bitmaps of 32,768 ids each.

    ``trained``: dataset, version, ``row_id`` (whole numbers). Equal ids count once. A bucket's bitmap is some 4 KB however
    many rows repeat its ids."""
    at = F.col(row_id).cast("long")
    place = trained.where(at.isNotNull()).select("dataset", "version", F.floor(at / IDS).alias("bucket"), F.pmod(at, F.lit(IDS)).alias("bit"))
    return place.groupBy("dataset", "version", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def seen_by(members: DataFrame, lineage: DataFrame, heads: DataFrame) -> DataFrame:
    """``dataset, bucket, bits``: all that ``heads`` (dataset, version) or any of their ancestors were trained on."""
    back = ancestry(lineage).join(heads, ["dataset", "version"]).select("dataset", F.col("ancestor").alias("version"))
    whole = back.union(heads.select("dataset", F.col("version"))).distinct()
    return members.join(whole, ["dataset", "version"]).groupBy("dataset", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def fair_holdout(holdout: DataFrame, row_id: str, seen: DataFrame) -> DataFrame:
    """Rows of a hold-out that the models of its dataset have never trained on (N8). ``holdout``: dataset, ``row_id`` and more;
    ``seen``: as of ``seen_by``. A join by bucket and a look at one bit; a row without an id can't be shown to be fair."""
    at = F.col(row_id).cast("long")
    rows = holdout.where(at.isNotNull()).withColumns({"__bucket": F.floor(at / IDS), "__bit": F.pmod(at, F.lit(IDS))})
    told = seen.select(F.col("dataset").alias("__dataset"), F.col("bucket").alias("__b"), "bits")
    met = rows.join(told, rows["dataset"].eqNullSafe(F.col("__dataset")) & (F.col("__bucket") == F.col("__b")), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("__bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    taken = F.call_function("getbit", byte, (F.col("__bit") % 8).cast("int")) == 1
    return met.where(~F.coalesce(taken, F.lit(False))).select(*holdout.columns)


def require_fair(holdout: DataFrame, row_id: str, seen: DataFrame) -> DataFrame:
    """The hold-out itself, or an error if a model has trained on any of its rows."""
    n, fair = holdout.count(), fair_holdout(holdout, row_id, seen).count()
    if fair < n:
        raise ValueError(f"{n - fair} of {n} rows of the hold-out were trained on")
    return holdout
