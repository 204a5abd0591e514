"""Checks of nested point records and graphs (V1 to V5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import distance, finite
from ..functions.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 50) -> DataFrame:
    """``node, component``: the least node reachable (V2).

    Each round a node takes the least label among itself and its neighbours, then that label's own
    label, so labels travel twice as far each time. Rounds end when nothing changes; each is cut
    from its lineage by a table in the shared folder.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = both.union(both.select("v", "u")).distinct()
    both = cut(both)
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("m"))
        taken = labels.join(near, labels["node"] == near["u"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = taken.select(F.col("node").alias("j"), F.col("component").alias("jc"))
        new = cut(taken.join(jump, taken["component"] == jump["j"], "left").select("node", F.least("component", F.coalesce("jc", "component")).alias("component"), "old"))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _bond_components(n: Column, bonds: Column) -> Column:
    """Number of components of a record's small graph: labels 0 to n - 1, relaxed over the bonds n times at most."""
    start = F.sequence(F.lit(0), n - 1)

    def relax(labels: Column, _: Column) -> Column:
        return F.aggregate(
            bonds,
            labels,
            lambda acc, b: F.transform(acc, lambda x: F.when((x == F.get(acc, b["i"])) | (x == F.get(acc, b["j"])), F.least(F.get(acc, b["i"]), F.get(acc, b["j"]))).otherwise(x)),
        )

    # Merging both labels of a bond everywhere makes one pass enough.
    return F.size(F.array_distinct(relax(start, F.lit(0))))


def qc_records(df: DataFrame, row_id: str, atoms: str, points: str, radii: dict[str, float], default_radius: float = 0.77, bond: float = 1.3, clash: float = 0.9, far: float = 30.0, spread: float = 20.0) -> DataFrame:
    """Adds ``issue``, the first check that fails, or null (V1).

    Order: non-finite, length mismatch, empty, clash (not bonded, yet nearer than ``clash`` times the
    radii), exploded, disconnected, spread. A record's pairs are made inside its row: a record is
    small, and nothing is joined or shuffled.
    """
    lookup = F.create_map(*[F.lit(x) for kv in radii.items() for x in kv])
    radius = lambda i: F.coalesce(F.try_element_at(lookup, F.get(atoms, i)), F.lit(default_radius))
    n = F.size(points)
    places = F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.flatten(
        F.transform(
            places,
            lambda i: F.transform(
                F.filter(places, lambda j: j > i),
                lambda j: F.struct(i.alias("i"), j.alias("j"), distance(F.get(points, i), F.get(points, j)).alias("d"), (radius(i) + radius(j)).alias("r")),
            ),
        )
    )
    rows = df.withColumn("__pairs", pairs)
    bonds = F.filter("__pairs", lambda p: p["d"] <= bond * p["r"])
    clashes = F.exists("__pairs", lambda p: (p["d"] > bond * p["r"]) & (p["d"] < clash * p["r"]))
    centre = F.transform(F.array(*map(F.lit, range(3))), lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, k).cast("double")) / n)
    wide = F.exists(points, lambda p: distance(p, F.col("__centre")) > spread)
    all_finite = F.forall(points, lambda p: F.forall(p, lambda x: finite(x.cast("double"))))
    issue = (
        F.when(~all_finite, "non-finite")
        .when(F.size(atoms) != n, "length mismatch")
        .when(n < 1, "empty")
        .when((n > 1) & clashes, "clash")
        .when((n > 1) & F.exists("__pairs", lambda p: p["d"] > far), "exploded")
        .when((n > 1) & (_bond_components(n, bonds) > 1), "disconnected")
        .when((n > 1) & wide, "spread")
    )
    return rows.withColumn("__centre", F.when(n > 0, centre)).withColumn("issue", issue).drop("__pairs", "__centre")


def zscore_outliers(df: DataFrame, value: str, by: str, least: int = 8, limit: float = 3.0) -> DataFrame:
    """Adds ``z`` and ``is_outlier`` within each group of at least ``least`` scored rows (V3, F8)."""
    stats = df.where(finite(F.col(value))).groupBy(by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.count("*").alias("__n"))
    z = (F.col(value) - F.col("__m")) / (F.col("__s") + 1e-9)
    joined = df.join(stats, by, "left").withColumn("z", F.when((F.col("__n") >= least) & finite(F.col(value)), z))
    return joined.withColumn("is_outlier", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("__m", "__s", "__n")


def qc_summary(checked: DataFrame, row_id: str, issue: str = "issue", outlier: str | None = None, n: int = 20) -> DataFrame:
    """Counts and the first examples (V4)."""
    bad = F.col(issue).isNotNull() | (F.col(outlier) if outlier else F.lit(False))
    shown = checked.where(bad).orderBy(row_id).limit(n).agg(F.array_join(F.array_sort(F.collect_list(F.col(row_id))).cast("array<string>"), ",").alias("examples"))
    counts = checked.agg(F.count("*").alias("n_checked"), F.count_if(bad).alias("n_suspicious"), (F.count_if(outlier) if outlier else F.lit(0).cast("long")).alias("n_outliers"))
    return counts.crossJoin(shown)  # one row each


def best_variant(df: DataFrame, row_id: str, energy: str, payload: Column) -> DataFrame:
    """The variant of least energy per record, of several the least payload; ``ok`` is false where no
    variant has one (V5)."""
    best = F.min(F.when(finite(F.col(energy).cast("double")), F.struct(F.col(energy).alias("e"), payload.alias("p"))))
    out = df.groupBy(row_id).agg(best.alias("b"))
    return out.select(row_id, F.col("b.p").alias("payload"), F.col("b.e").alias("energy"), F.col("b").isNotNull().alias("ok"))

