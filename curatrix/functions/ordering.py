"""Running sums over a whole table, by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sums of whole numbers over all rows before each in ``order`` (a total order).

    Rows are dealt into ranges, summed within them, and a row per range carries what lies before; so no
    task sees more than its range, and what is broadcast is bounded by the number of ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy("__range").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    offsets = each.select("__range", *[F.coalesce(F.sum(k).over(before(Window.orderBy("__range"))), F.lit(0)).alias(f"__{k}") for k in sums])
    own = before(Window.partitionBy("__range").orderBy(*order))
    within = dealt.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(k) for k, c in sums.items()])
    met = within.join(F.broadcast(offsets), "__range")
    return met.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__range", *[f"__{k}" for k in sums])
