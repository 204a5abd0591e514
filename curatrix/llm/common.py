"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import fresh_folder, note, tidy

#: A word, wherever these operators speak of words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that separates words.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: After so many tables the driver collects its garbage, as loops of many small steps leave much behind.
TIDY = 6
_WRITTEN = itertools.count(1)


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    What later stages reread survives the loss of any executor, and a loop's plan stays short. A table that
    is bucketed ``by`` a column isn't shuffled again where it is joined on it. Who is ``collecting`` may delete it.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_") if by else None
    out = df.write.option("compression", "zstd")
    if name:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out.bucketBy(n, by).option("path", path).saveAsTable(name)
    else:
        out.parquet(path)
    note(path, name)
    if next(_WRITTEN) % TIDY == 0:
        tidy(spark)
    return spark.table(name) if name else spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: lambdas that use it don't evaluate it again per element."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
