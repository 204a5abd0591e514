"""The registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import identity_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The labelled documents that most queries start from: key, pseudo-scores by seed, labels or null.
BASE = """d as (select x.doc_id, x.text, x.lang, x.source, x.n_chars, l.toxic, l.quality, sha256(trim(x.text)) as key,
  ((x.doc_id * 104729 + x.n_chars * 7919) % 10007) / 10007e0 as score from documents x left join labels l on x.doc_id = l.doc_id)"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            # A filtered count is a BIGINT, as Spark's is.
            text = sql.replace("{BASE}", BASE).replace("count_if(", "count(*) filter (")
            cut = ", ".join(f"round({c}, 6) + 0 as {c}" for c in getattr(f, "rounded", ()))
            ORACLE[f.__name__] = f"select * replace ({cut}) from ({text}) whole" if cut else text
        return f

    return register


def rounded(*columns: str):
    """Six places of these columns in both engines, whose sums may differ in the last bit."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})

        run.rounded = columns
        return run

    return wrap


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudo_score(multiplier: int = 104729):
    """A score that either engine computes alike; other multipliers stand for other seeds."""
    return ((F.col("doc_id") * multiplier + F.col("n_chars") * 7919) % 10007) / F.lit(10007.0)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with labels (null where there are none), key and pseudo-score."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").withColumns({"key": identity_key(F.col("text")), "score": pseudo_score()})
