"""Two batch behaviours as incremental streams (extensions x1 and x2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import embed_pending


def accept_increments(stream: DataFrame, path: str, checkpoint: str, row_id: str, ts: str, delay: str = "10 minutes") -> StreamingQuery:
    """Appends labelled rows as they come, each row_id once within the watermark (x2). Ends when all that
    has arrived is written; the state kept is that of ``delay``."""
    once = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([row_id])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def keep_vectors(stream: DataFrame, key: str, store_path: str, checkpoint: str, embed: Callable, most: int = 2000) -> StreamingQuery:
    """Embeds the keys of each batch that the store lacks and appends them (x1). A batch that is run
    again finds its keys stored and adds nothing."""

    def update(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        schema = "key string, vector array<float>, status string, reason string"
        known = spark.read.schema(schema).parquet(store_path) if _exists(spark, store_path) else spark.createDataFrame([], schema)
        done = known.where("status <> 'retry'")
        embed_pending(batch, key, done.where("status = 'ok'"), done.where("status = 'skip_permanent'"), embed, most).write.mode("append").parquet(store_path)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
