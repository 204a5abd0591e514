"""Sharding as vector bin packing of bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count

#: Bundles into which small groups are hashed; a bundle is packed as one.
BUNDLES = 1536
#: A group that makes up more than this share of a shard in bytes, words or rows is packed by itself. At most
#: 3 * shards / LARGE groups can be that large.
LARGE = 1 / 32
#: A group that exceeds a shard is torn into pieces of about this share of one.
PIECE = 1 / 8
#: Rows of an item that one task numbers, about.
NUMBERED = 1_000_000
#: What a deviation in bytes, words and rows counts, as bytes have to be near equal by the law.
WEIGHTS = np.array([2.0, 1.0, 1.0])


def shares(items: np.ndarray, shards: int) -> np.ndarray:
    """Amounts (a row of non-negative numbers per item) as shares of a shard's fair part in each dimension."""
    total = items.sum(axis=0)
    return items * shards / np.where(total > 0, total, 1)


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item.

    Large items go first; each goes where the dot product of its shares with the shard's residual
    capacity is highest (ties: the lowest shard).
    """
    share = shares(items, shards)
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), dtype=int)
    for i in sorted(range(len(items)), key=lambda i: (-share[i].max(), i)):
        out[i] = int(np.argmax(np.round(left @ share[i], 12)))
        left[out[i]] -= share[i]
    return out


def even_out(items: np.ndarray, out: np.ndarray, shards: int, rounds: int = 600, enough: float = 1e-3) -> np.ndarray:
    """Move or swap items as long as that brings loads nearer to the fair part, in all dimensions at once.

    From the shard that is farthest off (by the weighted sum of squares) the best move or swap with any
    other shard is made; if it has none, the next is tried.
    """
    share, out = shares(items, shards), out.copy()
    if not len(items):
        return out
    off = -np.ones((shards, items.shape[1]))
    np.add.at(off, out, share)
    for _ in range(rounds):
        if np.abs(off).max() < enough:
            break
        for p in np.argsort(-(off * off) @ WEIGHTS, kind="stable"):
            mine, best = np.append(np.flatnonzero(out == p), -1), (1e-12, None)
            for q in range(shards):
                if q == p:
                    continue
                yours = np.append(np.flatnonzero(out == q), -1)
                a, b = (np.where(k[:, None] >= 0, share[k], 0) for k in (mine, yours))
                moved = a[:, None, :] - b[None, :, :]
                gain = 2 * ((moved * (off[p] - off[q] - moved)) @ WEIGHTS)
                i, j = np.unravel_index(gain.argmax(), gain.shape)
                if gain[i, j] > best[0]:
                    best = gain[i, j], (q, mine[i], yours[j], moved[i, j])
            if best[1]:
                q, i, j, moved = best[1]
                off[p] -= moved
                off[q] += moved
                for k, to in ((i, q), (j, p)):
                    if k >= 0:
                        out[k] = to
                break
        else:
            break
    return out


def shard_documents(docs: DataFrame, shards: int = 24, bundles: int = BUNDLES) -> DataFrame:
    """Deal ``docs(doc_id, text)`` into shards: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, n_words``.

    Rows with equal texts form a group and share a shard, unless the group exceeds a shard in bytes,
    words or rows: then it is torn into pieces by row, whatever the rows' doc_ids. Groups of over
    ``LARGE`` of a shard and pieces are packed one by one, the others as bundles into which they are
    hashed; all by ``pack``, then evened out. So the driver sees sums of ``bundles`` bundles, of at most
    3 * shards / LARGE groups and of their pieces, whatever the input's size. ``slot`` numbers a
    shard's rows from 0 without gaps, in parts that tasks share. Law: ``bytes`` (near equal sizes; words
    and rows are balanced with them). A size is the text's UTF-8 bytes plus 8.

    Null text: no bytes, checksum 0, grouped with empty texts. Null and repeated doc_ids and rows equal in
    all columns get slots of their own. Fewer groups than shards leave shards empty. An empty table
    gives no rows. Other columns are ignored. The texts are read once.
    """
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            word_count(F.col("text")).alias("n_words"),
            F.xxhash64(text).alias("group"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    sums = [F.sum("size").alias("size"), F.sum("n_words").alias("n_words"), F.count("*").alias("n")]
    total = rows.agg(*sums).first()
    part = [F.col(c) * (shards / max(1, total[c] or 0)) for c in ("size", "n_words", "n")]
    large = rows.groupBy("group").agg(*sums).withColumn("part", F.greatest(*part)).where(F.col("part") > LARGE)
    large = large.select("group", "part").orderBy("group").limit(int(3 * shards / LARGE) + 1).collect()
    pieces = [int(np.ceil(r.part / PIECE)) if r.part > 1 else 1 for r in large]
    begins = np.append(0, np.cumsum(pieces)) + bundles
    alone = spark.createDataFrame([(r.group, int(b), k) for r, b, k in zip(large, begins, pieces, strict=False)], "group long, begin int, pieces int")
    item = F.coalesce(F.col("begin") + F.pmod(F.xxhash64("row"), "pieces"), F.pmod(F.xxhash64("group"), F.lit(bundles))).cast("int")
    most = max(total.n * max((r.part / shards for r in large), default=0), total.n / bundles)
    parts = max(16, int(most / NUMBERED))
    placed = rows.join(F.broadcast(alone), "group", "left").select(
        "doc_id", "size", "text_crc32", "n_words", "row", item.alias("item"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    )
    placed = materialize(placed, "items")
    counts = placed.groupBy("item", "part").agg(*sums)
    found = counts.groupBy("item").agg(F.sum("size"), F.sum("n_words"), F.sum("n")).orderBy("item").collect()
    amounts = np.array([r[1:] for r in found], dtype=float).reshape(len(found), 3)
    where = even_out(amounts, pack(amounts, shards), shards)
    to = F.broadcast(spark.createDataFrame([(r.item, int(k)) for r, k in zip(found, where, strict=True)], "item int, shard int"))
    before = Window.partitionBy("shard").orderBy("item", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(to, "item").select("item", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("item", "part").orderBy("doc_id", "row")) - 1
    numbered = placed.withColumn("nth", nth).join(starts, ["item", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_words"
    )
