"""Document fingerprints by a homomorphic multiset hash."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a fingerprint that tell texts apart: sums of uniform 16-bit words hashed from whole paragraphs.
WORDS = 32
#: Lanes that tell how near texts are: sums of +1 and -1 hashed from the paragraphs' pieces.
LANES = 128
#: A paragraph is a line; its pieces are stretches of so many characters within sentences.
PIECE = re.compile(r"[^.!?]{1,48}[.!?]*|[.!?]+")


def paragraphs(text: str) -> list[str]:
    return [p for x in text.split("\n") if (p := x.strip())]


def pieces(paragraph: str) -> set[str]:
    """The distinct pieces of a paragraph."""
    return {p for x in PIECE.findall(paragraph) if (p := x.strip())}


def vectors(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text as WORDS + LANES integers of 16 bits.

    A paragraph has a vector: WORDS uniform words by its hash, and in each lane the sum of +1 or -1 by
    the bits of its pieces' hashes. A text's is the sum over the multiset of its paragraphs, modulo 2
    to the 16th: their order doesn't count, and one is inserted or deleted by adding or subtracting
    its vector. Equal multisets have equal sums; different ones agree in all words by a chance of
    2 to the -512. A difference in the lanes is that of the differing pieces alone, and its mean square
    estimates the sum of squares of their counts.
    """
    lines = [paragraphs(t) for t in texts]
    parts = [[p for x in ps for p in pieces(x)] for ps in lines]
    out = np.zeros((len(texts), WORDS + LANES), np.int64)
    for own, columns, digests in (
        (lines, slice(0, WORDS), lambda x: np.frombuffer(b"".join(hashlib.blake2b(p.encode(), digest_size=2 * WORDS).digest() for p in x), "<u2").reshape(-1, WORDS)),
        (parts, slice(WORDS, None), _signs),
    ):
        counts = np.array([len(x) for x in own], np.int64)
        if counts.sum():
            some = counts > 0
            begins = (np.cumsum(counts) - counts)[some]
            out[some, columns] = np.add.reduceat(digests([p for x in own for p in x]), begins, axis=0, dtype=np.int64)
    lanes = out[:, WORDS:]
    lanes *= 2
    lanes -= np.array([len(x) for x in parts], np.int64)[:, None]
    return _wrapped(out)


def _signs(found: list[str]) -> np.ndarray:
    """The hash bits of each piece, a lane each."""
    digests = b"".join([hashlib.blake2b(p.encode(), digest_size=LANES // 8).digest() for p in found])
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, LANES // 8), axis=1)


def _wrapped(v: np.ndarray) -> np.ndarray:
    return (v + 0x8000) % 0x10000 - 0x8000


def added(fingerprint: np.ndarray, texts: list[str], sign: int = 1) -> np.ndarray:
    """``fingerprint`` after inserting (or with sign -1 deleting) the paragraphs ``texts``."""
    return _wrapped(fingerprint + sign * vectors(texts).sum(axis=0))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How near texts are, from fingerprints (rows): 0 to 1, equal ones 1.

    Estimates 1 - |x - y|^2 / (|x|^2 + |y|^2), x and y being the counts of the texts' pieces; without
    repeats that is twice the shared pieces over all of both. The standard error is about 0.09. A piece
    that k paragraphs repeat weighs as k squared.
    """
    u, v = a[:, WORDS:], b[:, WORDS:]
    size = (u * u).sum(axis=1) + (v * v).sum(axis=1)
    apart = (_wrapped(u - v) ** 2).sum(axis=1)
    return np.where((a == b).all(axis=1), 1.0, np.clip(1 - apart / np.where(size > 0, size, 1), 0.0, 1.0))


def written(v: np.ndarray) -> list[str]:
    return [r.astype(">i2").tobytes().hex() for r in v]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, order, guard): each that isn't a guard, with its fingerprints and its successor's."""
    rows, prints = [], np.zeros((0, WORDS + LANES), np.int64)
    for whole in batches:
        for lo in range(0, len(whole), 1000):
            batch = whole.slice(lo, 1000).to_pydict()
            texts = batch["text"]
            rows = rows + list(zip(batch["bucket"], batch["guard"], batch["doc_id"], texts, strict=True))
            prints = np.concatenate([prints, vectors(texts)])
            at = [i for i in range(len(rows) - 1) if not rows[i][1]]
            edited = []
            for i in at:
                text, then = rows[i][3], rows[i + 1][3]
                k = len(text) // 4
                edited.append(text[: len(text) - k] + then[:k])
            mine, after = prints[at], prints[[i + 1 for i in at]]
            new = vectors(edited)
            columns = [
                pa.array([rows[i][2] for i in at], pa.int64()),
                pa.array([len(rows[i][3]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(written(mine), pa.string()),
                pa.array(written(new), pa.string()),
                pa.array(likeness(mine, new)),
                pa.array(likeness(mine, after)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            rows, prints = rows[-1:], prints[-1:]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edited text.

    The edited text has its last quarter of code points replaced by the first as many of the next
    document in order of doc_id (after the last: the first). Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The order is made without a global sort in one task: quantiles of doc_id cut it into buckets; a doc_id
    so frequent that several quantiles fall on it gets as many buckets, by a hash of the text. Each
    bucket's first document also goes, as a guard, to the end of the bucket before. One shuffle of
    the texts by bucket, then each task reads its sorted rows with one row in hand.

    Null texts are empty. Null doc_ids come first; equal doc_ids are in some fixed order of their texts, and
    each row has its row. Texts without paragraphs have the zero fingerprint and are alike (1). A single
    document is its own next. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"))
    cuts = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first().q or []
    hot = {v: n for v, n in Counter(cuts).items() if n > 1}
    many = F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("at")) if hot else F.lit(None)
    order = F.when(many.isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)) if hot else F.lit(0)

    def below(at: Column) -> Column:
        """How many cuts lie below: a binary search, one halving after another."""
        steps = [1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))]
        whole = F.array(*map(F.lit, cuts or [0]))
        further = lambda here, step: F.coalesce((here + step <= len(cuts)) & (F.get(whole, here + step - 1) < at), F.lit(False))
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda here, step: F.when(further(here, step), here + step).otherwise(here))

    spread = F.least(F.floor((F.col("order") / 2.0**64 + 0.5) * F.coalesce(many, F.lit(1))), F.coalesce(many, F.lit(1)) - 1).cast("int")
    placed = rows.withColumn("order", order.cast("long")).withColumn("bucket", below(F.col("at")) + (spread if hot else F.lit(0)))
    # One row per bucket: bounded by ``parts``.
    first = F.struct("at", "order")
    heads = {r.bucket: r.head for r in placed.groupBy("bucket").agg(F.min(first).alias("head")).orderBy("bucket").collect()}
    filled = list(heads)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    by_bucket = lambda known: F.get(F.array(*[F.lit(known.get(b)).cast("long") for b in range(parts + 1)]), F.col("bucket"))
    own, guard = F.struct("bucket", F.lit(False).alias("guard")), F.struct(by_bucket(before).cast("int").alias("bucket"), F.lit(True).alias("guard"))
    is_head = (F.col("at") == by_bucket({b: h["at"] for b, h in heads.items()})) & (F.col("order") == by_bucket({b: h["order"] for b, h in heads.items()}))
    homes = F.when(is_head, F.array(own, guard)).otherwise(F.array(own))
    dealt = placed.withColumn("home", F.explode(homes)).select("home.bucket", "home.guard", "at", "order", "doc_id", "text")
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "guard", "at", "order", "text").drop("at", "order")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_pairs, schema)
