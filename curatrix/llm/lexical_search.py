"""Ranked lexical search by dense blocked matrix products, exact in whole numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .pretokens import slices

#: Terms as Spark reads them: runs of ASCII letters and digits and of all that isn't ASCII. A fixed value.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: An impact is below this, by its formula.
IMPACT = 1_000_000
#: Sums of whole numbers are exact in float64 below it.
EXACT = 1 << 53


@dataclass(frozen=True)
class Settings:
    """``top`` documents an item. A product has at most ``wide`` terms, ``docs`` documents and ``items`` items. A block
    of items has about ``entries`` terms in all, counted in each item, and ``together`` items; it is sent to all tasks."""

    top: int = 10
    wide: int = 2048
    docs: int = 512
    items: int = 512
    entries: int = 2_000_000
    together: int = 4096


def _bytes() -> tuple[bytes, np.ndarray]:
    """A-Z to lower case; which bytes belong to terms: in UTF-8 all bytes of what isn't ASCII are above 127."""
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    term = np.array([c > 127 or chr(c).isalnum() for c in range(256)])
    return lower, term


LOWER, IN_TERM = _bytes()


def terms(data: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that begin at ``offsets[:-1]`` of ``data``, in order, and each one's text."""
    data = data.translate(LOWER)
    inside = IN_TERM[np.frombuffer(data, np.uint8)]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.append(False, inside), np.append(inside, False)
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    edges = np.zeros(2 * len(starts) + 1, np.int32)
    edges[:-1:2], edges[1::2], edges[-1] = starts, ends, len(data)
    whole = pa.Array.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    own = whole.take(pa.array(np.arange(0, 2 * len(starts), 2)))
    return own, np.searchsorted(offsets, starts, "right") - 1


POSTINGS = "ids array<long>, n_terms binary, doc binary, term binary, tf binary"
POSTINGS_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("n_terms", pa.binary()), ("doc", pa.binary()), ("term", pa.binary()), ("tf", pa.binary())])


def _postings(sent):
    """Slices of documents: ids, numbers of terms, and how often each has which term of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.binary())
        for batch in batches:
            for row, data, offsets in slices(batch["text"]):
                n = len(offsets) - 1
                own, doc = terms(data, offsets)
                at = pc.index_in(own, value_set=known)
                found = at.is_valid().to_numpy(zero_copy_only=False)
                key = doc[found] * np.int64(max(1, len(known))) + at.drop_null().to_numpy()
                pair, tf = np.unique(key, return_counts=True)
                packed = {
                    "ids": batch["doc_id"].slice(row, n).to_pylist(),
                    "n_terms": np.bincount(doc, minlength=n).astype("<i8").tobytes(),
                    "doc": (pair // max(1, len(known))).astype("<i4").tobytes(),
                    "term": (pair % max(1, len(known))).astype("<i4").tobytes(),
                    "tf": tf.astype("<i8").tobytes(),
                }
                yield pa.RecordBatch.from_pylist([packed], schema=POSTINGS_SCHEMA)

    return run


def _counts(n_known: int):
    """A task's documents with terms (at -2), their terms (at -1), and the documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_known, np.int64), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n_terms"], "<i8")
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
                df += np.bincount(np.frombuffer(row["term"], "<i4"), minlength=n_known)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], some).astype(np.int32)), pa.array(np.append([docs, total], df[some]))], ["at", "n"])

    return run


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Of each posting: 10^9 tf div (1000 tf + 8 m), m = 10 + 90 n N div L by its document's length ``n``."""
    size, own = np.unique(n, return_inverse=True)
    m = np.array([10 + 90 * x * docs // total for x in size.tolist()], np.int64)[own]  # Python's numbers don't overflow
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def spans(weights: np.ndarray, wide: int) -> list[tuple[int, int]]:
    """Ranges of terms whose sums of products stay exact: at most ``wide`` terms, weights times impacts below 2^53."""
    out, lo, bound = [], 0, 0
    for i, w in enumerate(weights.tolist()):
        if i > lo and (i - lo == wide or bound + w * IMPACT >= EXACT):
            out.append((lo, i))
            lo, bound = i, 0
        bound += w * IMPACT
    return out + ([(lo, len(weights))] if len(weights) > lo else [])


class Best:
    """The best documents of each item so far: score, then ascending id, null last. Ties are cut by id alone."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.least = np.zeros(n_items, np.int64)  # a lower score can't enter; an equal one may
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, first: int, ids: np.ndarray, null: np.ndarray) -> None:
        """``scores`` of documents (rows) and the items from ``first`` on."""
        least = self.least[first : first + scores.shape[1]]
        if len(scores) > self.top:
            least = np.maximum(least, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        d, q = np.nonzero((scores >= np.maximum(least, 1)[None]))
        if not len(d):
            return
        item, score, doc, none = np.append(self.item, q + first), np.append(self.score, scores[d, q]), np.append(self.doc, ids[d]), np.append(self.null, null[d])
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.top]
        full = item[place == self.top - 1]
        self.least[full] = score[order[place == self.top - 1]]
        self.item, self.score, self.doc, self.null = item[place < self.top], score[kept], doc[kept], none[kept]


def _search(sent, docs: int, total: int, s: Settings):
    """A task's best documents of each item: ``item, doc_id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, of_item = sent.value  # by term its weight; by item where its terms begin, and the terms
        n_items, cuts = len(starts) - 1, spans(weights, s.wide)
        best = Best(n_items, s.top)
        owner = np.repeat(np.arange(n_items), np.diff(starts))
        by_term = np.argsort(of_item, kind="stable")
        of_term, owner = of_item[by_term], owner[by_term]
        for batch in batches:
            for row in batch.to_pylist():
                n, doc, term, tf = (np.frombuffer(row[k], t) for k, t in (("n_terms", "<i8"), ("doc", "<i4"), ("term", "<i4"), ("tf", "<i8")))
                value = impacts(tf, n[doc], docs, total).astype(np.float64)
                ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
                null = np.array([i is None for i in row["ids"]], bool)
                some = np.unique(doc)  # documents without a term of the items score 0
                for a in range(0, len(some), s.docs):
                    rows = some[a : a + s.docs]
                    lo, hi = np.searchsorted(doc, rows[0]), np.searchsorted(doc, rows[-1], "right")
                    at = np.searchsorted(rows, doc[lo:hi])
                    for b in range(0, n_items, s.items):
                        size = min(s.items, n_items - b)
                        scores = np.zeros((len(rows), size), np.int64)
                        for u, v in cuts:
                            x, y = np.searchsorted(of_term, u), np.searchsorted(of_term, v)
                            mine = (owner[x:y] >= b) & (owner[x:y] < b + size)
                            here = (term[lo:hi] >= u) & (term[lo:hi] < v)
                            if not mine.any() or not here.any():
                                continue
                            wanted = np.zeros((v - u, size))
                            wanted[of_term[x:y][mine] - u, owner[x:y][mine] - b] = weights[of_term[x:y][mine]]
                            tile = np.zeros((len(rows), v - u))
                            tile[at[here], term[lo:hi][here] - u] = value[lo:hi][here]
                            scores += (tile @ wanted).astype(np.int64)
                        best.add(scores, b, ids[rows], null[rows])
        if len(best.item):
            found = [pa.array(best.item.astype(np.int32)), pa.array(best.doc, mask=best.null), pa.array(best.score)]
            yield pa.RecordBatch.from_arrays(found, ["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """Search for the items of one block; ``items``: item_id, term."""
    spark = docs.sparkSession
    own = items.orderBy("item_id", "term").toArrow()  # a block is bounded by its settings
    words, of_item = np.unique(np.array(own["term"].to_pylist(), object), return_inverse=True) if own.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    ids = own["item_id"].to_pylist()
    starts = np.array([i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)], np.int64)
    names = [ids[i] for i in starts[:-1]]
    known = spark.sparkContext.broadcast([w.encode() for w in words])
    postings = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_postings(known), POSTINGS), "postings")
    told = {r["at"]: int(r.n) for r in postings.mapInArrow(_counts(len(words)), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n_docs, total = told.get(-2, 0), told.get(-1, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * told.get(t, 0) + 1))) for t in range(len(words))], np.int64)
    sent = spark.sparkContext.broadcast((weights, starts, of_item.astype(np.int64)))
    near = postings.mapInArrow(_search(sent, n_docs, total, s), "item int, doc_id long, score long").withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(64)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # A task gives at most ``top`` documents an item; 64 groups an item cut these before one group sees them.
    few = near.withColumn("k", F.row_number().over(Window.partitionBy("item", "__part").orderBy(*order))).where(F.col("k") <= s.top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= s.top)
    named = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # a row per item of the block


def search(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The ``s.top`` documents of ``docs(doc_id, text)`` that fit each item of ``items(item_id, text)`` best.

    Returns ``item_id, rank, doc_id, score``. Items are a set of queries: they are dealt into blocks by a hash, each of which is
    sent to all tasks and costs a pass over the texts. A pass writes, per slice of documents, how often each has which term of
    the block; tasks multiply tiles of document impacts and item weights in float64, in ranges of terms whose sums
    stay below 2^53, add them as whole numbers, and keep the best documents of each item, ties by id.

    Null and wordless texts have no terms: such documents count nowhere and such items get no rows. Rows that share an
    item_id are one item with the terms of all; a null item_id is one too. Documents that share a doc_id are ranked
    each; of equal scores a null doc_id comes last. Empty tables give no rows. Other columns are ignored.
    """
    # Only A-Z are lower-cased, in either case of the letters that lower() would also change.
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col("item_id").cast("long"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))).alias("term")).distinct()
    words = materialize(words, "items")
    n = words.agg(F.count("*").alias("entries"), F.count_distinct(F.coalesce(F.col("item_id"), F.lit(-1))).alias("items")).first()
    parts = max(1, math.ceil(n.entries / s.entries), math.ceil(n.items / s.together))
    mine = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    out = [_block(docs, words.where(mine == b), s) for b in range(parts)]
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole
