"""Byte-level BPE encoding and decoding by a global shuffle of distinct words."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .pretokens import SLICE, boundaries, slices, words_of


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str):
    """tiktoken's encoder of single words by the ranks in ``path``."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})


def encode_words(words: list[bytes], path: str) -> list[list[int]]:
    """Each word's ids."""
    enc = encoding(path)
    return [enc._encode_single_piece(w) for w in words]


#: Bytes of text whose documents share a chunk.
CHUNK = 16 << 20
#: Buckets of words per shuffle partition, and their most.
FINE, MOST = 2, 1 << 15


def _packed(words: list[bytes], press) -> bytes:
    return press.compress(np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words))


def _planes(numbers: np.ndarray, press) -> bytes:
    return press.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(data: bytes, press) -> np.ndarray:
    return np.frombuffer(press.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def _unpacked(data: bytes, n: int, press) -> list[bytes]:
    plain = press.decompress(data)
    ends = (4 * n + np.append(0, np.cumsum(np.frombuffer(plain, "<u4", n), dtype=np.int64))).tolist()
    return [plain[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


LIST = pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])


def _chunks(size: int, buckets: int):
    """Documents to chunks, a row each: the doc_ids, the sizes in words, the distinct words by buckets of their
    hash, and at each position the number of its word among them (zstd over byte planes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, nth = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        parts: list[tuple] = []  # of the chunk in hand: doc_ids, sizes, words, codes; texts are split a slice at a time
        held = 0

        def chunk() -> pa.RecordBatch:
            words = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in distinct), np.int64, len(distinct))
            order = np.array(sorted(range(len(distinct)), key=lambda i: (bucket[i], distinct[i])), np.int64)
            local, at = words.indices.to_numpy(), np.cumsum([0] + [len(p[2]) for p in parts])
            # Frequent words have low numbers, which pack well; ``places`` has each number's place in the lists.
            seen = np.zeros(len(distinct), np.int64)
            for p, lo, hi in zip(parts, at[:-1], at[1:], strict=True):
                np.add.at(seen, local[lo:hi], np.bincount(p[3], minlength=hi - lo))
            frequent = np.argsort(-seen, kind="stable")
            rank, places = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            rank[frequent] = np.arange(len(order))
            places[rank[order]] = np.arange(len(order))
            number = rank[local]
            filled, begin = np.unique(bucket[order], return_index=True)
            lists = [(int(k), [distinct[i] for i in order[lo:hi]]) for k, lo, hi in zip(filled, begin, [*begin[1:], len(order)], strict=True)]
            codes = np.concatenate([number[lo:hi][p[3]] for p, lo, hi in zip(parts, at[:-1], at[1:], strict=True)]).astype(np.int32)
            columns = [
                pa.array([nth], pa.int64()),
                pa.array([[x for p in parts for x in p[0]]], pa.list_(pa.int64())),
                pa.array([np.concatenate([p[1] for p in parts]).astype(np.int64)], pa.list_(pa.int64())),
                pa.array([_planes(codes, press)], pa.binary()),
                pa.array([_planes(places.astype(np.int32), press)], pa.binary()),
                pa.array([[{"bucket": k, "n": len(own), "words": _packed(own, press)} for k, own in lists]], pa.list_(LIST)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "sizes", "codes", "places", "lists"])

        for batch in batches:
            for row, data, offsets in slices(batch["text"], min(size, SLICE)):
                starts = boundaries(data, offsets)
                words = words_of(data, starts) if len(starts) else pa.array([], pa.binary()).dictionary_encode()
                sizes = np.diff(np.searchsorted(starts, offsets))
                parts.append((batch["doc_id"].slice(row, len(sizes)).to_pylist(), sizes, words.dictionary, words.indices.to_numpy()))
                held += len(data)
                if held >= size:
                    yield chunk()
                    nth, parts, held = nth + 1, [], 0
        if parts:
            yield chunk()

    return run


def _encoded(path: str, width: int):
    """Lists of words in order of their buckets to ``chunk, bucket, ids``: how many ids each word has, and those. A
    bucket's words are known while its lists pass, so each is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, undo = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        last, known = None, {}
        for batch in batches:
            made = []
            for bucket, n, data in zip(*(batch[c].to_pylist() for c in ("bucket", "n", "words")), strict=True):
                if bucket != last:
                    last, known = bucket, {}
                words = _unpacked(data, n, undo)
                new = [w for w in words if w not in known]
                known.update(zip(new, encode_words(new, path), strict=True))
                ids = [known[w] for w in words]
                made.append(press.compress(np.array([len(x) for x in ids], "<u4").tobytes() + np.array([i for x in ids for i in x], f"<u{width}").tobytes()))
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["bucket"], batch["n"], pa.array(made, pa.binary())], ["chunk", "bucket", "n", "ids"])

    return run


def _together(lists: list[dict], width: int, undo) -> pa.Array:
    """The ids of a chunk's words by number, packed, from its lists in order of their buckets."""
    counts, data = [np.zeros(1, np.int64)], []
    for x in lists:
        plain = undo.decompress(x["ids"])
        counts.append(np.frombuffer(plain, "<u4", x["n"]).astype(np.int64))
        data.append(plain[4 * x["n"] :])
    ends = np.cumsum(np.concatenate(counts)) * width
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(data))])


def _gather(table: pa.Array, index: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of a binary array at ``index``, end to end, and where each begins."""
    taken = table.cast(pa.large_binary()).take(pa.array(index))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return memoryview(taken.buffers()[2] or b""), ends


@lru_cache(maxsize=2)
def token_table(path: str) -> tuple[pa.Array, pa.Array]:
    """By token id: its bytes, and its decimal digits with a comma."""
    ranks = read_ranks(path)
    spelt = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        spelt[i] = token
    return pa.array(spelt, pa.binary()), pa.array([b"%d," % i for i in range(len(spelt))], pa.binary())


def _reassembled(digest: bool, path: str, width: int):
    """Chunks with their words' ids to documents by position; ids to bytes by the token-byte table,
    which every task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, kind = zstandard.ZstdDecompressor(), f"<u{width}"
        for batch in batches:
            for i in range(len(batch)):
                doc_ids, sizes = (batch[c][i].values for c in ("doc_ids", "sizes"))
                codes, places = (_from_planes(batch[c][i].as_py(), press) for c in ("codes", "places"))
                at = np.append(0, np.cumsum(sizes.to_numpy()))
                flat, ends = _gather(_together(batch["told"][i].as_py() or [], width, press), places[codes])
                flat, ends = np.frombuffer(flat, kind), ends[at] // width
                n = pa.array(np.diff(ends))
                if not digest:
                    yield pa.RecordBatch.from_arrays([doc_ids, n, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))], ["doc_id", "n_tokens", "ids"])
                    continue
                spelt, decimal = token_table(path)
                made, back = [], []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    digits, stops = _gather(decimal, flat[a:b])
                    made.append(hashlib.sha256(digits[: max(0, stops[-1] - 1)]).hexdigest())
                    back.append(hashlib.sha256(_gather(spelt, flat[a:b])[0]).hexdigest())
                yield pa.RecordBatch.from_arrays([doc_ids, n, pa.array(made), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_bytes(spark, path: str) -> DataFrame:
    """The token-byte table, ``id, bytes``: a row per token, so its size is the vocabulary's."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in sorted(read_ranks(path).items(), key=lambda x: x[1])], "id int, bytes binary")


def _spelt(sequences: DataFrame, key: str, tokens: DataFrame) -> DataFrame:
    """``key, bytes`` of ``sequences(key, ids)``, each key once: its tokens' bytes, joined from the table, in order."""
    each = sequences.select(key, F.posexplode("ids").alias("place", "id"))
    met = each.join(F.broadcast(tokens), "id", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "bytes"))).alias("t"))
    empty = F.lit(b"").cast("binary")
    return met.select(key, F.aggregate("t", empty, lambda acc, t: F.concat(acc, t["bytes"])).alias("bytes"))


def encode_documents(docs: DataFrame, path: str, digest: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Encode every text of ``docs(doc_id, text)``: ``doc_id, n_tokens, ids``, or with ``digest`` what op2 returns.

    ``path``: a tiktoken rank file, on every node. Texts are split once into words by the tokenizers'
    public pattern. A chunk of neighbouring documents (``chunk`` bytes, or one longer text) is a row: its
    distinct words, packed by buckets of their hash, and at every position a word's number. The chunks'
    lists are exploded and dealt out by bucket, so all of a word's lists (one per chunk at most) meet and
    it is encoded once; ids go back to the chunks, which put their documents together by position.
    Bytes are looked up in the token-byte table where that is done.

    What is held whole is a chunk's words, which its bytes bound, and a bucket's distinct words. Rows are told apart by chunk
    and place, never by doc_id. Null or empty texts have no ids; equal, shared and null doc_ids come
    back as often as they came. Very long words and texts are encoded whole. An empty table gives no
    rows. Other columns are ignored.
    """
    width = 2 if max(read_ranks(path).values()) < 1 << 16 else 4
    buckets = min(MOST, FINE * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = "chunk long, doc_ids array<long>, sizes array<long>, codes binary, places binary, lists array<struct<bucket:int,n:int,words:binary>>"
    chunks = materialize(docs.select("doc_id", "text").mapInArrow(_chunks(chunk, buckets), kinds), "chunks", by="chunk")
    lists = chunks.select("chunk", F.explode("lists").alias("x")).select("chunk", "x.*").repartition("bucket").sortWithinPartitions("bucket")
    encoded = lists.mapInArrow(_encoded(path, width), "chunk long, bucket int, n int, ids binary")
    told = encoded.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "ids"))).alias("told"))
    whole = chunks.drop("lists").join(told, "chunk", "left")
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    return whole.mapInArrow(_reassembled(digest, path, width), schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The inverse: ``doc_id, ids`` to ``doc_id, bytes``, by a join with the token-byte table.

    Each distinct sequence of ids is decoded once. Null and empty ids give no bytes; an id outside the
    vocabulary makes its row's bytes null. Rows with equal doc_id have each their row.
    """
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    rows = rows.withColumn("key", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256))
    distinct = rows.groupBy("key").agg(F.first("ids").alias("ids")).where(F.size("ids") > 0)
    spelt = _spelt(distinct, "key", token_bytes(encoded.sparkSession, path))
    bare = F.when(F.size("ids") == 0, F.lit(b"").cast("binary")).otherwise(F.col("bytes"))
    return rows.join(spelt, "key", "left").select("doc_id", bare.alias("bytes"))
