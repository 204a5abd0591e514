"""Quality by similarity-weighted votes of labelled texts in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import examples, remainder
from .pretokens import class_table, slices

#: Kinds of characters; a text's terms are its words, folded to WORDS by a hash, the triples of kinds of
#: successive runs of characters, and facts of its form.
KINDS = ("lower", "upper", "digit", "space", "newline", ".", ",", "!?", "|", "#$%&*", "'\"", "()[]{}", "/:;@-_", "<>=+~^`\\", "white", "other")
N = len(KINDS)
FACTS, WORDS = 48, 2048
WIDTH = N**3 + FACTS + WORDS


@dataclass(frozen=True)
class Settings:
    """``most`` bounds the labelled rows that are learned from; ``rank`` is that of the latent space;
    ``near`` neighbours vote by the similarity to the power ``sharp``; ``doubt`` weighs the base rate."""

    most: int = 6144
    rank: int = 48
    near: int = 25
    sharp: int = 8
    doubt: float = 0.25
    seed: int = 5


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its kind and its lower-case form; and odd multipliers for places in a word."""
    table = np.array([0, 2, N - 1, 3, 14], np.uint8)[class_table()]  # letters, numbers, others, blank, white space
    lower = np.arange(len(table), dtype=np.uint32)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isupper():
            table[c] = 1
        if len(ch.lower()) == 1:
            lower[c] = ord(ch.lower())
    for k, name in enumerate(KINDS[5:14], 5):
        table[[ord(c) for c in name]] = k
    table[ord("\n")] = 4
    return table, lower, np.random.default_rng(3).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


_TABLE: list[tuple] = []


def _hashed_words(code: np.ndarray, kind: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word, a run of letters whatever their case: its text and its hash below WORDS."""
    _, lower, factors = _TABLE[0]
    letter = kind < 2
    begins = letter & np.append(True, ~letter[:-1] | (owner[1:] != owner[:-1]))
    at = np.flatnonzero(letter)
    if not len(at):
        return at, at
    starts = np.searchsorted(at, np.flatnonzero(begins))
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    h = np.add.reduceat(lower[code[at]].astype(np.uint64) * factors[place % 64], starts)
    h = (h ^ (h >> np.uint64(29))) * factors[0]
    return owner[at[starts]], (h >> np.uint64(53)).astype(np.int64) % WORDS


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Term weights (rows of WIDTH, log-scaled counts) of successive texts, a slice at a time."""
    if not _TABLE:
        _TABLE.append(_kinds())
    for _, data, offsets in slices(texts):
        n = len(offsets) - 1
        code = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        cuts = np.searchsorted(lead, offsets)
        kind = _TABLE[0][0][code].astype(np.int32)
        owner = np.repeat(np.arange(n), np.diff(cuts))
        out = np.zeros((n, WIDTH), np.float32)
        if len(code):
            new = np.append(True, (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1]))
            runs, own = kind[new], owner[new]
            if len(runs) > 2:
                same = own[2:] == own[:-2]
                triple = (runs[:-2] * N + runs[1:-1]) * N + runs[2:]
                whose, word = _hashed_words(code, kind, owner)
                found = np.append((own[2:] * np.int64(WIDTH) + triple)[same], whose * np.int64(WIDTH) + N**3 + FACTS + word)
                out += np.bincount(found, minlength=n * WIDTH).reshape(n, WIDTH)
            of_kind = np.bincount(owner * np.int64(N) + kind, minlength=n * N).reshape(n, N)
            words = np.bincount(own, weights=(runs == 0) | (runs == 1), minlength=n)
        else:
            of_kind, words = np.zeros((n, N)), np.zeros(n)
        out = np.log1p(out)
        size = np.maximum(np.diff(cuts), 1)
        lines = [data[a:b].split(b"\n") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
        facts = (np.minimum(np.log2(1 + words), 15), 8 * repeated, 8 * of_kind[:, 1] / size, 8 * (of_kind[:, 7:10].sum(axis=1)) / size)
        at = N**3
        for f, wide in zip(facts, (16, 9, 9, 9), strict=True):
            out[np.arange(n), at + f.astype(int)] = 2.0
            at += wide
        yield out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for part in features(batch["text"]) for r in part]
        some = [np.flatnonzero(r) for r in rows]
        at = pa.array([i.astype("<u2").tobytes() for i in some], pa.binary())
        weights = pa.array([r[i].astype("<f4").tobytes() for r, i in zip(rows, some, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], at, weights], ["doc_id", "label", "at", "weights"])


class LatentSpace:
    """TF-IDF weights and a truncated singular value decomposition of the examples."""

    def __init__(self, x: np.ndarray, s: Settings):
        seen = (x > 0).sum(axis=0)
        self.terms = np.flatnonzero(seen >= 2)
        self.idf = np.log1p(len(x) / seen[self.terms]).astype(np.float32)
        x = self.weighted(x)
        rank = min(s.rank, *x.shape)
        basis = np.random.default_rng(s.seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
        for _ in range(4):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
        self.axes = np.ascontiguousarray((basis @ v.T)[:, :rank], np.float32)

    def weighted(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.terms] * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def place(self, x: np.ndarray) -> np.ndarray:
        z = self.weighted(x) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def votes(alike: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """The mean label of each row's ``near`` highest cosines to six places (ties: the first examples), weighted by
    their power ``sharp``, with the base rate at ``doubt``."""
    n = alike.shape[1]
    k = min(s.near, n)
    places = np.rint(alike.astype(np.float64) * 1e6).astype(np.int64)
    order = places * n + np.arange(n - 1, -1, -1)  # no two are equal
    top = np.argpartition(order, n - k, axis=1)[:, n - k :]
    w = np.maximum(np.take_along_axis(places, top, axis=1) / 1e6, 0) ** s.sharp
    return ((w * y[top]).sum(axis=1) + s.doubt * float(y.mean())) / (w.sum(axis=1) + s.doubt)


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, cut: float = 0.7, s: Settings = Settings()) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text)`` by ``labels(doc_id, quality)`` outside the held-out part.

    Returns ``doc_id, held_out, score, predicted``. The labelled texts' latent vectors, at most
    ``s.most`` of them, are sent to all tasks; each task multiplies its texts' vectors with all of
    them, a block of texts at a time, and the nearest vote, weighted by similarity. One pass over the
    texts, no shuffle of them.

    Null and empty texts have only the facts of their form and score by them. Without labels to learn
    from every score is 0.5. Of neighbours equally near to six places the first examples count. Rows with equal
    doc_id have each their row. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    sample = examples(labels, "quality", modulus, held, s.most)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    known = labelled.mapInArrow(_packed, "doc_id long, label int, at binary, weights binary").toArrow().sort_by("doc_id")
    x = np.zeros((known.num_rows, WIDTH), np.float32)
    for i, (at, w) in enumerate(zip(known["at"].to_pylist(), known["weights"].to_pylist(), strict=True)):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(w, "<f4")
    y = np.array(known["label"].to_pylist(), np.float32)
    space = LatentSpace(x, s) if len(x) else None
    sent = spark.sparkContext.broadcast((space, space.place(x) if space else None, y))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, near, y = sent.value
        for batch in batches:
            out = []
            for part in features(batch["text"]) if space else ():
                for lo in range(0, len(part), 512):
                    out.append(votes(space.place(part[lo : lo + 512]) @ near.T, y, s))
            scores = np.clip(np.concatenate(out), 0, 1) if out else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
