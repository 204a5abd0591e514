"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .labelled import examples, remainder

TERM = re.compile(r"[^\W_]+")
#: A text of this score or more counts as toxic.
TOXIC = 0.5
#: Neighbours that are told.
SHOWN = 10
#: Texts that are scored at once.
TEXTS = 128
#: Examples of a block in the index.
BLOCK = 64
#: So many of the most frequent terms stand in full.
FULL = 768


@dataclass(frozen=True)
class Settings:
    """``most``: the bound on labelled rows that are learned from; of these, texts of up to ``longest``
    characters. ``near`` neighbours vote by the square of their cosine; ``doubt`` is the weight of the
    base rate among their votes. A term's weight, beside TF-IDF, grows from ``floor`` to 1 with how surely
    it is tied to the label: 1 where, with all terms tried, one in ``1 / alpha`` samples would show one."""

    most: int = 3072
    longest: int = 200_000
    floor: float = 0.1
    alpha: float = 0.05
    near: int = 40
    doubt: float = 0.01


class BlockMaxIndex:
    """Inverted lists of unit vectors by term and block of rows, with each term's largest weight in each
    block that has it, for exact nearest neighbours. Rows that are alike should be neighbours: then bounds are tight."""

    def __init__(self, rows: list[np.ndarray], weights: list[np.ndarray], width: int):
        self.size = len(rows)
        self.blocks = max(1, -(-self.size // BLOCK))
        at = np.repeat(np.arange(self.size), [len(r) for r in rows])
        terms = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        order = np.lexsort((at, terms))
        self.rows, self.values = at[order].astype(np.int32), (np.concatenate(weights) if rows else np.zeros(0))[order]
        # Terms of many rows also stand in full, as a dense matrix: their products are taken for many texts at once.
        count = np.bincount(terms, minlength=width)
        full = np.sort(np.argsort(-count, kind="stable")[:FULL])
        self.full = np.full(width, -1, np.int64)
        self.full[full] = np.arange(len(full))
        self.matrix = np.zeros((len(full), self.size))
        there = self.full[terms[order]] >= 0
        self.matrix[self.full[terms[order][there]], self.rows[there]] = self.values[there]
        terms, order = terms[order][~there], np.arange(len(order) - there.sum())
        self.rows, self.values = self.rows[~there], self.values[~there]
        # Per term its blocks, ascending, each with where its postings begin, their number and the largest weight.
        own, self.first = np.unique(terms[order] * self.blocks + self.rows // BLOCK, return_index=True)
        self.many = np.diff(np.append(self.first, len(self.rows)))
        self.tops = np.maximum.reduceat(self.values, self.first) if len(own) else np.zeros(0)
        self.of = own % self.blocks
        self.lists = np.searchsorted(own // self.blocks, np.arange(width + 1))

    def full_parts(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Per query the part of every row's cosine that the terms of many rows make."""
        queries = np.zeros((len(vectors), len(self.matrix)))
        for i, (terms, weights) in enumerate(vectors):
            at = self.full[terms]
            queries[i, at[at >= 0]] = weights[at >= 0]
        return queries @ self.matrix

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1, part: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The k highest cosines above 0, as (cosine, row); ties go to the lower row; row ``but`` is left out.

        ``part``: the query's row of ``full_parts``. As no weight is negative, the k-th highest part is no more than
        the k-th cosine. A block's bound is its highest part and the sum of its largest other weights; blocks
        whose bound is below the k-th part can't hold one of the nearest and aren't scored.
        """
        if not self.size:
            return []
        part = self.full_parts([(terms, weights)])[0] if part is None else part.copy()
        if 0 <= but < self.size:
            part[but] = -2.0
        least = np.partition(part, self.size - k)[self.size - k] if self.size > k else 0.0
        begin = self.lists[terms]
        n = self.lists[terms + 1] - begin
        entries, query = _ranges(begin, n), np.repeat(weights, n)
        bound = np.bincount(self.of[entries], weights=self.tops[entries] * query, minlength=self.blocks)
        bound = bound + np.maximum.reduceat(part, np.arange(0, self.size, BLOCK))
        cosines = self._scores(entries, query, part, (bound > 0) & (bound >= least - 1e-9))
        hit = np.flatnonzero(cosines >= max(least, 1e-9) - 1e-9)
        near = cosines[hit].round(9)
        best = np.lexsort((hit, -near))[:k]
        return [(c, i) for c, i in zip(near[best].tolist(), hit[best].tolist(), strict=True) if c > 0]

    def _scores(self, entries: np.ndarray, query: np.ndarray, part: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Every row's cosine, of rows in ``blocks``; else 0."""
        chosen = blocks[self.of[entries]]
        entries, query = entries[chosen], query[chosen]
        at = _ranges(self.first[entries], self.many[entries])
        scores = np.bincount(self.rows[at], weights=self.values[at] * np.repeat(query, self.many[entries]), minlength=self.size)
        return scores + part * np.repeat(blocks, BLOCK)[: self.size]


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``n`` of each, end to end."""
    return np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def words(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


class Voters:
    """The labelled examples: vocabulary, weights, index, labels; and the map from votes to probabilities."""

    def __init__(self, rows: list[tuple[int, str, int]], df: dict[str, int], n: int, s: Settings):
        self.s, self.slope, self.shift = s, 1.0, 0.0
        seen = Counter(w for _, text, _ in rows for w in set(words(text)))
        positive = Counter(w for _, text, y in rows if y for w in set(words(text)))
        vocabulary = sorted(seen)
        self.place, self.spelt = {w: i for i, w in enumerate(vocabulary)}, vocabulary
        self.rate = sum(y for *_, y in rows) / len(rows) if rows else 0.0
        many = np.array([max(df.get(w, 0), seen[w]) for w in vocabulary], float)
        idf = np.log((1 + max(n, len(rows))) / np.minimum(many, max(n, len(rows)))) if vocabulary else np.zeros(0)
        self.weight = idf * self.tied(np.array([seen[w] for w in vocabulary], float), np.array([positive[w] for w in vocabulary], float))
        vectors = [self.vector(text) for _, text, _ in rows]
        heavy = [int(t[np.argmax(w * many[t])]) if len(t) else -1 for t, w in vectors]  # heavy and common: what groups share
        order = sorted(range(len(rows)), key=lambda i: (heavy[i], rows[i][2], rows[i][0]))
        order = [i for i in order if len(vectors[i][0])]
        self.index = BlockMaxIndex([vectors[i][0] for i in order], [vectors[i][1] for i in order], len(vocabulary))
        self.labels = np.array([rows[i][2] for i in order], float)
        self.ids = [rows[i][0] for i in order]
        self.row = {d: k for k, d in enumerate(self.ids)}

    def tied(self, n: np.ndarray, positive: np.ndarray) -> np.ndarray:
        """From ``floor`` to 1: how surely terms are tied to label 1. Chernoff: a share this far above the
        rate has at most the probability exp(-surprise)."""
        if not 0 < self.rate < 1:
            return np.ones(len(n))
        share = np.clip(positive / n, 1e-12, 1 - 1e-12)
        surprise = n * (share * np.log(share / self.rate) + (1 - share) * np.log((1 - share) / (1 - self.rate)))
        sure = np.where(share > self.rate, surprise, 0) / np.log(max(2, len(n)) / self.s.alpha)
        return self.s.floor + (1 - self.s.floor) * np.minimum(1, sure)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A text's terms among the vocabulary, ascending, and its unit vector."""
        place = self.place
        terms, counts = np.unique(np.array([place[w] for w in words(text) if w in place], np.int32), return_counts=True)
        w = (1 + np.log(counts)) * self.weight[terms]
        size = np.sqrt(w @ w)
        return (terms, w / size) if size > 0 else (terms[:0], w[:0])

    def votes(self, texts: list[str], but: list[int] | None = None) -> Iterator[tuple[float, list[int], list[str]]]:
        """Per text: the neighbours' mean label by squared cosine, with the base rate at ``doubt``; the nearest ones;
        and its terms that weigh most in it, up to eight."""
        vectors = [self.vector(text) for text in texts]
        for i, ((terms, w), part) in enumerate(zip(vectors, self.index.full_parts(vectors), strict=True)):
            found = self.index.nearest(terms, w, self.s.near, self.row.get(but[i], -1) if but else -1, part) if len(terms) else []
            square = np.array([c * c for c, _ in found])
            who = [i for _, i in found]
            mean = (square @ self.labels[who] + self.s.doubt * self.rate) / (square.sum() + self.s.doubt) if found else self.rate
            yield float(mean), [self.ids[i] for i in who[:SHOWN]], [self.spelt[terms[i]] for i in np.argsort(-w, kind="stable")[:8]]

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Fit the logistic map of votes to label probabilities, by Newton's steps with smoothed targets."""
        ones = labels.sum()
        if not 0 < ones < len(labels):
            return
        x = np.stack([_logit(votes), np.ones(len(votes))])
        y = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
        b = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (y - p) - 1e-3 * (b - [1, 0]))
            b += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        if b[0] > 0:
            self.slope, self.shift = float(b[0]), float(b[1])

    def probability(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(votes) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(np.asarray(p, float), 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of all texts, and of those with each word of ``vocabulary``: a partial count per task, then
    a row per word, so what comes to the driver is bounded by the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(set(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = Counter(), 0
        for batch in batches:
            rows += len(batch)
            for text in batch["text"]:
                n.update(known.value.intersection(words(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([None, *n], pa.string()), pa.array([rows, *n.values()], pa.int64())], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist(), strict=True))
    return df.pop(None, 0), df


def learn(docs: DataFrame, labels: DataFrame, modulus: int, held: int, s: Settings) -> Voters:
    """The voters from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` outside the held-out part.

    At most ``s.most`` labelled texts come to the driver as their words. Of a doc_id's several texts the
    least counts. Votes are calibrated on the examples themselves, each scored without its own vote.
    """
    sample = materialize(examples(labels, "toxic", modulus, held, s.most), "examples")
    known = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= s.longest).join(F.broadcast(sample), "doc_id")
    rows = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("doc_id").toLocalIterator()
    rows = [(r.doc_id, r.text, r.label) for r in rows]
    n, df = document_frequencies(docs, sorted({w for _, text, _ in rows for w in words(text)}))
    voters = Voters(rows, df, n, s)
    votes = []
    for lo in range(0, len(rows), TEXTS):
        some = rows[lo : lo + TEXTS]
        votes += [v for v, *_ in voters.votes([text for _, text, _ in some], [d for d, *_ in some])]
    voters.calibrate(np.array(votes), np.array([y for *_, y in rows], float))
    return voters


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, s: Settings = Settings()) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text)`` by ``labels(doc_id, toxic)`` outside the held-out part.

    Returns ``doc_id, held_out, score, predicted, neighbours, evidence``: neighbours are the ten
    nearest voting examples' doc_ids, evidence the up to eight terms that weigh most in the text's vector. A score is
    the calibrated mean label of the nearest examples, weighted by squared cosine.

    Vectors are over all words of the labelled examples, by TF-IDF with document frequencies over all
    rows, times how surely a word is tied to the label; no word is left out, so every text that shares
    a word with an example is searched. Texts are read three times: labelled ones to learn, all for
    document frequencies, all for their scores; none is shuffled but the labelled.

    Null and empty texts, texts without known words and, where no label can be learned from, all texts
    score as the base rate does. Equal texts score equal. Rows with equal doc_id have each their row. An
    empty table gives no rows. Other columns are ignored.
    """
    scored = _with_votes(docs.select("doc_id", "text"), learn(docs, labels, modulus, held, s), "doc_id long, score double, neighbours array<long>, evidence array<string>", _told)
    held_out, predicted = remainder(F.col("doc_id"), modulus) == held, (F.col("score") >= TOXIC).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "neighbours", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that don't score as toxic, all columns kept; each row by its own text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return _with_votes(docs, learn(docs, labels, modulus, held, s), kinds, lambda batch, scores, who, why: batch.filter(pa.array(scores < TOXIC)))


def _told(batch: pa.RecordBatch, scores: np.ndarray, who: list, why: list) -> pa.RecordBatch:
    columns = [batch["doc_id"], pa.array(scores, pa.float64()), pa.array(who, pa.list_(pa.int64())), pa.array(why, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "neighbours", "evidence"])


def _with_votes(docs: DataFrame, voters: Voters, schema: str, made: Callable) -> DataFrame:
    """What ``made(batch, scores, neighbours, evidence)`` gives for the rows of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = sent.value
        for whole in batches:
            for lo in range(0, len(whole), TEXTS):
                batch = whole.slice(lo, TEXTS)
                texts = [x or "" for x in batch["text"].to_pylist()]
                known = {x: None for x in texts}
                known = dict(zip(known, voters.votes(list(known)), strict=True))
                votes, who, why = zip(*[known[x] for x in texts], strict=True)
                yield made(batch, voters.probability(np.array(votes)), list(who), list(why))

    return docs.mapInArrow(run, schema)
