"""Language of a text: known words first, then ever shorter character n-grams (Jauhiainen et al., 2016)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .labelled import remainder
from .pretokens import LETTER, class_table, slices

#: Odd multipliers of the hashes of words and n-grams.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Frequencies are told apart by so many steps an octave where the model is cut to its size.
FINE = 16


@dataclass(frozen=True)
class Settings:
    """``words`` and ``grams`` bound the model: its most frequent words over all languages and, for each length from
    ``longest`` down, its most frequent n-grams. ``languages`` bounds the languages to those of the most documents.
    ``sure`` words of a text make its score as sharp as it gets."""

    words: int = 400_000
    grams: int = 100_000
    longest: int = 5
    languages: int = 1024
    sure: int = 12


@cache
def _in_word() -> np.ndarray:
    """By code point: 1 for letters, 2 for marks, which go on with a word."""
    import regex

    table = (class_table() == LETTER).astype(np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for m in regex.finditer(r"\p{M}+", "".join(map(chr, range(low, high)))):
            table[low + m.start() : low + m.end()] = 2
    return table


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(max(0, n - 1), STEP)))


def _scattered(code: np.ndarray) -> np.ndarray:
    x = (code.astype(np.uint64) + np.uint64(1)) * MIX
    return (x ^ (x >> np.uint64(27))) * STEP


class Words:
    """The words of a slice of texts: ``code`` of their characters one after another, where each word starts, its
    size, the text it is in and its 64-bit hash."""

    def __init__(self, data: bytes, offsets: np.ndarray):
        every = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = _in_word()[every]
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        first = np.zeros(len(every) + 1, bool)
        first[np.searchsorted(lead, offsets)] = True
        inside = kind > 0
        opens = inside & (first[:-1] | ~np.append(False, inside[:-1]))
        run = np.cumsum(opens) - 1  # marks that no letter precedes are no word
        if len(every):
            lettered = np.zeros(int(opens.sum()) + 1, bool)
            lettered[run[kind == 1]] = True
            inside &= lettered[np.maximum(run, 0)] & (run >= 0)
            opens &= inside
        at = np.flatnonzero(inside)
        self.code = every[at]
        self.starts = np.searchsorted(at, np.flatnonzero(opens))
        self.sizes = np.diff(np.append(self.starts, len(at)))
        self.text = np.searchsorted(offsets, lead[np.flatnonzero(opens)], "right") - 1
        place = np.arange(len(at)) - np.repeat(self.starts, self.sizes)
        if len(at):
            h = np.add.reduceat(_scattered(self.code) * _powers(int(self.sizes.max()))[place], self.starts)
            self.hash = (h ^ (h >> np.uint64(31))).view(np.int64)
        else:
            self.hash = np.zeros(0, np.int64)

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all n-grams of the words at ``which``, their ends marked, and the place in ``which`` of each."""
        sizes = self.sizes[which]
        own = np.repeat(np.arange(len(which)), sizes + 2)
        ends = np.cumsum(sizes + 2)
        padded = np.zeros(len(own), np.uint32)  # 0 marks an end
        inner = np.ones(len(own), bool)
        inner[ends - 1] = inner[ends - sizes - 2] = False
        shift = np.repeat(self.starts[which] - np.cumsum(sizes) + sizes, sizes)
        padded[inner] = self.code[np.arange(int(sizes.sum())) + shift]
        if len(padded) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, x = np.zeros(len(padded) - n + 1, np.uint64), _scattered(padded)
        for j, power in enumerate(_powers(n)):
            h += x[j : len(x) - n + 1 + j] * power
        h = (h ^ (h >> np.uint64(31))).view(np.int64)
        whole = own[: len(h)] == own[n - 1 :]
        if n == 1:
            whole &= inner  # a mark alone says nothing
        return h[whole], own[: len(h)][whole]


def _word_slices(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for row, data, offsets in slices(pc.utf8_lower(texts)):
        yield row, len(offsets) - 1, Words(data, offsets)


def _counted(longest: int):
    """``code, size, hash, n``: how often each word (size 0) and n-gram occurs in a slice's texts of a language.

    An n-gram of a word that occurs several times counts as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch["code"].to_numpy()
            for row, n, words in _word_slices(batch["text"]):
                lang = code[row : row + n][words.text]
                for one in np.unique(lang):
                    h, at, times = np.unique(words.hash[lang == one], return_index=True, return_counts=True)
                    which = np.flatnonzero(lang == one)[at]
                    for size in range(longest + 1):
                        if size:
                            g, own = words.grams(which, size)
                            h, back = np.unique(g, return_inverse=True)
                            k = np.bincount(back, weights=times[own], minlength=len(h)).astype(np.int64)
                        else:
                            k = times
                        if len(h):
                            arrays = [pa.array(np.full(len(h), one, np.int32)), pa.array(np.full(len(h), size, np.int32)), pa.array(h), pa.array(k)]
                            yield pa.RecordBatch.from_arrays(arrays, ["code", "size", "hash", "n"])

    return run


class Table:
    """Log frequencies of what is known, by hash and language; what a language lacks has the penalty."""

    def __init__(self, h: np.ndarray, lang: np.ndarray, value: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.hash, self.lang, self.value = h[order], lang[order], value[order].astype(np.float32)

    def look(self, h: np.ndarray, n_langs: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are known, and the log frequencies (rows) of these."""
        lo, hi = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        known = hi > lo
        out = np.full((int(known.sum()), n_langs), penalty, np.float32)
        sizes = (hi - lo)[known]
        own = np.repeat(np.arange(len(out)), sizes)
        at = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo[known], sizes)
        out[own, self.lang[at]] = self.value[at]
        return known, out


@dataclass
class Model:
    """``langs`` by falling number of documents; ``tables`` of words and of n-grams by length; ``penalties`` alike."""

    langs: list[str]
    tables: list[Table]
    penalties: list[float]

    def word_scores(self, words: Words, which: np.ndarray) -> np.ndarray:
        """A row per word: its log frequency where a language knows it; else the mean of its longest known n-grams; else 0."""
        width = len(self.langs)
        out = np.zeros((len(which), width))
        known, found = self.tables[0].look(words.hash[which], width, self.penalties[0])
        out[known] = found
        left = np.flatnonzero(~known)
        for n in range(len(self.tables) - 1, 0, -1):
            if not len(left):
                break
            h, own = words.grams(which[left], n)
            seen, found = self.tables[n].look(h, width, self.penalties[n])
            hits = np.bincount(own[seen], minlength=len(left))
            if hits.any():
                sums = np.stack([np.bincount(own[seen], weights=c, minlength=len(left)) for c in found.T], axis=1)
                out[left[hits > 0]] = sums[hits > 0] / hits[hits > 0, None]
            left = left[hits == 0]
        return out

    def judge(self, texts: pa.Array, sure: int) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text; ``und`` and 0 where there is no letter."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        for row, n, words in _word_slices(texts):
            h, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
            if not len(h):
                continue
            each = self.word_scores(words, first)
            sums = np.stack([np.bincount(words.text, weights=c[back], minlength=n) for c in each.T], axis=1)
            count = np.bincount(words.text, minlength=n)
            some = np.flatnonzero(count)
            mean = np.round(sums[some] / count[some, None], 9)  # sums in another order may differ in the last bit
            best = mean.argmax(axis=1)  # ties: the language of more documents
            sharp = (mean - mean.max(axis=1, keepdims=True)) * np.minimum(count[some], sure)[:, None]
            scores[row + some] = 1 / np.exp(sharp).sum(axis=1)
            for i, b in zip((row + some).tolist(), best.tolist(), strict=True):
                langs[i] = self.langs[b]
        return langs, scores


def learn_languages(docs: DataFrame, s: Settings = Settings()) -> Model:
    """The model of ``docs(text, lang)``: counts of words and n-grams over all rows that have a language.

    Counts are summed in tasks, then by hash; the model keeps what is frequent enough for its size, by a cut for each length that
    a histogram of frequencies gives. A language's frequencies are relative to its own words or n-grams, so that
    none gains by its size; what it lacks counts as half of one in the largest language.
    """
    rows = docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(s.languages).collect()  # bounded
    langs = [r.lang for r in most]
    if not langs:
        return Model([], [], [])
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, code int")
    coded = rows.join(F.broadcast(chosen), "lang").select("code", "text")
    counts = materialize(coded.mapInArrow(_counted(s.longest), "code int, size int, hash long, n long").groupBy("code", "size", "hash").agg(F.sum("n").alias("n")), "counts")
    totals = {(r.code, r.size_): int(r.n) for r in counts.groupBy("code", F.col("size").alias("size_")).agg(F.sum("n").alias("n")).collect()}  # languages x lengths
    whole = spark.createDataFrame([(c, z, n) for (c, z), n in totals.items()], "code int, size int, total long")
    level = F.floor(-F.log2(F.col("n") / F.col("total")) * FINE).cast("int")  # 0: the most frequent
    placed = counts.join(F.broadcast(whole), ["code", "size"]).withColumn("level", level)
    sizes = placed.groupBy("size", "level").agg(F.count("*").alias("k")).collect()  # lengths x octaves x FINE
    cuts = []
    for z in range(s.longest + 1):
        room, cut = s.words if z == 0 else s.grams, -1
        for lv, k in sorted((r.level, r.k) for r in sizes if r["size"] == z):
            room -= k
            if room < 0:
                break
            cut = lv
        cuts.append((z, cut))
    limits = spark.createDataFrame(cuts, "size int, cut int")
    kept = placed.join(F.broadcast(limits), "size").where("level <= cut").select("size", "hash", "code", F.log(F.col("n") / F.col("total")).cast("float").alias("value")).toArrow()
    size, h, code, value = (kept[c].to_numpy() for c in ("size", "hash", "code", "value"))
    tables = [Table(h[size == z], code[size == z], value[size == z]) for z in range(s.longest + 1)]
    penalties = [math.log(0.5 / max([1, *(n for (_, own), n in totals.items() if own == z)])) for z in range(s.longest + 1)]
    return Model(langs, tables, penalties)


def identify_languages(docs: DataFrame, modulus: int = 3, held: int = 1, s: Settings = Settings()) -> DataFrame:
    """Predict the language of every whole text of ``docs(doc_id, text, lang)`` by the rows outside the held-out part.

    Returns ``doc_id, held_out, lang_pred, score``. Words are runs of letters and their marks, lower-cased. A known word
    scores by its log frequency in each language; one that no language knows by the mean of its n-grams of ``s.longest`` characters, if
    any is known, else of one less, and so on. The language of the highest mean over a text's words is predicted. The model, bounded by its
    settings, is sent to all tasks; one pass over the texts learns, one predicts, and texts aren't shuffled. Words and
    n-grams are told apart by 64-bit hashes.

    A text that is null or has no letter is ``und`` with score 0; so is every text if no row has a language. Of equally
    likely languages, also where nothing of a text is known, that of more documents counts, then the first by name. Rows that
    share a doc_id are judged each; a null doc_id is hashed as empty text. No rows give no rows. Other columns are ignored.
    """
    part = remainder(F.col("doc_id"), modulus)
    model = learn_languages(docs.where(part != held), s)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = sent.value.judge(batch["text"], s.sure)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "lang_pred", "score")
