"""Token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .pretokens import boundaries, slices, words_of

#: Characters of a chunk. Longer texts are counted in chunks, by several tasks if need be.
CHUNK = 1 << 16
#: States and pairs a worker keeps; beyond, it compiles anew. That costs time, never counts.
MAX_STATES = 200_000
#: Words whose counts a worker remembers.
MAX_WORDS = 300_000

#: Characters before a chunk that give the states it may be entered in; longer than any token.
WARM_UP = 256
#: Characters that decide a pre-token's boundary: of a piece's first ones not all is known, and it looks so far ahead.
BACK, AHEAD = 4, 2
#: Neighbouring maps that a task composes.
TOGETHER = 64
#: Bytes after which states that were reached from several entries are compared.
STRIDE = 64

#: A chunk's state map: what each entry state gives, as (exit state, tokens). None stands for every state not named;
#: as an exit or a number it says that the map doesn't know it.
StateMap = dict[bytes | None, tuple[bytes | None, int | None]]


def composed(maps: Iterable[StateMap]) -> StateMap:
    """The map of consecutive stretches from theirs. It is associative, so maps may be composed in any grouping."""
    out: StateMap | None = None
    for then in maps:
        if out is None:
            out = then
            continue
        met = {}
        for entry, (state, n) in out.items():
            to, more = then.get(state, then[None])
            met[entry] = (to, None if n is None or more is None else n + more)
        out = met
    return out or {None: (None, 0)}


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountTransducer:
    """A deterministic transducer from the bytes of a pre-token to the number of its tokens.

    A token sequence is the encoding if and only if each two neighbours are the encoding of their own
    text (Berglund and van der Merwe, 2023). So after each byte exactly one token ends the encoding of
    what was read. A state holds, for every place where a token may still begin that reaches beyond
    the last byte, how far that token has been spelt, which token ends just before the place, and how
    many tokens fewer were counted there. A transition carries the change of the count. States and
    transitions are compiled when first reached; time is linear in the bytes, for words of any length.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, model = _byte_letters(), file["model"]
        self.special = [t["content"] for t in file["added_tokens"] if t["special"]]
        if any(t[:k] == t[-k:] for t in self.special for k in range(1, len(t))):
            raise ValueError("a special token that may overlap itself")
        spelt = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(spelt(a), spelt(b)): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.ranks}
        self.child: dict[int, int] = {}
        self.ending: list[bytes | None] = [None]
        self.inner: list[bool] = [True]
        for token in sorted(self.tokens):
            node = 0
            for b in token:
                self.inner[node] = True
                key = node << 8 | b
                node = self.child.setdefault(key, len(self.ending))
                if node == len(self.ending):
                    self.ending.append(None)
                    self.inner.append(False)
            self.ending[node] = token
        self.restart()

    def restart(self) -> None:
        self.places: list[tuple] = [((0, None, 0),)]
        self.states = {self.places[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[bytes, int] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The encoding by its definition: again and again the leftmost pair of the lowest rank is merged."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        live, last, change = [], None, 0
        for node, before, count in self.places[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                live.append((node, before, count))
            token = self.ending[node]
            if token is not None and last is None and (before is None or self.fits(before, token)):
                last, change = token, count + 1
        places = (*((n, b, c - change) for n, b, c in live), (0, last, 0))
        to = self.states.setdefault(places, len(self.places))
        if to == len(self.places):
            self.places.append(places)
        step = self.steps[state << 8 | byte] = (to, change)
        return step

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after ``data``, and by how much the count has grown."""
        total, steps = 0, self.steps
        for b in data:
            step = steps.get(state << 8 | b) or self.compile(state, b)
            state = step[0]
            total += step[1]
        return state, total

    def count(self, word: bytes) -> int:
        """Run one pre-token through the machine."""
        if (known := self.words.get(word)) is not None:
            return known
        total = self.run(0, word)[1]
        if len(self.places) > MAX_STATES:
            self.restart()
        if len(self.words) < MAX_WORDS and len(word) < 64:
            self.words[word] = total
        return total

    def run_from(self, entries: set[int], data: bytes) -> dict[int, tuple[int, int]]:
        """``run`` from each entry. States that meet run on as one, and what recurs runs once."""
        live, known = {e: [(e, 0)] for e in entries}, {}
        for at in range(0, len(data), STRIDE):
            part, met = data[at : at + STRIDE], {}
            for state, members in live.items():
                if (state, part) not in known:
                    known[state, part] = self.run(state, part)
                to, n = known[state, part]
                met.setdefault(to, []).extend((e, c + n) for e, c in members)
            live = met
        return {e: (state, c) for state, members in live.items() for e, c in members}

    def name(self, state: int) -> bytes:
        """A state's name, the same in every worker."""
        return hashlib.blake2b(repr(self.places[state]).encode(), digest_size=16).digest()

    def possible(self, data: bytes) -> set[int]:
        """States that may hold after ``data`` inside a pre-token whose beginning isn't seen: that of every place in
        ``data`` where a token may have begun afresh."""
        live: set[int] = set()
        for b in data:
            live = {(self.steps.get(s << 8 | b) or self.compile(s, b))[0] for s in live | {0}}
        return live

    def state_map(self, piece: str, before: int, own: int, begun: bool) -> StateMap:
        """The map of ``own`` characters of ``piece`` after ``before``; ``begun`` if the text began before the piece."""
        data = piece.encode()
        size = lambda n: len(piece[:n].encode())
        low, start, end = size(BACK if begun else 0), size(before), size(before + own)
        starts = boundaries(data, np.array([0, len(data)]))
        starts = starts[starts >= low]
        earlier, inside = starts[starts < start], starts[(starts >= start) & (starts < end)]
        if not len(inside):
            entries = {self.run(0, data[earlier[-1] : start])[0]} if len(earlier) else self.possible(data[low:start])
            out = {self.name(e): (self.name(to), n) for e, (to, n) in self.run_from(entries, data[start:end]).items()}
            return out | {None: (None, None)}
        state, total = self.run(0, data[inside[-1] : end])
        words = words_of(data[inside[0] : inside[-1]], inside[:-1] - inside[0])
        each = np.fromiter(map(self.run_word, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        total += int(each[words.indices.to_numpy()].sum())
        left = self.name(state)  # whatever the entry, the last pre-token that starts here gives the exit
        if inside[0] == start:
            return {None: (left, total)}
        entries = {self.run(0, data[earlier[-1] : start])[0]} if len(earlier) else self.possible(data[low:start])
        return {self.name(e): (left, n + total) for e, (_, n) in self.run_from(entries, data[start : inside[0]]).items()} | {None: (left, None)}

    def run_word(self, word: bytes) -> int:
        """``count`` that leaves the states as they are."""
        return self.words[word] if word in self.words else self.run(0, word)[1]

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Each distinct pre-token of a slice runs once."""
        out = np.zeros(len(texts), np.int64)
        for row, data, offsets in slices(texts):
            ends = offsets
            owner = np.arange(len(offsets) - 1)
            for special in self.special:
                if special.encode() in data:
                    data, ends, owner, found = _without(special.encode(), data, ends, owner)
                    np.add.at(out, row + found, 1)
            starts = boundaries(data, ends)
            if not len(starts):
                continue
            words = words_of(data, starts)
            each = np.fromiter(map(self.count, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            sums = np.append(0, np.cumsum(each[words.indices.to_numpy()]))
            at = np.searchsorted(starts, ends)
            np.add.at(out, row + owner, sums[at[1:]] - sums[at[:-1]])
        return out


def _without(special: bytes, data: bytes, offsets: np.ndarray, owner: np.ndarray):
    """Cut texts at a special token: data and offsets of what is left, each piece's row, and the rows of the tokens."""
    pieces, rows, found = [], [], []
    for i, own in enumerate(owner):
        parts = data[offsets[i] : offsets[i + 1]].split(special)
        pieces += parts
        rows += [own] * len(parts)
        found += [own] * (len(parts) - 1)
    ends = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)
    return b"".join(pieces), ends, np.array(rows), np.array(found, dtype=int)


@lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(machine.count_texts(batch["text"]))], ["doc_id", "n_bytes", "n"])

    return run


_PIECES = "row long, chunk long, doc_id long, n_bytes long, digest string, special long, piece string, before int, own int, begun boolean"


def _cut(path: str, chunk: int, warm_up: int):
    """Texts to pieces of ``chunk`` characters of their own, with what lies about them. Special tokens end a text as its end does."""

    def pieces(text: str, special: list[str]) -> Iterator[tuple]:
        parts = [text]
        for token in special:
            parts = [x for p in parts for x in p.split(token)]
        found = len(parts) - 1  # goes to the first piece; the whole text's
        for part in filter(None, parts) if len(parts) > 1 else parts:
            for at in range(0, len(part), chunk):
                low, high = max(at - warm_up, 0), min(at + chunk, len(part))
                yield found, part[low : high + AHEAD], at - low, high - at, low > 0
                found = 0
        if found:
            yield found, "", 0, 0, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, special = TaskContext.get().partitionId() << 33, transducer(path).special
        for batch in batches:
            for doc_id, n, text in zip(*(batch[c] for c in ("doc_id", "n_bytes", "text")), strict=True):
                text, row = text.as_py(), row + 1
                digest = hashlib.sha256(text.encode()).hexdigest()
                for no, made in enumerate(pieces(text, special)):
                    values = [row, no, doc_id.as_py(), n.as_py() if no == 0 else 0, digest, *made]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, _KINDS, strict=True)], _NAMES)

    return run


_NAMES = [x.split()[0] for x in _PIECES.split(", ")]
_KINDS = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in _PIECES.split(", ")]

_MAP = pa.list_(pa.struct([("entry", pa.binary()), ("exit", pa.binary()), ("n", pa.int64())]))
_MAPS = "row long, chunk long, doc_id long, n_bytes long, digest string, map array<struct<entry: binary, exit: binary, n: long>>"


def _column(maps: list[StateMap]) -> pa.Array:
    return pa.array([[{"entry": e, "exit": x, "n": n} for e, (x, n) in m.items()] for m in maps], _MAP)


def _mapped(path: str):
    """Pieces to their state maps; a special token is counted with the first of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            maps = []
            for special, *piece in zip(*(batch[c].to_pylist() for c in ("special", "piece", "before", "own", "begun")), strict=True):
                own = machine.state_map(*piece) if piece[0] else {None: (None, 0)}
                maps.append({e: (x, None if n is None else n + special) for e, (x, n) in own.items()})
                if len(machine.places) > MAX_STATES:
                    machine.restart()
            kept = [batch[c] for c in ("row", "chunk", "doc_id", "n_bytes", "digest")]
            yield pa.RecordBatch.from_arrays([*kept, _column(maps)], [*_NAMES[:5], "map"])

    return run


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of neighbouring maps, in order, to one map each."""
    for batch in batches:
        maps = [composed({x["entry"]: (x["exit"], x["n"]) for x in one["map"]} for one in group) for group in batch["maps"].to_pylist()]
        kept = [batch[c] for c in ("row", "chunk", "doc_id", "n_bytes", "digest")]
        yield pa.RecordBatch.from_arrays([*kept, _column(maps)], [*_NAMES[:5], "map"])


def compose_maps(maps: DataFrame, together: int = TOGETHER) -> DataFrame:
    """One map per ``row`` from those of its chunks: neighbours are composed, ``together`` at a time, in as many rounds as
    the most chunks need. A map has at most as many entries as its first chunk has, so none grows."""
    most = maps.agg(F.max("chunk")).first()[0] or 0
    while most:
        near = maps.groupBy("row", F.floor(F.col("chunk") / together).cast("long").alias("next")).agg(
            F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.first("digest").alias("digest"), F.array_sort(F.collect_list(F.struct("chunk", "map"))).alias("maps")
        )
        maps = near.withColumnRenamed("next", "chunk").mapInArrow(_composed, _MAPS)
        most //= together
    return maps


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, warm_up: int = WARM_UP) -> DataFrame:
    """Tokens of every text of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path``: a byte-level BPE file of the tokenizers library, on every node. Texts of up to ``chunk``
    characters are counted where they are read. A longer one is a sequence of chunks, dealt to all
    tasks, each of which becomes a state map: for every state it may be entered in, the exit state and
    the tokens counted. If a pre-token starts in the ``warm_up`` characters before a chunk, its entry
    is known; in one long run, of letters say, the entries are the states of all places in the warm-up where a
    token may have begun. Maps compose associatively, in rounds of ``TOGETHER`` neighbours, and
    what the first chunk's map then says of a text is its count.

    The states of a warm-up needn't hold the true one. A text whose maps don't meet is noticed by its composed map, and
    is counted whole, in one task, in time linear in its length. So counts are always exact.

    The special token's string counts as one token, as the library has it by default. Null or empty
    texts have no bytes and no tokens. Rows with equal doc_id are counted each. An empty table gives
    no rows. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(_counted(path), "doc_id long, n_bytes long, n long")
    long = rows.where(F.length("text") > chunk)
    pieces = long.mapInArrow(_cut(path, chunk, max(warm_up, BACK)), _PIECES)
    maps = materialize(pieces.repartition("row", "chunk").mapInArrow(_mapped(path), _MAPS), "maps")
    whole = compose_maps(maps).select("doc_id", "n_bytes", "digest", F.filter("map", lambda x: x["entry"].isNull())[0]["n"].alias("n"))
    if not (whole := materialize(whole, "counts")).where("n is null").isEmpty():
        missed = whole.where("n is null").select("digest").distinct()
        again = long.withColumn("digest", F.sha2("text", 256)).join(missed, "digest").dropDuplicates(["digest"])
        again = again.select("text", "digest").mapInArrow(_recounted(path), "digest string, again long")
        whole = whole.join(again, "digest", "left").withColumn("n", F.coalesce("n", "again"))
    out = short.union(whole.select("doc_id", "n_bytes", "n"))
    return out.select("doc_id", "n_bytes", F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))


def _recounted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(machine.count_texts(batch["text"]))], ["digest", "again"])

    return run
