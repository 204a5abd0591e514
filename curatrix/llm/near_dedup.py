"""Near-duplicate groups by HyperMinHash banding and verification on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words; a link is 100 * shared >= ``percent`` * united shingles.

    A sketch has 2 to the ``bucket_bits`` registers of a leading-zero count and ``mantissa_bits``;
    ``bands`` of ``rows`` registers make candidates. A pair at 0.8 is missed by all 42 bands of 6 with
    a probability of 3e-6. Candidates are told apart by sketches of 2 to the ``fine_bits`` registers.
    ``pivots`` rounds compare a bucket's members with one of them; what is open then is compared by
    sketches in blocks of ``block``, unless a cluster has over ``wide`` members: these are banded anew by
    their rarest shingles. A band of over ``dealt`` members is dealt to several tasks, each with a pivot of its
    own. Up to ``most_sent`` ids of candidates are sent to all tasks that read the texts of candidates;
    more are joined.
    """

    words: int = 5
    percent: int = 80
    bucket_bits: int = 8
    fine_bits: int = 10
    mantissa_bits: int = 10
    bands: int = 42
    rows: int = 6
    pivots: int = 2
    block: int = 1024
    wide: int = 16_384
    dealt: int = 262_144
    most_sent: int = 1_000_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes. A-Z counts as a-z; words are runs
    without ASCII white space; fewer words than ``n`` are one shingle; no words, none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j])
    return np.unique(out)


def sketch(shingles: np.ndarray, s: Settings, bits: int | None = None) -> np.ndarray:
    """The registers: per bucket its least hash as (63 - leading zeros, mantissa bits); empty ones are 0xFFFF."""
    bits = bits or s.bucket_bits
    out = np.full(1 << bits, 0xFFFF, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))  # sorted, so the least of each
        rest = shingles[first] << np.uint64(bits) | np.uint64(1)
        _, power = np.frexp(rest.astype(np.float64))
        zeros = np.maximum(64 - power, 0).astype(np.uint64)
        mantissa = (rest << zeros) << np.uint64(1) >> np.uint64(64 - s.mantissa_bits)
        out[bucket[first]] = ((np.uint64(63) - zeros) << np.uint64(s.mantissa_bits) | mantissa).astype(np.uint16)
    return out


_PROBES: dict[int, np.ndarray] = {}


def band_keys(registers: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit key per band. Empty registers borrow from the first filled one in a fixed random order of their own."""
    k = len(registers)
    if k not in _PROBES:
        draw = np.random.default_rng(17)
        _PROBES[k] = np.array([draw.permutation(k) for _ in range(k)])
    empty = np.flatnonzero(registers == 0xFFFF)
    filled = registers.astype(np.uint64)
    if len(empty):
        probes = _PROBES[k][empty]
        source = probes[np.arange(len(empty)), (registers[probes] != 0xFFFF).argmax(axis=1)]
        filled[empty] = registers[source].astype(np.uint64) | (source.astype(np.uint64) << np.uint64(16))
    out = np.arange(1, s.bands + 1, dtype=np.uint64)
    for column in filled[: s.bands * s.rows].reshape(s.bands, s.rows).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


#: Stands for a null doc_id where ids are compared.
LEAST = -(1 << 63)
#: The expected share of registers that agree by chance alone, times 2 to the mantissa bits: a fixed value.
CHANCE = 0.169919487159739


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates from sketches (rows) of sets of n and m elements, corrected for chance agreement;
    and the number of registers they rest on."""
    used = (a != 0xFFFF) | (b != 0xFFFF)
    size = used.sum(axis=-1)
    same = ((a == b) & used).sum(axis=-1)
    ratio = n / np.maximum(m, 1)
    chance = CHANCE * 2.0 ** (np.log2(a.shape[-1]) - s.mantissa_bits) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(same - chance, 0) / np.maximum(size, 1), size


def likelihood(a, b, n, m, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether sizes and estimate leave a link possible, by six standard deviations; whether they leave
    a failure possible; and the estimate.

    Registers are a sample of the united set without replacement, so the deviation vanishes where nearly
    every shingle has a register of its own. No link joins sets of which one is under ``percent`` of the other.
    """
    guess, size = estimate(a, b, n, m, s)
    edge, united = s.percent / 100, (n + m) / (1 + guess)
    rest = np.clip((united - size) / np.maximum(united - 1, 1), 0, 1)
    slack = 6 * np.sqrt(edge * (1 - edge) * rest / np.maximum(size, 1)) + 2 / np.maximum(size, 1)
    fits = 100 * np.minimum(n, m) >= s.percent * np.maximum(n, m)
    return fits & (guess >= edge - slack), guess < edge + slack, guess


def _sketched(s: Settings, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # copies in the same task send their bands once; a repeat would do no harm
        for batch in batches:
            sizes, names, bands = [], [], []
            for text in batch["text"]:
                own = shingle_set(text.as_py(), s.words)
                name = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                sizes.append(len(own))
                names.append(name)
                bands.append(band_keys(sketch(own, s), s) if name and name not in done else None)
                done.add(name)
            if len(done) > 200_000:
                done.clear()
            columns = [*[batch[k] for k in keys], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "n", "class", "bands"])

    return run


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (band, part, ..., class): every class of a part but the first, beside the first, its
    pivot, and both their labels. A pivot of a part that isn't the whole band (null) has its own row too. One row is in
    hand, never a band."""
    place = pivot = pivot_label = last = None
    for batch in batches:
        out = []
        for b, part, name, label in zip(*(batch[c].to_pylist() for c in ("band", "part", "class", "label")), strict=True):
            if (b, part) != place:
                place, pivot, pivot_label = (b, part), name, label
                if part is not None:
                    out.append((b, pivot, pivot_label, pivot, pivot_label))
            elif name != last:
                out.append((b, pivot, pivot_label, name, label))
            last = name
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.binary() if i else pa.int64()) for i in range(5)], ["band", "pivot", "pivot_label", "class", "label"]
        )


def _hot_bands(rows: DataFrame, s: Settings) -> DataFrame:
    """``band, parts`` of the bands of ``rows(band, class)`` with over ``s.dealt`` members, judged by one class in so many
    that ``s.dealt`` members show as 4,096. What it misses by chance is a band hardly larger, in one task; results don't hang on it."""
    one_in = max(1, s.dealt // 4096)
    seen = rows.where(F.pmod(F.xxhash64("class"), F.lit(one_in)) == 0).groupBy("band").agg((F.count("*") * one_in).alias("members"))
    return seen.where(F.col("members") > s.dealt).select("band", F.ceil(F.col("members") / s.dealt).cast("int").alias("parts"))


def _stars(rows: DataFrame, s: Settings, *order) -> DataFrame:
    """``band, pivot, pivot_label, class, label`` of the bands with several classes among ``rows(band, class,
    label)``; a band's pivot is its first class in ``order``, then by name. The parts of a hot band have a pivot each,
    and the band's pivot is one of these: it meets the others."""
    names = [f"o{i}" for i in range(len(order))]
    schema = "band long, pivot binary, pivot_label binary, class binary, label binary"

    def starred(dealt: DataFrame, *by: str) -> DataFrame:
        ordered = dealt.repartition(*by).sortWithinPartitions("band", "part", *names, "class").select("band", "part", "class", "label")
        return ordered.mapInArrow(_starred, schema)

    whole = F.lit(None).cast("int").alias("part")
    dealt = rows.select("band", whole, *[o.alias(n) for o, n in zip(order, names, strict=True)], "class", "label")
    hot = materialize(_hot_bands(rows, s), "hot-bands")
    if hot.isEmpty():
        return materialize(starred(dealt, "band"), "stars")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    parts = dealt.drop("part").join(hot, "band", "left").withColumn("part", part)
    own = materialize(starred(parts, "band", "part"), "parts")
    heads = own.where("class = pivot").select("band", whole, *[o.alias(n) for o, n in zip(order, names, strict=True)], "class", "label")
    return materialize(own.union(starred(heads, "band")), "stars")


def _details(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            names, sizes, sketches, sets = [], [], [], []
            for text in batch["text"]:
                own = shingle_set(text.as_py(), s.words)
                name = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if name not in done:
                    done.add(name)
                    names.append(name)
                    sizes.append(len(own))
                    sketches.append(sketch(own, s, s.fine_bits).tobytes())
                    sets.append(own.tobytes())
            columns = [pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "n", "sketch", "shingles"])

    return run


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _estimated(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = _stack(batch["sketch_a"].to_pylist()), _stack(batch["sketch_b"].to_pylist())
                good = likelihood(a, b, batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), s)[0]
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _verified(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * shared >= s.percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(good, pa.bool_())], ["a", "b", "linked"])

    return run


def _beside(pairs: DataFrame, details: DataFrame, **columns: str) -> DataFrame:
    """``pairs(a, b)`` with columns of both ends' details."""
    for side in "ab":
        own = details.select(F.col("class").alias(side), *[F.col(c).alias(f"{n}_{side}") for n, c in columns.items()])
        pairs = pairs.join(own, side)
    return pairs


def _verify(pairs: DataFrame, details: DataFrame, s: Settings) -> DataFrame:
    """``a, b, linked`` of distinct ``pairs(a, b)``, by their full sets."""
    return materialize(_beside(pairs, details, set="shingles").mapInArrow(_verified(s), "a binary, b binary, linked boolean"), "verified")


def _links(stars: DataFrame, details: DataFrame, s: Settings) -> DataFrame:
    """The links of pivots with classes of other labels in their bands: first by sketches, then on full sets."""
    apart = stars.where("class <> pivot and (pivot_label is null or label is null or label <> pivot_label)")
    pairs = apart.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()
    likely = _beside(pairs, details, n="n", sketch="sketch").mapInArrow(_estimated(s), "a binary, b binary")
    return _verify(likely, details, s).where("linked").select("a", "b")


def _block_pairs(s: Settings, bold: bool):
    """Candidates between two blocks of a cluster, from sketches: all that may link and don't hang together yet.

    Pairs are taken from the most alike on. One that is likely to link (``bold``: estimated as one; else:
    all but sure) joins its ends, so what hangs together by such pairs is not paired again; should one
    of them fail, the caller asks again.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class").reset_index(drop=True)
        sketches, n, name, block = _stack(rows["sketch"]), rows["n"].to_numpy(), rows["class"].to_numpy(), rows["block"].to_numpy()
        label, labels = pd.factorize(rows["label"])
        root = list(range(len(labels)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        one, other = rows["low"].iloc[0], rows["high"].iloc[0]
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == other)
        firsts, seconds, guesses, sures = [], [], [], []
        for i in left:
            facing = right[right > i] if one == other else right
            facing = facing[(label[facing] != label[i]) & (100 * np.minimum(n[facing], n[i]) >= s.percent * np.maximum(n[facing], n[i]))]
            if len(facing):
                likely, doubtful, guess = likelihood(sketches[i], sketches[facing], np.full(len(facing), n[i]), n[facing], s)
                sure = guess >= s.percent / 100 if bold else ~doubtful
                firsts.append(np.full(int(likely.sum()), i))
                seconds.append(facing[likely]), guesses.append(guess[likely]), sures.append(sure[likely])
        found = []
        if firsts:
            i, j, guess, sure = map(np.concatenate, (firsts, seconds, guesses, sures))
            refused = {(x, y) for x, own in zip(name, rows["refused"], strict=True) if own is not None for y in own}
            for k in np.argsort(-guess, kind="stable"):
                x, y = top(label[i[k]]), top(label[j[k]])
                pair = min(name[i[k]], name[j[k]]), max(name[i[k]], name[j[k]])
                if x != y and pair not in refused:
                    found.append((*pair, bool(sure[k])))
                    if sure[k]:
                        root[y] = x
        return pd.DataFrame(found, columns=["a", "b", "sure"])

    return run


def _clusters(open_: DataFrame) -> DataFrame:
    """``node, component`` of the classes of ``open_(band, class)``: what shares open bands is a cluster."""
    low = open_.groupBy("band").agg(F.min("class").alias("low"))
    return materialize(connected_components(open_.join(low, "band").select("class", "low").distinct(), "class", "low"), "clusters")


def _settled(clusters: DataFrame, labels: DataFrame, details: DataFrame, s: Settings) -> DataFrame:
    """``labels``, the components of the links known so far, with the links within ``clusters(node, component)``.

    Their members are compared in pairs of blocks, by sketches; what may link is verified on full sets,
    which are fetched for these pairs alone. It is asked again as long as a pair failed that was taken
    to join its ends.
    """
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    members = clusters.join(sizes, "component").join(details.select("class", "n", "sketch"), F.col("node") == F.col("class")).drop("node")
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "members")
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("low"), F.greatest(o, "block").alias("high"))))
    refused = None
    for turn in count():
        named = members.join(labels.select("class", F.col("component").alias("label")), "class", "left").withColumn("label", F.coalesce("label", "class"))
        if refused is None:
            named = named.withColumn("refused", F.lit(None).cast("array<binary>"))
        else:
            named = named.join(refused.groupBy(F.col("a").alias("class")).agg(F.collect_set("b").alias("refused")), "class", "left")
        dealt = named.withColumn("m", meets).select("component", "class", "label", "n", "sketch", "refused", "block", "m.low", "m.high")
        pairs = materialize(dealt.groupBy("component", "low", "high").applyInPandas(_block_pairs(s, turn < 2), "a binary, b binary, sure boolean"), "candidates")
        told = _verify(pairs.select("a", "b").distinct(), details, s)
        labels = _relabelled(labels, told.where("linked").select("a", "b"))
        failed = told.where("not linked").select("a", "b")
        if pairs.where("sure").join(failed, ["a", "b"], "left_semi").isEmpty():
            return labels
        refused = failed if refused is None else materialize(refused.union(failed), "refused")


def _nearest_labels(stars: DataFrame, links: DataFrame) -> DataFrame:
    """``class, component`` of linked classes: the least label of itself and of what it links to. Equal ones are
    of one component; the converse waits for ``_labels``."""
    own = stars.select("class", "label").union(stars.select("pivot", "pivot_label")).select("class", F.coalesce("label", "class").alias("label"))
    far = links.select(F.col("a").alias("class"), F.col("b").alias("far")).union(links.select("b", "a"))
    met = far.join(own.distinct().withColumnRenamed("class", "far"), "far").select("class", "label")
    return met.union(own).groupBy("class").agg(F.min("label").alias("component"))


def _labels(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links, "a", "b").withColumnRenamed("node", "class"), "labels")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(class, component)`` once ``links(a, b)`` join components, and of their ends that had none. Only what the
    links say of components is sought anew, not what made these."""
    ends = links.select(F.col("a").alias("class")).union(links.select("b")).distinct().join(labels, "class", "left_anti")
    whole = labels.select("class", "component").union(ends.select("class", F.col("class").alias("component")))
    met = links
    for side in "ab":
        met = met.join(whole.select(F.col("class").alias(side), F.col("component").alias(f"of_{side}")), side)
    moved = connected_components(met, "of_a", "of_b").withColumnRenamed("component", "to").withColumnRenamed("node", "component")
    return materialize(whole.join(moved, "component", "left").select("class", F.coalesce("to", "component").alias("component")), "labels")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, size, own in zip(batch["class"], batch["n"], batch["shingles"], strict=True):
            band = np.frombuffer(own.as_buffer(), np.int64)
            n = len(band)
            columns = [pa.array([name.as_py()] * n, pa.binary()), pa.array(np.full(n, size.as_py()), pa.int64()), pa.array(band, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "n", "band"])


def _rare_bands(named: DataFrame, details: DataFrame, s: Settings) -> DataFrame:
    """``band, class``: bands anew for ``named(class)``, a band being a shingle. Of n shingles each class has those
    n - ceil(percent of n) + 1 that the fewest classes hold; of two that link, some shingle is among these of both, so no
    link is lost, and what many classes share by the way makes no candidates."""
    own = details.join(named, "class", "left_semi").select("class", "n", "shingles").mapInArrow(_exploded, "class binary, n long, band long")
    own = materialize(own, "shingles")
    held = own.join(own.groupBy("band").agg(F.count("*").alias("holders")), "band")
    place = F.row_number().over(Window.partitionBy("class").orderBy("holders", "band"))
    rare = held.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * s.percent / 100) + 1)
    return materialize(rare.where("holders > 1").select("band", "class"), "rare")


def _pivoted(stars: DataFrame, links: DataFrame | None, details: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links with those that ``s.pivots`` rounds find, the first by ``stars``; the components' labels; and what is
    open still: ``band, class, label`` of the bands that hold several components."""
    for turn in range(s.pivots):
        new = _links(stars, details, s)
        links = new if links is None else links.union(new)
        last = turn + 1 == s.pivots
        labels = _labels(links) if last else materialize(_nearest_labels(stars, new), "labels")
        # A pivot that has met all classes of its band leaves it.
        rest = stars.select("band", "class").join(labels, "class", "left").select("band", "class", F.coalesce("component", "class").alias("label"))
        apart = rest.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
        open_ = materialize(rest.join(apart, "band", "left_semi"), "open")
        if open_.isEmpty():
            return links, labels if last else _labels(links), open_
        if not last:
            stars = _stars(open_, s, F.xxhash64("class", F.pmod("band", F.lit(4)), F.lit(turn)))
    return links, labels, open_


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Groups of near copies among ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the least doc_id reachable over links, ``kept`` whether that is the row's own.

    Texts with equal shingle sets are one class from the start, so copies never pair up, however many.
    Classes that share a band are candidates. In the first round every class of a band meets the band's
    least class, which for a group is the same in most of its bands. In the next those of bands with
    several components meet one of four pivots drawn anew, so a member of a large group meets several. Bands
    that then still hold several components make clusters, which are compared by sketches, in blocks; a
    cluster of many blocks is first banded anew by its members' rarest shingles. So no link is lost
    that would join what the bands show, no pairs of a group are made as rows, and every accepted
    link is verified on the full sets.

    Null and empty texts and texts without words have no shingles and are linked with nothing, not
    with each other. Rows that share a doc_id have each their row, and the class of each. Null
    doc_ids count as the least id where ids are compared, and come back null. An empty table gives no
    rows. Other columns are ignored. Texts are read once whole, and those of candidates once more.
    """
    known, of_class = _classes(docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "text"), ["doc_id"], s)
    own, least = F.col("doc_id"), F.coalesce("least.doc_id", "doc_id")
    true = lambda c: F.when(c != LEAST, c)
    return known.join(of_class, "class", "left").select(true(own).alias("doc_id"), F.col("n").alias("n_shingles"), true(least).alias("component_id"), (own == least).alias("kept"))


def _classes(rows: DataFrame, keys: list[str], s: Settings) -> tuple[DataFrame, DataFrame]:
    """Of ``rows(doc_id, ..., text)``: their ``keys`` (the doc_id first) with ``n, class``, the size and name
    of their sets; and per ``class`` the ``least`` keys of its component."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    rows = rows.withColumn("print", F.xxhash64("text"))  # tells rows apart that share a doc_id or have none
    known = materialize(rows.mapInArrow(_sketched(s, [*keys, "print"]), f"{kinds}, print long, n long, class binary, bands array<long>"), "sketched")
    filled = known.where("n > 0")
    bands = known.where("bands is not null").select(F.explode("bands").alias("band"), "class", F.lit(None).cast("binary").alias("label"))
    stars = _stars(bands, s)
    named = stars.select("class").union(stars.select("pivot")).distinct()
    carriers = filled.join(named, "class", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "print")).alias("c"))
    ids = materialize(carriers.select("c.*").distinct(), "carriers")
    ids = F.broadcast(ids) if ids.count() <= s.most_sent else ids
    found = rows.select("doc_id", "print", "text").join(ids, ["doc_id", "print"], "left_semi").mapInArrow(_details(s), "class binary, n long, sketch binary, shingles binary")
    details = materialize(found.dropDuplicates(["class"]), "details")

    links, labels, open_ = _pivoted(stars, None, details, s)
    if not open_.isEmpty():
        clusters = _clusters(open_)
        wide = clusters.groupBy("component").count().where(F.col("count") > s.wide).select("component")
        wide = materialize(clusters.join(wide, "component", "left_semi").select(F.col("node").alias("class")), "wide")
        if not wide.isEmpty():
            anew = _rare_bands(wide, details, s).join(labels, "class", "left").select("band", "class", F.coalesce("component", "class").alias("label"))
            links, labels, again = _pivoted(_stars(anew, s), links, details, s)
            clusters = _clusters(open_.join(wide, "class", "left_anti").select("band", "class").union(again.select("band", "class")))
        labels = _settled(clusters, labels, details, s)

    least = filled.groupBy("class").agg(F.min(F.struct(*keys)).alias("least"))
    reach = labels.join(least, "class").groupBy("component").agg(F.min("least").alias("reach"))
    return known.drop("bands", "print"), least.join(labels.join(reach, "component"), "class", "left").select("class", F.coalesce("reach", "least").alias("least"))


def drop_near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of ``docs`` per group of near copies, all columns kept: the one of the least doc_id (null
    first), of several the least by a 128-bit hash of all columns. Of rows equal in all columns one stays.

    Up to ``most_sent`` rows that go are sent to all tasks, so the texts needn't be shuffled; beyond, they are joined.
    """
    every = [c for name in docs.columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    mark = F.concat_ws(",", F.xxhash64(F.lit(1), *every), F.xxhash64(F.lit(2), *every))
    marked = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(LEAST)), "__mark": mark})
    rows = marked.select(F.col("__id").alias("doc_id"), F.col("__mark").alias("mark"), "text")
    known, of_class = _classes(rows, ["doc_id", "mark"], s)
    own = F.struct("doc_id", "mark")
    gone = known.join(of_class, "class").where(own != F.col("least")).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    gone = materialize(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= s.most_sent else gone
    out = marked.join(gone, ["__id", "__mark"], "left_anti")
    repeated = known.groupBy("doc_id", "mark").count().where("count > 1")
    return (out if repeated.isEmpty() else out.dropDuplicates(["__id", "__mark"])).select(*[f"`{c}`" for c in docs.columns])
