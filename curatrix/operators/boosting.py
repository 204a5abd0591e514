"""Boosted trees over binned numbers, in whole-number arithmetic.

Gradients are whole millionths, so their sums are exact and the same trees grow however rows are
dealt to tasks. A level of a tree is one pass over narrow rows (a byte a feature, a margin), kept in blocks as a
persisted RDD: tasks sum gradients by node, feature and bin, and Spark adds these; a level's cells, at most 2^depth x features x
bins however many rows there are, come to the driver, which picks each node's split. Margins add up tree by
tree, so an ensemble is continued by adding trees to it.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut
from .metrics import ranking

#: Parts of one in which margins and gradients are counted.
UNIT = 1_000_000
#: Trees beyond which an ensemble should be fitted anew: a fixed value.
MANY_TREES = 5000


@dataclass(frozen=True)
class Boosting:
    """Depth, step, rounds, ``patience`` and ``shrink`` (L2 of leaves) are the endpoints' own settings. ``least`` rows
    make a leaf; ``bins`` (at most 255) a feature; after ``every`` rounds margins are written anew and the validation rows looked at."""

    depth: int = 6
    step: float = 0.05
    rounds: int = 2500
    patience: int = 150
    shrink: float = 3.0
    least: int = 1
    bins: int = 64
    metric: str = "auc"
    every: int = 16


@dataclass(frozen=True)
class Tree:
    """By node (1 is the root; 2n and 2n + 1 are the sons of n): its feature or -1, the last bin that goes left, and
    the leaf's value in millionths."""

    feature: tuple[int, ...]
    cut: tuple[int, ...]
    value: tuple[int, ...]


@dataclass(frozen=True)
class Ensemble:
    """A feature's bin is the number of its ``edges`` below the value; missing values are in bin 0."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    trees: tuple[Tree, ...] = ()

    def first(self, n: int) -> Ensemble:
        return replace(self, trees=self.trees[:n])


@dataclass(frozen=True)
class Run:
    """What a fit gives: the trees up to the best round, the rounds' metrics (none without validation) and the best
    of the new rounds, from 0."""

    ensemble: Ensemble
    stages: list[tuple]
    best_iteration: int | None


def fit_edges(df: DataFrame, features: Sequence[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """Quantiles of each feature, by one pass that keeps a sketch per feature."""
    at = [i / bins for i in range(1, bins)]
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(known(c), at, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return tuple(tuple(sorted(set(q or ()))) for q in row)


def bins_of(columns: Sequence[np.ndarray], edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Rows of bins, a byte a feature."""
    out = np.zeros((len(columns[0]) if columns else 0, len(edges)), np.uint8)
    for f, (x, e) in enumerate(zip(columns, edges, strict=True)):
        x = np.asarray(x, np.float64)
        out[:, f] = np.where(np.isnan(x), 0, np.searchsorted(np.asarray(e, np.float64), x, "left"))
    return out


def leaves(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """The node that each row of bins ends in."""
    feature, last = np.array(tree.feature), np.array(tree.cut)
    node = np.ones(len(codes), np.int64)
    rows = np.arange(len(codes))
    for _ in range((len(feature) - 1).bit_length() - 1):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + (codes[rows, np.maximum(f, 0)] > last[node]), node)
    return node


def margins(trees: Sequence[Tree], codes: np.ndarray) -> np.ndarray:
    """The sum of the trees' values for each row."""
    out = np.zeros(len(codes), np.int64)
    for t in trees:
        out += np.array(t.value)[leaves(t, codes)]
    return out


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def binned(df: DataFrame, ensemble: Ensemble, keep: dict[str, tuple[Column, str]]) -> DataFrame:
    """``keep`` (columns and their types), ``codes`` and the ensemble's ``margin`` of every row."""
    width, names, kept = len(ensemble.features), [f"__{i}" for i in range(len(ensemble.features))], list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = bins_of([batch[n].to_numpy(zero_copy_only=False) for n in names], ensemble.edges)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * width
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kept], packed, pa.array(margins(ensemble.trees, codes))], [*kept, "codes", "margin"])

    columns = [c.cast(kind).alias(k) for k, (c, kind) in keep.items()]
    features = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(n) for n, c in zip(names, ensemble.features, strict=True)]
    schema = ", ".join(f"{k} {kind}" for k, (_, kind) in keep.items())
    return df.select(*columns, *features).mapInArrow(run, f"{schema}, codes binary, margin long")


def blocks_of(rows: DataFrame) -> RDD:
    """``y, codes, margin`` of rows as bytes, a row a batch, persisted: a level's pass is then a small job without a query plan."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                parts = batch["y"].to_numpy().astype(np.uint8).tobytes(), b"".join(batch["codes"].to_pylist()), batch["margin"].to_numpy().tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["y", "codes", "margin"])

    return rows.select("y", "codes", "margin").mapInArrow(packed, "y binary, codes binary, margin binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


#: Up to so many parts are added where they arrive; more are added in tasks first.
FEW_PARTS = 64


def _sums(sums: np.ndarray, y: np.ndarray, codes: np.ndarray, m: np.ndarray, at: np.ndarray, weights: tuple[float, float]) -> None:
    """Adds a block's gradients, curvatures and rows by place (-1: none), feature and bin to ``sums``."""
    _, active, width, most = sums.shape
    w = np.where(y > 0, weights[1], weights[0])
    p = 1 / (1 + np.exp(-(m / UNIT)))
    g = np.floor((w * (y - p)) * UNIT + 0.5)
    h = np.floor(np.maximum((w * (p * (1 - p))) * UNIT, 1) + 0.5)
    some = at >= 0
    at, codes, g, h = at[some], codes[some], g[some], h[some]
    for f in range(width):
        key = at * most + codes[:, f]
        for k, x in enumerate((g, h, None)):  # a block's sums are exact in doubles
            sums[k, :, f] += np.bincount(key, x, active * most).astype(np.int64).reshape(-1, most)


def _places(partial: Tree, active: list[int]) -> np.ndarray:
    place = np.full(2 << (len(partial.feature).bit_length()), -1)
    place[active] = np.arange(len(active))
    return place


def _histograms(pending: Sequence[Tree], partial: Tree, active: list[int], width: int, most: int, weights: tuple[float, float]):
    """A part's gradients, curvatures and rows by node, feature and bin (fewer than ``most``)."""

    def run(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        place, sums = _places(partial, active), np.zeros((3, len(active), width, most), np.int64)
        for own, packed, margin in blocks:
            y = np.frombuffer(own, np.uint8).astype(np.float64)
            codes = np.frombuffer(packed, np.uint8).reshape(len(y), width)
            m = np.frombuffer(margin, np.int64) + margins(pending, codes)
            _sums(sums, y, codes, m, place[leaves(partial, codes)], weights)
        yield sums

    return run


def best_splits(cells: pa.Table, s: Boosting) -> list[tuple[int, tuple | None, int, int]]:
    """``node, best, g, h``: each node's sums and its best split (None if none gains) as feature, bin and the sums of what
    goes left. Ties go to the first feature and bin."""
    node, feature, code, g, h, n = (cells[c].to_numpy() for c in ("node", "feature", "bin", "g", "h", "n"))
    order = np.lexsort((code, feature, node))
    node, feature, code, g, h, n = (x[order] for x in (node, feature, code, g, h, n))
    new = np.append(True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1]))
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    left = lambda x: np.cumsum(x) - (np.cumsum(x) - x)[starts][run]
    whole = lambda x: np.add.reduceat(x, starts)[run]
    (lg, lh, ln), (g, h, n) = map(left, (g, h, n)), map(whole, (g, h, n))
    worth = lambda g, h: g.astype(float) * g.astype(float) / (h.astype(float) + s.shrink * UNIT)
    gain = worth(lg, lh) + worth(g - lg, h - lh) - worth(g, h)
    gain[(ln < s.least) | (n - ln < s.least) | ~(gain > 0)] = -1
    first = np.lexsort((code, feature, -gain, node))
    first = first[np.append(True, node[first][1:] != node[first][:-1])]
    return [(int(node[i]), (int(feature[i]), int(code[i]), int(lg[i]), int(lh[i])) if gain[i] > 0 else None, int(g[i]), int(h[i])) for i in first]


def leaf_value(g: int, h: int, s: Boosting) -> int:
    return math.floor((s.step * UNIT) * (g / (h + s.shrink * UNIT)) + 0.5)


class Growing:
    """A tree that grows level by level: ``active`` nodes are split by their sums until none is left or the depth is reached."""

    def __init__(self, s: Boosting):
        size = 2 << s.depth
        self.s, self.feature, self.last, self.value = s, [-1] * size, [0] * size, [0] * size
        self.active, self.sums, self.left = [1] if s.depth else [], {}, s.depth

    def tree(self) -> Tree:
        return Tree(tuple(self.feature), tuple(self.last), tuple(self.value))

    def split(self, sums_of: np.ndarray) -> None:
        """``sums_of``: gradients, curvatures and rows by active node, feature and bin."""
        node, own, code = np.nonzero(sums_of[2])
        cells = pa.table([np.array(self.active)[node], own, code, *sums_of[:, node, own, code]], ["node", "feature", "bin", "g", "h", "n"])
        self.active, self.left = [], self.left - 1
        for node, best, g, h in best_splits(cells, self.s):
            self.sums[node] = (g, h)
            if best is not None:
                self.feature[node], self.last[node], lg, lh = best
                self.sums[2 * node], self.sums[2 * node + 1] = (lg, lh), (g - lg, h - lh)
                self.active += [2 * node, 2 * node + 1] if self.left else []

    def grown(self) -> Tree:
        for node, (g, h) in self.sums.items():
            if self.feature[node] < 0:
                self.value[node] = leaf_value(g, h, self.s)
        return self.tree()


def _added(parts: RDD) -> np.ndarray:
    """The sum of the parts' arrays, of one part at least."""
    return parts.treeReduce(np.add, 1 if parts.getNumPartitions() <= FEW_PARTS else 2)


def grow(blocks: RDD, pending: Sequence[Tree], edges: Sequence[Sequence[float]], weights: tuple[float, float], s: Boosting) -> Tree:
    """One tree, a pass a level. ``blocks``: as of ``blocks_of``; ``pending``: trees that the margins lack."""
    most, growing = 1 + max(map(len, edges)), Growing(s)
    while growing.active:
        parts = blocks.mapPartitions(_histograms(pending, growing.tree(), growing.active, len(edges), most, weights))
        growing.split(_added(parts) if blocks.getNumPartitions() else np.zeros((3, 1, 1, 1), np.int64))
    return growing.grown()


def staged(rows: DataFrame, trees: Sequence[Tree], width: int, first: int = 0) -> DataFrame:
    """``round, margin, y`` of every row after each of ``trees``, all prefixes in one pass. ``rows``: y, codes, margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, m = _codes(batch["codes"], width), batch["margin"].to_numpy().copy()
            for i, t in enumerate(trees):
                m = m + margins([t], codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), first + i, np.int32)), pa.array(m), batch["y"]], ["round", "margin", "y"])

    return rows.mapInArrow(run, "round int, margin long, y int")


def stage_metrics(stages: DataFrame) -> DataFrame:
    """``round, n, auc, loss`` of staged margins."""
    score = 1 / (1 + F.exp(-(F.col("margin") / UNIT)))
    sign = F.when(F.col("y") == 1, -1.0).otherwise(1.0)
    # Equal margins are counted once for both metrics.
    loss = stages.groupBy("round").agg(F.count("*").alias("n"), F.avg(F.log1p(F.exp(sign * F.col("margin") / UNIT))).alias("loss"))
    area = ranking(stages.withColumn("score", score), "score", "y", ["round"]).select("round", "auc")
    return loss.join(area, "round").select("round", "n", "auc", "loss")


def best_round(values: Sequence[float | None], patience: int) -> tuple[int | None, bool]:
    """The first round of the highest value before ``patience`` rounds brought nothing higher, and whether they did."""
    best, top = None, -math.inf
    for i, v in enumerate(values):
        if v is not None and round(v, 9) > top:
            best, top = i, round(v, 9)
        elif i - (best if best is not None else -1) >= patience:
            return best, True
    return best, False


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str, s: Boosting = Boosting(), validation: str | None = None, parent: Ensemble | None = None,
    edges: Sequence[Sequence[float]] | None = None, going: Callable[[], bool] = lambda: True,
) -> Run:
    """Balanced boosted trees. ``validation`` names a boolean column of rows that choose the best round and stop the boosting
    after ``s.patience`` rounds without a better one; only the others are learned from and weigh the classes.

    ``parent``: the trees are added to its, whose margins the new ones start from; its trees and edges stay. Rows without a
    label don't take part. ``going`` is asked before each round; False ends the fit by an error.
    """
    if parent and tuple(features) != parent.features:
        raise ValueError(f"the parent has other features: {parent.features}, now {tuple(features)}")
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    known = df.where(F.col(label).isin(0, 1)).withColumn("__held", held)
    counts = {r.y: r.n for r in known.where("not __held").groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError(f"{label} has fewer than two classes")
    weights = (max(counts.values()) / counts[0], max(counts.values()) / counts[1])
    if parent is None:
        own = tuple(map(tuple, edges)) if edges is not None else fit_edges(known.where("not __held"), features, s.bins)
        parent = Ensemble(tuple(features), own)
    rows = cut(binned(known, parent, {"y": (F.col(label), "int"), "held": (F.col("__held"), "boolean")}))
    width, trees, stages = len(features), [], []
    while len(trees) < s.rounds:
        fresh: list[Tree] = []
        blocks = blocks_of(rows.where("not held"))
        try:
            while len(fresh) < min(s.every, s.rounds - len(trees)):
                if not going():
                    raise TimeoutError("the fit was told to end")
                fresh.append(grow(blocks, fresh, parent.edges, weights, s))
        finally:
            blocks.unpersist()
        if validation:
            told = stage_metrics(staged(rows.where("held"), fresh, width, len(trees))).orderBy("round").collect()  # a row per round
            stages += [tuple(r) for r in told]
        trees += fresh
        if validation and best_round([r[2] if s.metric == "auc" else -r[3] for r in stages], s.patience)[1]:
            break
        if len(trees) < s.rounds:
            rows = cut(_advanced(rows, fresh, width))
    best = best_round([r[2] if s.metric == "auc" else -r[3] for r in stages], s.patience)[0] if validation else None
    kept = trees if best is None else trees[: best + 1]
    return Run(replace(parent, trees=(*parent.trees, *kept)), stages, best)


@dataclass(frozen=True)
class Fit:
    """One of several fits over the same rows: its settings, the boolean column of rows that it learns from, and that of rows that
    choose its best round, if any (as ``validation`` of ``fit_boosted``)."""

    settings: Boosting
    learn: str
    held: str | None = None


@dataclass(frozen=True)
class _Side:
    """A fit as tasks see it: its place among the margins, its bins, its column of flags; and either the tree that grows, its active
    nodes, bins and weights, or trees that the margins lack and the rounds before them."""

    fit: int
    bins: int
    flag: int
    trees: tuple[Tree, ...] = ()
    first: int = 0
    partial: Tree | None = None
    active: tuple[int, ...] = ()
    most: int = 0
    weights: tuple[float, float] = (1.0, 1.0)


#: Margins in a part of the rows of several fits, at least.
PART_MARGINS = 500_000


def _rows_of(column: np.ndarray) -> pa.Array:
    """A row of a matrix as bytes."""
    ends = np.arange(len(column) + 1, dtype=np.int32) * (column.shape[1] * column.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(column).tobytes())])


def _side_rows(known: DataFrame, features: Sequence[str], label: str, edges: Sequence[Sequence[Sequence[float]]], flags: Sequence[str], fits: int) -> DataFrame:
    """``y, codes, flags, margin``: of each row its bins by all ``edges``, a byte a flag and a margin a fit."""
    names, marks = [f"__{i}" for i in range(len(features))], [f"__f{i}" for i in range(len(flags))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[n].to_numpy(zero_copy_only=False) for n in names]
            codes = np.concatenate([bins_of(columns, e) for e in edges], 1)
            told = np.stack([batch[n].to_numpy() for n in marks], 1)
            yield pa.RecordBatch.from_arrays([batch["y"], _rows_of(codes), _rows_of(told.astype(np.uint8)), _rows_of(np.zeros((len(batch), fits), np.int64))], ["y", "codes", "flags", "margin"])

    columns = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(n) for n, c in zip(names, features, strict=True)]
    told = [F.coalesce(F.col(c), F.lit(False)).cast("int").alias(n) for n, c in zip(marks, flags, strict=True)]
    return known.select(F.col(label).cast("int").alias("y"), *columns, *told).mapInArrow(run, "y int, codes binary, flags binary, margin binary")


def _matrices(own: int, codes: bytes, flags: bytes, margin: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(codes, np.uint8).reshape(own, -1, width), np.frombuffer(flags, np.uint8).reshape(own, -1), np.frombuffer(margin, np.int64).reshape(own, -1)


def _side_blocks(rows: DataFrame) -> RDD:
    """As ``blocks_of``, of rows of several fits."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                parts = batch["y"].to_numpy().astype(np.uint8).tobytes(), *[b"".join(batch[c].to_pylist()) for c in ("codes", "flags", "margin")]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["y", "codes", "flags", "margin"])

    return rows.mapInArrow(packed, "y binary, codes binary, flags binary, margin binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _side_histograms(sides: Sequence[_Side], width: int):
    """A part's sums of all sides, one after another."""

    def run(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        sums = [np.zeros((3, len(x.active), width, x.most), np.int64) for x in sides]
        places = [_places(x.partial, list(x.active)) for x in sides]
        for own, *rest in blocks:
            y = np.frombuffer(own, np.uint8).astype(np.float64)
            codes, flags, margin = _matrices(len(y), *rest, width)
            for x, total, place in zip(sides, sums, places, strict=True):
                some = flags[:, x.flag] > 0
                c = codes[some, x.bins]
                _sums(total, y[some], c, margin[some, x.fit], place[leaves(x.partial, c)], x.weights)
        yield np.concatenate([x.ravel() for x in sums])

    return run


def _side_moved(sides: Sequence[_Side], width: int):
    """A block with its margins after each side's trees."""

    def run(block: tuple) -> tuple:
        own, *rest = block
        codes, _, margin = _matrices(len(own), *rest, width)
        margin = margin.copy()
        for x in sides:
            margin[:, x.fit] += margins(x.trees, codes[:, x.bins])
        return (own, *rest[:2], margin.tobytes())

    return run


def _side_stages(rows: DataFrame, sides: Sequence[_Side], width: int) -> DataFrame:
    """``round, margin, y`` of each side's rows after each of its trees; the side's number is the round's upper half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch["y"].to_numpy()
            codes, flags, margin = _matrices(len(y), *[b"".join(batch[c].to_pylist()) for c in ("codes", "flags", "margin")], width)
            for x in sides:
                some = flags[:, x.flag] > 0
                c, m = codes[some, x.bins], margin[some, x.fit]
                for i, t in enumerate(x.trees):
                    m = m + margins([t], c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), (x.fit << 32) + x.first + i)), pa.array(m), pa.array(y[some])], ["round", "margin", "y"])

    return rows.mapInArrow(run, "round long, margin long, y int")


def _side_advanced(rows: DataFrame, sides: Sequence[_Side], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _, margin = _matrices(len(batch), *[b"".join(batch[c].to_pylist()) for c in ("codes", "flags", "margin")], width)
            margin = margin.copy()
            for x in sides:
                margin[:, x.fit] += margins(x.trees, codes[:, x.bins])
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", _rows_of(margin))

    return rows.mapInArrow(run, rows.schema)


def fit_side_by_side(df: DataFrame, features: Sequence[str], label: str, fits: Sequence[Fit]) -> list[Run]:
    """What ``fit_boosted`` gives for each of ``fits``, all grown at once: a level of all their trees is one job, so many small fits
    take the jobs of the longest. Rows are kept once, with a margin a fit. A fit that has ended takes no more part."""
    width = len(features)
    known = df.where(F.col(label).isin(0, 1))
    binnings = list(dict.fromkeys((x.learn, x.settings.bins) for x in fits))
    flags = list(dict.fromkeys(c for x in fits for c in (x.learn, x.held) if c))
    y, value = F.col(label).cast("int"), lambda c: F.col(c).cast("double")
    at = lambda bins: [i / bins for i in range(1, bins)]
    counted = [F.count_if(F.col(c) & (y == v)).alias(f"n{i}_{v}") for i, c in enumerate(flags) for v in (0, 1)]
    cuts = [F.percentile_approx(F.when(F.col(c) & ~F.isnan(value(f)), value(f)), at(bins), 10_000).alias(f"q{i}_{j}") for i, (c, bins) in enumerate(binnings) for j, f in enumerate(features)]
    told = known.agg(F.count("*").alias("n"), *counted, *cuts).first()  # one row
    edges = [tuple(tuple(sorted(set(told[f"q{i}_{j}"] or ()))) for j in range(width)) for i in range(len(binnings))]
    counts = {c: (told[f"n{i}_0"], told[f"n{i}_1"]) for i, c in enumerate(flags)}
    if any(0 in counts[x.learn] for x in fits):
        raise ValueError(f"{label} has fewer than two classes")
    weights = [tuple(max(counts[x.learn]) / n for n in counts[x.learn]) for x in fits]
    bins = [binnings.index((x.learn, x.settings.bins)) for x in fits]
    parts = min(-(-told.n * len(fits) // PART_MARGINS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(_side_rows(known.repartition(parts), features, label, edges, flags, len(fits)))
    every = min(x.settings.every for x in fits)
    trees, stages = [[] for _ in fits], [[] for _ in fits]
    going = [i for i, x in enumerate(fits) if x.settings.rounds]
    side = lambda i, flag, **how: _Side(i, bins[i], flags.index(flag), **how)
    while going:
        fresh = {i: [] for i in going}
        kept = [_side_blocks(rows)]  # the last has all margins; the one before goes when the last is there
        try:
            for _ in range(every):
                growing = {i: Growing(fits[i].settings) for i in going if len(trees[i]) + len(fresh[i]) < fits[i].settings.rounds}
                while some := [i for i, g in growing.items() if g.active]:
                    most = {i: 1 + max(map(len, edges[bins[i]])) for i in some}
                    sides = [side(i, fits[i].learn, partial=growing[i].tree(), active=tuple(growing[i].active), most=most[i], weights=weights[i]) for i in some]
                    sums = _added(kept[-1].mapPartitions(_side_histograms(sides, width)))
                    ends = np.cumsum([3 * len(x.active) * width * x.most for x in sides])
                    for i, x, own in zip(some, sides, np.split(sums, ends[:-1]), strict=True):
                        growing[i].split(own.reshape(3, len(x.active), width, x.most))
                for i, g in growing.items():
                    fresh[i].append(g.grown())
                while len(kept) > 1:
                    kept.pop(0).unpersist()
                kept.append(kept[-1].map(_side_moved([side(i, fits[i].learn, trees=(fresh[i][-1],)) for i in growing], width)).persist(StorageLevel.MEMORY_AND_DISK))
        finally:
            for blocks in kept:
                blocks.unpersist()
        looked = [side(i, fits[i].held, trees=tuple(fresh[i]), first=len(trees[i])) for i in going if fits[i].held]
        if looked:
            for r in stage_metrics(_side_stages(rows, looked, width)).orderBy("round").collect():  # a row per fit and round
                stages[r.round >> 32].append((r.round & 0xFFFFFFFF, *r[1:]))
        for i in going:
            trees[i] += fresh[i]
        best = {i: best_round([r[2] if x.settings.metric == "auc" else -r[3] for r in stages[i]], x.settings.patience) if x.held else (None, False) for i, x in enumerate(fits)}
        going = [i for i in going if not best[i][1] and len(trees[i]) < fits[i].settings.rounds]
        if going:
            rows = cut(_side_advanced(rows, [side(i, fits[i].learn, trees=tuple(fresh[i])) for i in going], width))
    out = []
    for i, x in enumerate(fits):
        top = best_round([r[2] if x.settings.metric == "auc" else -r[3] for r in stages[i]], x.settings.patience)[0] if x.held else None
        out.append(Run(Ensemble(tuple(features), edges[bins[i]], tuple(trees[i] if top is None else trees[i][: top + 1])), stages[i], top))
    return out


def _advanced(rows: DataFrame, trees: Sequence[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch["margin"].to_numpy() + margins(trees, _codes(batch["codes"], width))
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(m))

    return rows.mapInArrow(run, rows.schema)


def score_boosted(ensemble: Ensemble, df: DataFrame, out: str = "score", valid: Column | None = None) -> DataFrame:
    """Adds the probability of class 1; null for rows that aren't ``valid``."""

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-(margins(ensemble.trees, bins_of(columns, ensemble.edges)) / UNIT))))

    found = probability(*[F.col(c).cast("double") for c in ensemble.features])
    return df.withColumn(out, found if valid is None else F.when(valid, found))


def staged_scores(ensemble: Ensemble, df: DataFrame, out: str = "scores") -> DataFrame:
    """Adds the probabilities after each tree, as an array; one pass for all prefixes."""

    @F.pandas_udf("array<double>")
    def probabilities(*columns: pd.Series) -> pd.Series:
        codes = bins_of(columns, ensemble.edges)
        m = np.cumsum([margins([t], codes) for t in ensemble.trees], axis=0) if ensemble.trees else np.zeros((0, len(codes)))
        return pd.Series(list(1 / (1 + np.exp(-(m.T / UNIT)))))

    return df.withColumn(out, probabilities(*[F.col(c).cast("double") for c in ensemble.features]))


def tree_table(spark: SparkSession, ensemble: Ensemble) -> DataFrame:
    """``tree, node, feature, cut, value`` of the nodes that rows can reach; a leaf has no feature."""
    rows = []
    for i, t in enumerate(ensemble.trees):
        reached = [1]
        for node in reached:
            inner = t.feature[node] >= 0
            rows.append((i, node, t.feature[node] if inner else None, t.cut[node] if inner else None, None if inner else t.value[node]))
            reached += [2 * node, 2 * node + 1] if inner else []
    return spark.createDataFrame(rows, "tree int, node int, feature int, cut int, value long")


def save_run(spark: SparkSession, path: str, run: Run, **told) -> None:
    """The trees as a table, and one document: features, edges, best_iteration, the rounds' metrics and what is ``told``."""
    tree_table(spark, run.ensemble).write.parquet(f"{path}/trees")
    doc = {"features": run.ensemble.features, "edges": run.ensemble.edges, "best_iteration": run.best_iteration, "stages": run.stages, "n_trees": len(run.ensemble.trees), **told}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(f"{path}/run")


def load_run(spark: SparkSession, path: str) -> tuple[Run, dict]:
    """What ``save_run`` wrote, and its document."""
    doc = json.loads(spark.read.text(f"{path}/run", wholetext=True).first().value)
    size: dict[int, int] = {}
    rows = spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect()  # trees x nodes
    for r in rows:
        size[r.tree] = max(size.get(r.tree, 2), 1 << r.node.bit_length())
    trees = [([-1] * n, [0] * n, [0] * n) for _, n in sorted(size.items())]
    for r in rows:
        feature, last, value = trees[r.tree]
        if r.feature is None:
            value[r.node] = r.value
        else:
            feature[r.node], last[r.node] = r.feature, r.cut
    ensemble = Ensemble(tuple(doc["features"]), tuple(map(tuple, doc["edges"])), tuple(Tree(*map(tuple, t)) for t in trees))
    return Run(ensemble, [tuple(x) for x in doc["stages"]], doc["best_iteration"]), doc


def same_tree(a: Tree, b: Tree) -> bool:
    """Whether two trees judge alike, however deep their tables reach."""
    n = max(len(a.feature), len(b.feature))
    pad = lambda t: [(*x, *[fill] * (n - len(x))) for x, fill in ((t.feature, -1), (t.cut, 0), (t.value, 0))]
    return pad(a) == pad(b)


def bin_of(x: float | None, edges: Sequence[float]) -> int:
    """The bin of one value."""
    return 0 if x is None or math.isnan(x) else bisect.bisect_left(edges, x)


def refit_boosted(df: DataFrame, features: Sequence[str], label: str, run: Run, s: Boosting = Boosting()) -> Run:
    """All rows, with as many rounds as the validated run found best, best_iteration + 1 (N6). Without one it is an error."""
    if run.best_iteration is None:
        raise ValueError("no best_iteration was recorded; the number of rounds would be a guess")
    return fit_boosted(df, features, label, replace(s, rounds=run.best_iteration + 1), edges=run.ensemble.edges)
