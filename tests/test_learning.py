"""Boosting against a plain loop, increments on a parent, and trials that fail, run late or are taken up again."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import boosting as B
from curatrix.operators import learning as N


def noisy(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = draw.choice([None, math.nan, *range(8)]), draw.gauss(0, 1)
        y = int((a or 0) > 3 if draw.random() < 0.8 and a == a else b > 0)
        rows.append((i, a if a is None else float(a), b, y if draw.random() < 0.95 else None))
    return rows


SCHEMA = "row_id long, a double, b double, y int"
EDGES = ((0.0, 2.0, 3.0, 5.0), (-1.0, 0.0, 1.0))


def plain_fit(rows, s, held=(), start=None):
    """Trees as nested dicts, node by node, over Python's own numbers; margins of all rows after each round."""
    known = [(i, [B.bin_of(x, e) for x, e in zip((a, b), EDGES, strict=True)], y) for i, a, b, y in rows if y is not None]
    learned = [r for r in known if r[0] not in held]
    n = [sum(y == c for _, _, y in learned) for c in (0, 1)]
    weight = [max(n) / c for c in n]
    m = {i: (start or {}).get(i, 0) for i, _, _ in known}
    trees, stages = [], []
    for _ in range(s.rounds):
        grad = {}
        for i, _, y in learned:
            p, w = 1 / (1 + math.exp(-(m[i] / B.UNIT))), weight[y]
            grad[i] = (math.floor((w * (y - p)) * B.UNIT + 0.5), math.floor(max((w * (p * (1 - p))) * B.UNIT, 1) + 0.5))
        nodes, tree = {1: learned}, {}
        sums = lambda own: [sum(grad[i][k] for i, _, _ in own) for k in (0, 1)]
        worth = lambda g, h: float(g) * float(g) / (h + s.shrink * B.UNIT)
        for node in (x for d in range(s.depth + 1) for x in range(1 << d, 2 << d)):
            if (own := nodes.get(node)) is None:
                continue
            g, h = sums(own)
            best = None
            if node < 1 << s.depth:
                for f in (0, 1):
                    for cut in sorted({c[f] for _, c, _ in own})[:-1]:
                        left = [r for r in own if r[1][f] <= cut]
                        lg, lh = sums(left)
                        gain = worth(lg, lh) + worth(g - lg, h - lh) - worth(g, h)
                        if gain > 0 and min(len(left), len(own) - len(left)) >= s.least and (best is None or gain > best[0]):
                            best = (gain, f, cut)
            if best:
                tree[node] = (best[1], best[2], None)
                nodes[2 * node] = [r for r in own if r[1][best[1]] <= best[2]]
                nodes[2 * node + 1] = [r for r in own if r[1][best[1]] > best[2]]
            else:
                tree[node] = (None, None, math.floor((s.step * B.UNIT) * (g / (h + s.shrink * B.UNIT)) + 0.5))
        for i, c, _ in known:
            node = 1
            while tree[node][2] is None:
                node = 2 * node + (c[tree[node][0]] > tree[node][1])
            m[i] += tree[node][2]
        trees.append(tree)
        stages.append(dict(m))
    return trees, stages, {i: y for i, _, y in known}


def table(spark, ensemble, first=0):
    return [{r.node: (r.feature, r.cut, r.value) for r in rows} for rows in ([x for x in B.tree_table(spark, ensemble).collect() if x.tree == t] for t in range(first, len(ensemble.trees)))]


@pytest.mark.parametrize("s", [B.Boosting(depth=3, step=0.3, rounds=3), B.Boosting(depth=2, step=0.5, rounds=4, least=9, shrink=0.5, every=3)])
def test_trees_are_those_of_a_plain_loop(spark, s):
    rows = noisy(150, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    run = B.fit_boosted(df, ["a", "b"], "y", s, edges=EDGES)
    trees, stages, _ = plain_fit(rows, s)
    assert table(spark, run.ensemble) == trees and run.best_iteration is None
    want = {i: [1 / (1 + math.exp(-(st[i] / B.UNIT))) for st in stages] for i in stages[0]}
    for r in B.staged_scores(run.ensemble, B.score_boosted(run.ensemble, df)).where("y is not null").collect():
        assert r.scores == pytest.approx(want[r.row_id], abs=1e-12) and r.score == pytest.approx(want[r.row_id][-1], abs=1e-12)


def test_the_best_round_is_validated_saved_and_refitted(spark, tmp_path):
    rows = noisy(160, 2)
    held = {i for i, *_ in rows if i % 4 == 0}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("stops", F.col("row_id") % 4 == 0)
    s = B.Boosting(depth=2, step=0.9, rounds=9, patience=1, metric="loss", shrink=0.1, every=2)
    run = B.fit_boosted(df, ["a", "b"], "y", s, "stops", edges=EDGES)
    trees, stages, y = plain_fit(rows, s, held)
    loss = [np.mean([math.log1p(math.exp((-1 if y[i] else 1) * st[i] / B.UNIT)) for i in y if i in held]) for st in stages]
    assert [r[3] for r in run.stages] == pytest.approx(loss[: len(run.stages)])
    best, stopped = B.best_round([-x for x in loss], s.patience)
    assert run.best_iteration == best and table(spark, run.ensemble) == trees[: best + 1] and stopped and len(run.stages) < 9
    B.save_run(spark, str(tmp_path / "run"), run, dataset="d")
    back, doc = B.load_run(spark, str(tmp_path / "run"))
    assert doc["dataset"] == "d" and doc["n_trees"] == best + 1 and back.best_iteration == best
    assert all(map(B.same_tree, back.ensemble.trees, run.ensemble.trees))
    whole = B.refit_boosted(df, ["a", "b"], "y", back, s)
    assert table(spark, whole.ensemble) == plain_fit(rows, B.Boosting(depth=2, step=0.9, rounds=best + 1, shrink=0.1))[0]


def test_patience():
    assert B.best_round([0.5, 0.7, 0.7, 0.6, 0.9], 2) == (1, True)
    assert B.best_round([0.5, 0.7, 0.7, 0.6, 0.9], 3) == (4, False)
    assert B.best_round([None, None, None], 3) == (None, True) and B.best_round([], 3) == (None, False)


def test_an_increment_goes_on_from_its_parent(spark):
    rows = noisy(300, 3)
    df = spark.createDataFrame([r for r in rows if r[3] is not None], SCHEMA)
    old, new = df.where("row_id < 150"), df.where("row_id >= 140")  # ten rows are in both
    s = B.Boosting(depth=2, step=0.5, rounds=2)
    parent = B.fit_boosted(old, ["a", "b"], "y", s, edges=EDGES).ensemble
    before = table(spark, parent)
    got = N.fit_increment(parent, new, "y", "row_id", F.col("row_id") * 7919, old, 0.2, many=5, depth=2, step=0.5, rounds=3, metric="loss")
    after = table(spark, got["run"].ensemble)
    assert after[:2] == before and len(after) == 2 + got["n_new"] and got["reason"] == "" and got["too_many"] == (len(after) >= 5)
    held = {r.row_id for r in N.stratified_holdout(new, "y", 0.2, F.col("row_id") * 7919).where("holdout").collect()}
    mine = [r for r in rows if r[0] >= 140]
    start = plain_fit([r for r in rows if r[0] < 150], s)[0]

    def margin(r):
        out = 0
        for t in start:
            node = 1
            while t[node][2] is None:
                node = 2 * node + (B.bin_of(r[1 + t[node][0]], EDGES[t[node][0]]) > t[node][1])
            out += t[node][2]
        return out

    trees, _, _ = plain_fit(mine, B.Boosting(depth=2, step=0.5, rounds=got["n_new"]), held, {r[0]: margin(r) for r in mine})
    assert after[2:] == trees
    told = got["metrics"].first()
    assert told.n_pos + told.n_neg == len([i for i in held if i >= 150])  # what the parent has seen doesn't count
    with pytest.raises(ValueError, match="other features"):
        B.fit_boosted(new, ["b", "a"], "y", s, parent=parent)
    alone = N.fit_increment(parent, new.where("y = 1").unionByName(new.where("y = 0").limit(1)), "y", "row_id", F.col("row_id"), old, 0.2, depth=2, rounds=1)
    assert alone["reason"] == "a class has fewer than 2 rows" and alone["n_new"] == 1 and alone["run"].best_iteration is None


def test_edges_are_quantiles_and_missing_values_have_a_bin(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else 1.0, i % 2) for i in range(100)], "a double, b double, y int")
    a, b = B.fit_edges(df, ["a", "b"], 4)
    assert len(a) == 3 and abs(a[1] - 50) < 2 and b == (1.0,)
    assert B.bins_of([np.array([np.nan, -5, a[0], a[0] + 0.1, 1e9])], [a]).ravel().tolist() == [0, 0, 0, 1, 3]
    run = B.fit_boosted(df, ["a", "b"], "y", B.Boosting(depth=2, rounds=1, bins=4))
    assert len(run.ensemble.trees) == 1
    with pytest.raises(ValueError, match="two classes"):
        B.fit_boosted(df.where("y = 1"), ["a"], "y")


TRIALS = [{"rounds": 1, "depth": 1}, {"rounds": 1, "depth": "deep"}, {"rounds": 2, "depth": 2}]


def test_trials_fail_run_late_and_are_taken_up_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([r for r in noisy(80, 4) if r[3] is not None], SCHEMA)
    path, seen = str(tmp_path / "trials"), []
    fit = N.fit_endpoint

    def slow(*args, depth, **kw):
        seen.append(depth)
        if depth == 2:  # until its job is cancelled
            args[0].sparkSession.range(0, 10**14, 1, 1).selectExpr("sum(id % 7)").collect()
        return fit(*args, depth=depth, **kw)

    monkeypatch.setattr(N, "fit_endpoint", slow)
    run = lambda seconds=None, scope="rows": N.run_trials(df, "row_id", ["a", "b"], "y", TRIALS, 2, F.col("row_id"), path, scope, parallel=2, seconds=seconds).collect()
    got = run(40)
    assert [(r.trial, r.status) for r in got] == [(0, "ok"), (1, "failed"), (2, "timed out")]
    assert got[0].auc > 0.5 and got[1].auc is None and "more than 40 s" in got[2].error
    seen.clear()
    monkeypatch.setattr(N, "fit_endpoint", lambda *args, depth, **kw: (seen.append(depth), fit(*args, depth=depth, **kw))[1])
    again = run()
    assert [(r.trial, r.status) for r in again] == [(0, "ok"), (1, "failed"), (2, "ok")]
    assert 1 not in seen and 2 in seen and again[0].auc == got[0].auc
    assert N.read_log(spark, path).count() == 5 and N.read_log(spark, str(tmp_path / "none")).count() == 0
    assert N.trial_key({"a": 1, "b": 2}) == N.trial_key({"b": 2, "a": 1}) != N.trial_key({"a": 1, "b": 2}, "other")


def test_nested_selection(spark, tmp_path):
    df = spark.createDataFrame([r for r in noisy(90, 5) if r[3] is not None], SCHEMA)
    path = str(tmp_path / "log")
    got = N.nested_cv(df, "row_id", ["a", "b"], "y", TRIALS[:2], 2, 2, F.col("row_id"), path, "x", parallel=2)
    rows = got.collect()
    assert sorted(r.row_id for r in rows) == sorted(r.row_id for r in df.collect()) and {r.trial for r in rows} == {0}
    assert {(r.status, r.settings) for r in N.read_log(spark, path).collect()} == {("ok", '{"depth": 1, "rounds": 1}'), ("failed", '{"depth": "deep", "rounds": 1}')}
    with pytest.raises(RuntimeError, match="all 1 trials failed"):
        N.nested_cv(df, "row_id", ["a", "b"], "y", TRIALS[1:2], 2, 2, F.col("row_id"))


def test_the_whole_grid_is_tried(spark, tmp_path, monkeypatch):
    """All eight settings, the baseline first; a number of trials is a choice of the caller's."""
    import duckdb

    from curatrix.plans.catalog import QUERIES
    from curatrix.plans import evaluation  # noqa: F401  it registers the query

    grid = {"x": [1, 2, 3], "y": [True, False]}
    got = N.trial_table(grid, {"x": 2, "y": True})
    assert len({tuple(t.items()) for t in got}) == len(got) == 6 and got[0] == {"x": 2, "y": True} and N.trial_table(grid, {"x": 2, "y": True}, 4) == got[:4]
    for table, columns in (("documents", "i as doc_id, 'a b' as text, 'en' as lang, 's' as source, 3 as n_chars"), ("labels", "i as doc_id, 0 as toxic, i % 2 as quality")):
        duckdb.connect().sql(f"copy (select {columns} from range(9) t(i)) to '{tmp_path}/{table}.parquet' (format parquet)")
    seen = []
    monkeypatch.setattr(N, "nested_cv", lambda *args, **how: seen.extend(args[4]))
    QUERIES["nested_cv"](spark, str(tmp_path))
    assert len({(t["depth"], t["step"], t["shrink"]) for t in seen}) == len(seen) == 8


def test_fits_side_by_side_are_the_fits_one_by_one(spark):
    """Other depths, bins, steps, rows, ends by patience or by rounds, with and without validation: the same trees and rounds."""
    df = spark.createDataFrame([r for r in noisy(240, 8) if r[3] is not None], SCHEMA).withColumns({"first": F.col("row_id") % 3 == 0, "rest": F.col("row_id") % 3 == 1, "most": F.col("row_id") % 3 != 0})
    fits = [
        B.Fit(B.Boosting(depth=3, step=0.4, rounds=40, patience=3, every=2), "rest", "first"), B.Fit(B.Boosting(depth=2, step=0.9, rounds=5, patience=9, every=3, bins=8), "most", "first"),
        B.Fit(B.Boosting(depth=1, step=0.1, rounds=3), "most"), B.Fit(B.Boosting(depth=2, step=0.2, rounds=40, patience=4, metric="loss"), "rest", "first"), B.Fit(B.Boosting(rounds=0), "most"),
    ]
    got = B.fit_side_by_side(df, ["a", "b"], "y", fits)
    for x, run in zip(fits, got, strict=True):
        alone = B.fit_boosted(df.where(F.col(x.learn) | F.col(x.held) if x.held else F.col(x.learn)), ["a", "b"], "y", x.settings, x.held)
        assert run.ensemble.edges == alone.ensemble.edges and run.best_iteration == alone.best_iteration
        assert len(run.ensemble.trees) == len(alone.ensemble.trees) and all(map(B.same_tree, run.ensemble.trees, alone.ensemble.trees))
        n = min(len(run.stages), len(alone.stages))
        assert [r[:3] for r in run.stages[:n]] == [tuple(r[:3]) for r in alone.stages[:n]]
    assert len(got[0].stages) < 40 and got[2].best_iteration is None
    with pytest.raises(ValueError, match="two classes"):
        B.fit_side_by_side(df.where("y = 1"), ["a"], "y", fits[2:3])


def test_nested_selection_together(spark, tmp_path):
    """Trials that grow together choose and score as those that run one by one; a wrong one is a row of the log."""
    df = spark.createDataFrame([r for r in noisy(90, 5) if r[3] is not None], SCHEMA).withColumn("stops", F.col("row_id") % 5 == 0)
    trials = [{"depth": 1, "rounds": 2}, {"depth": 2, "step": 0.5, "rounds": 30, "patience": 2, "every": 4, "validation": "stops"}, {"deep": 1}]
    run = lambda at, **how: sorted(map(tuple, N.nested_cv(df, "row_id", ["a", "b"], "y", trials, 2, 2, F.col("row_id"), str(tmp_path / at), "x", **how).collect()))
    log = lambda at: sorted((r.key, r.settings, r.status, r.auc) for r in N.read_log(spark, str(tmp_path / at)).collect())
    assert run("one", parallel=2) == (rows := run("all", together=True)) and len(rows) == df.count()
    assert log("one") == log("all") and [x[2] for x in log("all")].count("failed") == 2 and len(log("all")) == 6
    assert run("all", together=True) == rows and len(log("all")) == 8  # only what isn't ok again
    with pytest.raises(ValueError, match="time limit"):
        N.run_trials(df, "row_id", ["a", "b"], "y", trials, 2, F.col("row_id"), seconds=5, together=True)


def test_a_level_is_one_job_without_a_shuffle(spark):
    """What a level costs beside its rows is a small job: trees of many rounds have thousands of them."""
    rows = spark.createDataFrame([(i % 2, bytes([i % 5, i % 3]), 0) for i in range(300)], "y int, codes binary, margin long")
    blocks = B.blocks_of(rows)
    assert sum(len(y) for y, _, _ in blocks.collect()) == 300
    sc = spark.sparkContext
    sc.setJobGroup("levels", "a tree")
    try:
        tree = B.grow(blocks, [], [[0.0, 1.0, 2.0, 3.0], [0.0, 1.0]], (1.0, 1.0), B.Boosting(depth=3))
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("levels")]
    finally:
        sc._jsc.clearJobGroup()
        blocks.unpersist()
    assert 1 <= len(jobs) <= 3 and {len(j.stageIds) for j in jobs} == {1}
    assert len(tree.feature) == 16
