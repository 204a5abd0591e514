"""Records over many files, draws, hulls, snapshots, bitmaps and the vector store on small tables."""

import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from curatrix.operators import calibration as L
from curatrix.operators import lineage as R
from curatrix.operators import splits as G
from curatrix.operators import vector_store as Q
from curatrix.sources import snapshots as H
from curatrix.sources import tables as IO


def test_records_are_numbered_by_file_and_place(spark, tmp_path):
    """A small file before a large one, and a file of many blocks: as a reader from the start counts them."""
    (tmp_path / "a.sdf").write_text("".join(f"a{i}\n$$$$\n" for i in range(3)))
    (tmp_path / "b.sdf").write_text("".join(f"b{i} {'x' * 400}\n$$$$\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = IO.read_records(spark, str(tmp_path / "*.sdf"))
        rows = sorted((r.position, r.record.split()[0], r.file_name) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    names = [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(2000)]
    assert [(p, n) for p, n, _ in rows] == list(enumerate(names)) and rows[3][2] == "b.sdf"


def test_draws_are_with_replacement(spark):
    """Each of 100 rows is drawn as often as chance has it, and some of 500 rows never."""
    draws = spark.range(10_000).groupBy(G.drawn(F.col("id"), 42, 100).alias("k")).count().collect()
    chi = sum((r["count"] - 100) ** 2 / 100 for r in draws) + (100 - len(draws)) * 100
    assert 60 < chi < 150  # 99 degrees of freedom
    never = 500 - spark.range(700).select(G.drawn(F.col("id"), 7, 500)).distinct().count()
    assert 95 < never < 150  # about 500 / e^1.4
    far = spark.range(10**15, 10**15 + 10).select(G.drawn(F.col("id"), 1, 10**12).alias("k")).collect()
    assert all(0 <= r.k < 10**12 for r in far) and len({r.k for r in far}) == 10
    df = spark.createDataFrame([(i, int(i < 40)) for i in range(400)], "row_id long, y int")
    copies = [r.row_id for r in G.oversample_drawn(df, "y", F.col("row_id")).where("is_copy").collect()]
    assert len(copies) == 320 and set(copies) <= set(range(40))
    assert sorted(copies) == sorted(r.row_id for r in G.oversample_drawn(df.repartition(5), "y", F.col("row_id")).where("is_copy").collect())
    assert sorted(copies) != sorted(r.row_id for r in G.oversample_drawn(df, "y", F.col("row_id"), seed=7).where("is_copy").collect())


def test_hulls_merge_to_the_whole(spark):
    draw = random.Random(3)
    rows = [(round(draw.random(), 3), int(draw.random() < 0.3)) for _ in range(600)]
    cells = {}
    for s, y in rows:
        n, p = cells.get(s, (0, 0))
        cells[s] = (n + 1, p + y)
    blocks = [(s, s, n, p) for s, (n, p) in sorted(cells.items())]
    whole = L.pooled(blocks)
    for _ in range(20):  # any cut into parts, pooled in any grouping
        cuts = sorted(draw.sample(range(len(blocks)), 5))
        parts = [L.pooled(blocks[a:b]) for a, b in zip([0, *cuts], [*cuts, len(blocks)], strict=True)]
        left = L.pooled([x for part in parts[:3] for x in part])
        assert L.pooled([*left, *L.pooled([x for part in parts[3:] for x in part])]) == whole
    df = spark.createDataFrame([*rows, (None, 1), (0.5, None)], "s double, y int").repartition(7)
    assert [tuple(r) for r in L.isotonic_blocks(df, "s", "y").orderBy("lo").collect()] == whole
    assert L.fit_isotonic(df.limit(0), "s", "y") == L.IsotonicMap((), ())
    nothing = L.apply_isotonic(L.IsotonicMap((), ()), df.limit(3), "s").collect()
    assert all(r.calibrated is None for r in nothing)


def test_writers_of_a_snapshot_table_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda i: spark.createDataFrame([(i, j) for j in range(5)], "writer int, n int")
    with ThreadPoolExecutor(4) as threads:
        versions = list(threads.map(inheritable_thread_target(spark)(lambda i: H.append_rows(rows(i), path)), range(6)))
    assert sorted(versions) == list(range(6)) and H.read_snapshot(spark, path).count() == 30
    assert H.update(spark, path, lambda now: now.where("writer < 2")) == 6
    assert H.read_snapshot(spark, path).count() == 10 and H.read_snapshot(spark, path, 5).count() == 30
    with pytest.raises(H.Conflict):
        H.put_commit(spark, path, 6, [], "replace", schema="writer int, n int")
    assert H.read_snapshot(spark, path).count() == 10
    with pytest.raises(ValueError, match="other columns"):
        H.append_rows(spark.range(2), path)
    assert Counter(r.operation for r in H.history(spark, path).collect()) == {"append": 6, "replace": 1}


def test_a_writer_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    H.append_rows(spark.range(3), path)

    def dead(*args, **kw):
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):  # before its data
        H.update(spark, path, dead)
    with monkeypatch.context() as m:
        m.setattr(H, "put_commit", dead)  # after its data, before its commit
        with pytest.raises(RuntimeError):
            H.append_rows(spark.range(5), path)
    (tmp_path / "t/commits/.half").write_text('{"version": ')  # within its commit
    assert H.read_snapshot(spark, path).count() == 3 and H.append_rows(spark.range(2), path) == 1 and H.read_snapshot(spark, path).count() == 5
    with pytest.raises(FileNotFoundError):
        H.read_snapshot(spark, str(tmp_path / "none"))


def test_rounds_are_committed_and_archived(spark, tmp_path):
    path, ts = str(tmp_path / "lineage"), F.to_timestamp(F.lit("2026-01-01"))
    add = lambda name, kind="incremental": R.commit_version(spark, path, name, kind, "h", None, True, ts)
    add("a", "full"), add("b", "full"), add("a")
    assert {(r.dataset, r.version, r.parent_version) for r in H.read_snapshot(spark, path).collect()} == {("a", 0, None), ("b", 0, None), ("a", 1, 0)}
    with pytest.raises(ValueError, match="must be confirmed"):
        R.archive_rounds(spark, path, "a")
    R.archive_rounds(spark, path, "b")  # no later rounds: may be rebuilt
    at = R.archive_rounds(spark, path, "a", confirmed=True)
    add("a", "full")
    assert [(r.dataset, r.version) for r in H.read_snapshot(spark, path).collect()] == [("a", 0)]
    assert H.read_snapshot(spark, path, at - 1).count() == 2
    guard = spark.createDataFrame([("x", "full"), ("y", "full"), ("y", "incremental")], "dataset string, type string")
    assert {r.dataset: r.may_rebuild for r in R.rebuild_guard(guard).collect()} == {"x": True, "y": False}


def test_only_unseen_rows_make_a_fair_hold_out(spark):
    draw = random.Random(8)
    parents = {0: None, 1: 0, 2: 1, 3: 1, 4: 3}
    ids = lambda: draw.choice([draw.randint(-70_000, 70_000), draw.randint(0, 50), 10**15 + draw.randint(0, 9)])
    trained = [(d, v, ids()) for d in "ab" for v in parents for _ in range(60)] + [("a", 0, None), ("a", 0, 7), ("a", 0, 7)]
    lin = spark.createDataFrame([(d, v, p) for d in "ab" for v, p in parents.items()], "dataset string, version int, parent_version int")
    heads = spark.createDataFrame([("a", 4), ("b", 2)], "dataset string, version int")
    seen = R.seen_by(R.membership(spark.createDataFrame(trained, "dataset string, version int, id long"), "id"), lin, heads)
    of = {"a": {0, 1, 3, 4}, "b": {0, 1, 2}}
    held = [(d, i) for d, _, i in trained] + [(d, ids()) for d in "ab" for _ in range(100)] + [("c", 7)]
    df = spark.createDataFrame(held, "dataset string, id long")
    want = Counter((d, i) for d, i in held if i is not None and not any(t == d and v in of.get(d, ()) and x == i for t, v, x in trained))
    assert Counter(tuple(r) for r in R.fair_holdout(df, "id", seen).collect()) == want
    with pytest.raises(ValueError, match="were trained on"):
        R.require_fair(df, "id", seen)
    fair = R.fair_holdout(df, "id", seen)
    assert R.require_fair(fair, "id", seen).count() == sum(want.values())


def test_the_store_embeds_what_it_lacks(spark, tmp_path):
    path, calls = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    def embed(keys):
        calls.add(len(keys))
        if "bad" in keys:
            raise RuntimeError("cannot")
        return np.array([[len(k), 1.0] for k in keys], dtype=np.float32)

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    Q.create_store(spark, path, buckets=4, blocks=2, model="m", pooling="mean")
    with pytest.raises(ValueError, match="differs"):
        Q.update_vectors(keys("a"), "k", path, embed, model="other")
    assert Q.update_vectors(keys("a", "bb", "bad", "x" * 50, None, "a"), "k", path, embed, 10, model="m") == {"ok": 2, "skip_permanent": 1, "retry": 1}
    assert Q.update_vectors(keys("a", "bb", "x" * 50), "k", path, embed, 10, model="m") == {"ok": 0, "skip_permanent": 0, "retry": 0}
    before = calls.value
    again = Q.update_vectors(keys("a", "ccc", "bad"), "k", path, lambda k: np.ones((len(k), 2), np.float32), 10, pooling="mean")
    assert again == {"ok": 2, "skip_permanent": 0, "retry": 0} and calls.value == before
    rows = {r.key: (r.status, r["round"], r.vector) for r in Q.read_vectors(spark, path).collect()}
    assert len(rows) == Q.read_vectors(spark, path).count() == 5
    assert rows["a"] == ("ok", 1, [1.0, 1.0]) and rows["bad"][:2] == ("ok", 2) and rows["x" * 50][0] == "skip_permanent"
    many = keys(*[f"k{i}" for i in range(3000)])
    asked = Q.maybe_known(many.withColumnRenamed("k", "key").union(spark.createDataFrame([("a",)], "key string")), Q.filter_of(keys("a", "bb").withColumnRenamed("k", "key"), 2), 2)
    assert asked.where("known and key = 'a'").count() == 1 and asked.where("known").count() < 20


def test_a_hook_costs_few_calls_for_a_bad_value(spark):
    from curatrix.operators import cleaning as C

    calls = []

    def fn(values):
        calls.append(len(values))
        return [10 // v for v in values]

    values = [1] * 1000
    values[137] = 0
    out, errors = C.bisected(fn, values)
    assert [i for i, e in enumerate(errors) if e] == [137] and out[137] is None and set(out) == {10, None} and len(calls) < 25
    assert C.bisected(fn, []) == ([], []) and C.bisected(lambda v: v[1:], [1, 2])[0] == [None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 0, None, 2, 0, 3])], "id long, v int").repartition(1)
    got = {r.id: (r.k.value, r.k.error) for r in df.select("id", C.hook(lambda v: [10 // int(x) for x in v], "long")("v").alias("k")).collect()}
    assert got[0] == (2, None) and got[2] == (None, None) and got[3] == (5, None) and got[1][0] is None and got[4][1].startswith("ZeroDivisionError")


def test_profiles_merge_in_any_order(spark):
    from curatrix.operators import profiling as A

    draw = random.Random(2)
    rows = [(i, draw.gauss(0, 1) if i % 50 else None, i % 97) for i in range(8000)]
    df = spark.createDataFrame(rows, "i int, x double, k int")
    parts = [A.profile_sketches(df.where(F.col("i") % 3 == p), ["x", "k"]) for p in range(3)]
    a, b = (A.read_profile(A.merge_profiles(*p), [0.1, 0.5]).orderBy("column").collect() for p in (parts, [A.merge_profiles(parts[2], parts[0]), parts[1]]))
    xs = sorted(x for _, x, _ in rows if x is not None)
    for got in (a, b):
        k, x = got
        assert (k.n, k.n_null, k.lo, k.hi, k.n_distinct) == (8000, 0, 0.0, 96.0, 97) and (x.n, x.n_null, x.lo, x.hi) == (8000, 160, xs[0], xs[-1])
        assert abs(x.n_distinct - len(set(xs))) < 0.07 * len(xs)
        assert abs(np.searchsorted(xs, x.q50) / len(xs) - 0.5) < 0.03 and abs(np.searchsorted(xs, x.q10) / len(xs) - 0.1) < 0.03
    assert [r.n_distinct for r in a] == [r.n_distinct for r in b]


def test_an_update_moves_its_keys_few_times(spark, tmp_path):
    """New keys are shuffled and written a few times, keys that are done not at all: their digests move."""
    path = str(tmp_path / "store")
    Q.create_store(spark, path, buckets=4, blocks=2, model="m")
    draw = np.random.default_rng(5)
    words = ["".join(chr(33 + c) for c in draw.integers(0, 90, 2000)) for _ in range(600)]
    df = spark.createDataFrame([(w,) for w in words * 2], "k string")
    embed = lambda k: np.ones((len(k), 2), np.float32)

    def moved() -> int:
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))

    before = moved()
    assert Q.update_vectors(df, "k", path, embed, model="m")["ok"] == 600
    first = moved() - before
    assert Q.update_vectors(df, "k", path, embed, model="m")["ok"] == 0
    again = moved() - before - first
    assert Q.pending_keys(df, "k", path).count() == 0
    size = sum(map(len, words))
    assert first < 9 * size and again < size
    assert Counter(r.key for r in Q.read_vectors(spark, path).collect()) == Counter(words)
