"""Sources, sinks, splits, metrics, lineage and streams on small tables."""

import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions import scalars as S
from curatrix.operators import boosting as B
from curatrix.operators import calibration as L
from curatrix.operators import dedup as W
from curatrix.operators import features as X
from curatrix.operators import joins as J
from curatrix.operators import learning as N
from curatrix.operators import lineage as R
from curatrix.operators import metrics as M
from curatrix.operators import profiling as A
from curatrix.operators import record_qc as V
from curatrix.operators import splits as G
from curatrix.plans import evaluation
from curatrix.sources import tables as IO
from curatrix.streaming import increments


def test_sources_and_sinks(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    df = spark.createDataFrame([(1, 'a "q", x', "train"), (2, None, "test")], "id long, v string, split string")
    IO.write_table(df, at("csv"), "csv")
    back = IO.read_table(spark, at("csv"), "csv", "id long, v string, split string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    IO.write_split(df, at("split"))
    assert [r.id for r in spark.read.parquet(at("split")).where("split = 'test'").collect()] == [2]
    assert not IO.write_if_any(df.limit(0), at("none")) and IO.write_if_any(df, at("some"))
    IO.replace_table(IO.read_table(spark, at("some")).where("id = 1"), at("some"))
    assert IO.read_table(spark, at("some")).count() == 1
    IO.write_report(df.limit(1), at("report"))
    assert '"split":' in spark.read.text(at("report")).first()[0]
    for _ in range(2):
        IO.append_registry(df, at("log"))
    assert IO.read_registry(spark, at("log"), "id long, v string").count() == 4
    nested = spark.createDataFrame([(1, [[1.0, 2.0]])], "id long, p array<array<double>>")
    IO.write_nested(nested, at("nested"))
    assert IO.read_table(spark, at("nested")).first().p == [[1.0, 2.0]]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.json").write_text('{"auc": 0.5,\n "name": "x"}')
    (tmp_path / "docs/b.json").write_text('{"auc": broken')
    schema = T.StructType([T.StructField("auc", T.DoubleType()), T.StructField("name", T.StringType())])
    good, bad = IO.read_json_docs(spark, at("docs"), schema)
    assert [r.auc for r in good.collect()] == [0.5] and [r.file_name for r in bad.collect()] == ["b.json"]
    assert IO.read_many(spark, at("docs"), "a*", "text").first().file_name == "a.json"
    (tmp_path / "r.sdf").write_text("one\n$$$$\n \n$$$$\nthree\n$$$$\n")
    got = IO.label_by_position(IO.read_records(spark, at("r.sdf")), 2).orderBy("position").collect()
    assert [(r.position, r.label) for r in got] == [(0, 1), (2, 0)]
    assert IO.pick_partition(df, "split", "train").first().id == 1 and IO.pick_partition(df, "split", "dev").first().id == 2


def greedy(sizes, n, fracs=(0.8, 0.1, 0.1)):
    left, out = [int(fracs[0] * n), int(fracs[1] * n)], []
    for s in sorted(sizes, reverse=True):
        k = 0 if s <= left[0] else 1 if s <= left[1] else 2
        if k < 2:
            left[k] -= s
        out.append((s, k))
    return out


def test_group_packing_is_the_greedy_loop(spark):
    draw = random.Random(1)
    for _ in range(2000):
        sizes = [draw.randint(1, 12) for _ in range(draw.randint(1, 40))]
        histogram = [(s, sizes.count(s)) for s in set(sizes)]
        placed = greedy(sizes, sum(sizes))
        for s, a, b in G.pack_sizes(histogram, sum(sizes)):
            assert (a, b) == (placed.count((s, 0)), placed.count((s, 1)))
    rows = [(i, f"g{i // 2}") for i in range(40)] + [(100 + i, f"s{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, grp string")
    one, same, other = (sorted((r.row_id, r.split) for r in G.group_split(df, "grp", seed=s).collect()) for s in (42, 42, 99))
    assert one == same and one != other and len(one) == 70
    J.assert_no_group_leakage(G.group_split(df, "grp"), "grp", "split")
    with pytest.raises(ValueError):
        J.assert_no_group_leakage(df.withColumn("split", F.when(F.col("row_id") % 2 == 0, "a").otherwise("b")), "grp", "split")


def test_oversampling_and_guards(spark):
    df = spark.createDataFrame([(i, int(i < 4)) for i in range(24)], "row_id long, y int")
    got = G.oversample(df, "y", F.col("row_id")).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {0: 20, 1: 20}
    assert G.oversample(df.where("y = 0"), "y", F.col("row_id")).count() == 20
    assert G.holdout_guard(df.where("y = 0"), "y", 0.2).first().reason == "single class"
    folds = G.stratified_folds(df, "y", 4, F.col("row_id")).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r.y == 1} == {1} and {r["count"] for r in folds if r.y == 0} == {5}
    with pytest.raises(ValueError):
        G.require_splits(df.withColumn("split", F.lit("train")), ["train", "test"])


def test_ranking_metrics_by_definition(spark):
    draw = random.Random(4)
    rows = [(i, round(draw.random(), 1), draw.randint(0, 1)) for i in range(300)] + [(999, None, 1)]
    df = spark.createDataFrame(rows, "row_id long, s double, y int")
    pos, neg = [s for _, s, y in rows if y == 1 and s is not None], [s for _, s, y in rows if y == 0]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    ap, seen = 0.0, 0
    for t in sorted({s for _, s, _ in rows if s is not None}, reverse=True):
        p, n = sum(x >= t for x in pos), sum(x >= t for x in neg)
        ap, seen = ap + (p - seen) / len(pos) * p / (p + n), p
    got = M.ranking(df, "s", "y").first()
    assert got.auc == pytest.approx(auc, abs=1e-12) and got.ap == pytest.approx(ap, abs=1e-12)
    alone = M.ranking(df.where("y = 1"), "s", "y").first()
    assert alone.auc is None and alone.ap is None
    ones = spark.createDataFrame([(1.0, 0), (1.0, 1), (0.05, 0)], "s double, y int")
    assert M.ece(ones, "s", "y").first().ece == pytest.approx(0.05 / 3)
    assert M.ece(ones, "s", "y", closed_last=True).first().ece == pytest.approx((0.05 + 2 * 0.5) / 3)


def test_ranking_of_skewed_scores_by_group(spark):
    """Scores that all lie close together spread over ranges as others do; a null group is a group, ranges may hold several."""
    draw = random.Random(9)
    rows = [(g, 0.5 + draw.randint(0, 40) * 1e-9, draw.randint(0, 1)) for g in ("a", "b", None) for _ in range(120)] + [("c", 1e-12, 1), ("c", 2e-12, 0), ("d", -3.0, 0), ("d", 7.0, 1)]
    got = {r.g: r.auc for r in M.ranking(spark.createDataFrame(rows, "g string, s double, y int"), "s", "y", ["g"]).collect()}
    for g in ("a", "b", "c", "d", None):
        pos, neg = ([s for h, s, y in rows if h == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg), abs=1e-12)
    hist = M.histogram(spark.createDataFrame([(0.9 + i * 1e-7, i % 2) for i in range(2000)], "s double, y int"), "s", "y")
    assert max(r["count"] for r in hist.repartitionByRange(4, F.desc("s")).groupBy(F.spark_partition_id()).count().collect()) < 1000
    assert M.ranking(spark.createDataFrame([], "s double, y int"), "s", "y").first().auc is None


def test_fingerprints_fold_by_digest(spark):
    import hashlib

    texts = ["one two three four", "one two", "", None, "a b c a b c"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.fingerprint(F.col("t"), 16).alias("bits")).collect()
    for i, bits in got:
        w = (texts[i] or "").split()
        shingles = {" ".join(w[j : j + 3]) for j in range(max(len(w) - 2, 1))} if w else set()
        assert bits == sorted({int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 16 for s in shingles})


def test_conformal_and_isotonic(spark):
    draw = random.Random(6)
    cal = [(i, round(draw.random(), 2), draw.randint(0, 1)) for i in range(200)]
    tests = [(i, round(draw.random(), 2)) for i in range(50)]
    known = L.nonconformity(spark.createDataFrame(cal, "row_id long, s double, y int"), "s", "y")
    got = {(r.row_id, r["class"]): r.p for r in L.conformal_pvalues(spark.createDataFrame(tests, "row_id long, s double"), "row_id", "s", known).collect()}
    for i, s in tests:
        for c in (0, 1):
            nc = [1 - p if y else p for _, p, y in cal if y == c]
            assert got[i, c] == pytest.approx((1 + sum(x >= (1 - s if c else s) for x in nc)) / (len(nc) + 1))
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.3, 1), (0.4, 0), (0.8, 1)], "s double, y int")
    fitted = L.apply_isotonic(L.fit_isotonic(df, "s", "y"), spark.createDataFrame([(0.0,), (0.35,), (0.9,), (None,)], "s double"), "s")
    assert [r.calibrated for r in fitted.collect()] == [0.0, 0.5, 1.0, None]


def test_bits_round_trip(spark):
    draw = np.random.default_rng(3)
    rows = [(i, sorted(draw.choice(2048, n, replace=False).tolist())) for i, n in enumerate((0, 1, 40, 2048))]
    df = spark.createDataFrame(rows, "id long, bits array<int>").withColumns({"p": X.pack_bits(F.col("bits")), "q": X.pack_bits_fast("bits")})
    for r in df.withColumns({"b": X.unpack_bits(F.col("p")), "c": X.unpack_bits_fast("q")}).collect():
        dense = np.zeros(2048, np.uint8)
        dense[r.bits] = 1
        assert bytes(r.p) == bytes(r.q) == np.packbits(dense).tobytes() and r.b == r.c == r.bits


def test_incremental_vectors(spark, tmp_path):
    def embed(keys):
        if any(k == "bad" for k in keys):
            raise RuntimeError("cannot")
        return np.array([[len(k), 1.0] for k in keys], dtype=np.float32)

    df = spark.createDataFrame([("a",), ("bb",), ("bad",), ("x" * 50,), (None,), ("a",)], "k string")
    store, none = spark.createDataFrame([("bb",)], "key string"), spark.createDataFrame([], "key string")
    got = {r.key[:3]: r.status for r in X.embed_pending(df, "k", store, none, embed, most=10).collect()}
    assert got == {"a": "ok", "bad": "retry", "xxx": "skip_permanent"}
    with pytest.raises(ValueError):
        X.check_compatible(spark.createDataFrame([("model", "v1")], "key string, value string"), model="v2")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("k string").parquet(str(tmp_path / "in"))
        increments.keep_vectors(stream, "k", str(tmp_path / "store"), str(tmp_path / "cp"), embed, 10).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "store")).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in kept} == {"ok": 2, "retry": 1, "skip_permanent": 1}


def test_increments_arrive_once(spark, tmp_path):
    ts = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([(1, 0, ts), (1, 0, ts), (2, 1, ts)], "row_id long, y int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, y int, ts timestamp").parquet(str(tmp_path / "in"))
    increments.accept_increments(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "row_id", "ts").awaitTermination()
    assert sorted(r.row_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_lineage(spark):
    rows = [("d", v, v - 1 if v else None, "full" if v == 0 else "incremental", f"h{v}", 0.5, True, None) for v in range(10)]
    lin = spark.createDataFrame(rows, "dataset string, version int, parent_version int, type string, model_hash string, held_out_auc double, promoted boolean, ts timestamp")
    got = {(r.version, r.ancestor): r.depth for r in R.ancestry(lin).collect()}
    assert len(got) == 45 and all(d == v - a for (v, a), d in got.items())
    nxt = R.append_version(lin, "d", "incremental", "h", 0.6, True, F.current_timestamp()).first()
    assert (nxt.version, nxt.parent_version) == (10, 9)
    assert R.append_version(lin, "new", "full", "h", None, False, F.current_timestamp()).first().version == 0
    gate = spark.createDataFrame([("a", 0.8, 0.8), ("b", 0.7, 0.8), ("c", None, 0.8)], "dataset string, candidate_auc double, baseline_auc double")
    assert [r.decision for r in R.promote(gate).orderBy("dataset").collect()] == ["promoted", "rejected", "rejected"]
    assert R.table_hash(lin, ["version"]).first() == R.table_hash(lin.orderBy(F.desc("version")), ["version"]).first()


def test_lineage_queries_take_all_events(spark, tmp_path):
    draw = random.Random(5)
    start = datetime.datetime(2026, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=draw.randint(0, 600)), draw.randint(1, 2), draw.choice(["click", "view"]), draw.random()) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    run = lambda f: f(spark, str(tmp_path)).collect()

    def chains(key):
        out = {}
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            out.setdefault(key(r), []).append(r[0])
        return out

    types = chains(lambda r: r[3])
    top = {k: (len(v) - 1, hashlib.sha256(str(v[-1]).encode()).hexdigest()) for k, v in types.items()}
    assert {r.dataset: (r.version, r.model_hash) for r in run(evaluation.latest_version)} == top
    assert {r.dataset: (r.n_later, r.may_rebuild) for r in run(evaluation.rebuild_guard)} == {k: (sum(i % 4 > 0 for i in range(len(v))), False) for k, v in types.items()}
    assert {tuple(r) for r in run(evaluation.verify_parent)} == {("click", top["click"][0], False), ("view", top["view"][0], True)}
    assert [tuple(r) for r in run(evaluation.next_version)] == [("view", len(types["view"]), top["view"][0], "incremental")]
    want = set()
    for key, events in chains(lambda r: f"{r[3]}-{r[2]}").items():
        for v in range(1, len(events)):
            a, depth = v, 0
            while a:
                a, depth = a - 1 - (a - 1) % 2, depth + 1
                want.add((key, v, a, depth))
    got = [tuple(r) for r in run(evaluation.lineage_ancestry)]
    assert len(got) == len(want) and set(got) == want and max(r[1] for r in got) > 60


def test_record_checks(spark):
    far = [[0.0, 0.0, 0.0], [1.4, 0.0, 0.0]]
    rows = [(0, ["C", "C"], far), (1, ["C"], far), (2, [], []), (3, ["C", "C"], [[0.0] * 3, [9.0, 0.0, 0.0]]), (4, ["C", "C"], [[0.0] * 3, [40.0, 0.0, 0.0]]), (5, ["C"], [[float("nan"), 0.0, 0.0]])]
    df = spark.createDataFrame(rows, "row_id long, atoms array<string>, points array<array<double>>")
    got = {r.row_id: r.issue for r in V.qc_records(df, "row_id", "atoms", "points", {"C": 0.76}).collect()}
    assert got == {0: None, 1: "length mismatch", 2: "empty", 3: "disconnected", 4: "exploded", 5: "non-finite"}


def test_labels_and_nulls(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("true",), ("1.5",), ("x",), (None,)], "v string").select(S.coerce_label(F.col("v")).alias("c")).select("c.*")
    assert [(r.label, r.ok) for r in df.collect()] == [(1, True), (1, True), (1, True), (None, False), (None, False), (None, True)]
    rows = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (3.0, 4.0)], "a double, b double")
    filled, stats = A.fill_features(rows, ["a", "b"])
    assert stats.first()[:] == (2, 2) and filled.where("isnan(a) or b is null").isEmpty()
    with pytest.raises(ValueError):
        A.validate_binary(spark.createDataFrame([(0,), (2,)], "y int"), "y")
    with pytest.raises(ValueError):
        N.guard_classes(spark.createDataFrame([(1,)], "y int"), "y")
    with pytest.raises(ValueError):
        B.refit_boosted(rows, ["a"], "b", B.Run(B.Ensemble(("a",), ((),)), [], None))
    assert N.trial_table({"x": [1, 2, 3]}, {"x": 2}, 2)[0] == {"x": 2}


def test_numbers_of_sparse_ids(spark):
    ids = [7 * 10**14, -(10**15), 3, 10**18, 12, 0]
    groups = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(ids)], "key string, first_row long")
    got = {r.first_row: r.duplicate_group_id for r in W.number_groups(groups).collect()}
    assert [got[v] for v in sorted(ids)] == list(range(len(ids)))
    assert W.number_groups(groups.limit(0)).count() == 0


def test_ordered_hash_of_several_levels(spark):
    """A third level follows once the chunks of a level exceed a chunk."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [sha(f"v{i}") for i in range(30)]
    while len(level) > 1:
        level = [sha(",".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    rows = spark.range(30).selectExpr("id", "concat('v', id) as v")
    assert R.ordered_hash(rows, rows["v"], "id", chunk=3).first().order_hash == level[0]
