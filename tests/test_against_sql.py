"""Registered queries against their SQL, on small tables that tell right from wrong."""

import pathlib

import duckdb

from curatrix.operators import cleaning as C
from curatrix.operators import extensions as Z
from curatrix.operators import profiling as A
from curatrix.plans import evaluation, storage, tables  # noqa: F401  these register their queries
from curatrix.plans.catalog import ORACLE, QUERIES
from curatrix.sources import tables as IO


def both(spark, name: str, folder: pathlib.Path) -> tuple[list, list]:
    """Rows of a query and of its SQL, over the tables of a folder, files or folders of files."""
    db = duckdb.connect()
    for t in folder.glob("*.parquet"):
        db.sql(f"create view {t.stem} as select * from '{t}{'/*.parquet' if t.is_dir() else ''}'")
    got = QUERIES[name](spark, str(folder))
    told = db.sql(ORACLE[name]).select(*[f'"{c}"' for c in got.columns]).fetchall()
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, told))


def put(folder: pathlib.Path, name: str, sql: str) -> None:
    """A table of one file."""
    duckdb.connect().sql(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")


def test_copies_of_a_minority_are_whole_numbers(spark, tmp_path):
    """66 to 7: each of the 7 is copied three times, and five of them once more."""
    put(tmp_path, "documents", "select i as doc_id, 'a' as text, 'en' as lang, 's' as source, i % 13 as n_chars from range(73) t(i)")
    put(tmp_path, "labels", "select i as doc_id, (i % 10 = 3)::int as toxic, 0 as quality from range(73) t(i)")
    got, told = both(spark, "oversample_minority", tmp_path)
    assert got == told and len(got) == 73 + 26


def test_records_of_folders_in_order_whatever_their_files_names(spark, tmp_path):
    """Writers draw the names of files, so the folder comes first: here the names say the opposite."""
    for folder, name, records in (("a", "part-9.txt", ["a0", "a1", "a2"]), ("b", "part-1.txt", ["b0", "b1"])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text("".join(r + "$$$$\n" for r in records))
    got = IO.read_records(spark, str(tmp_path / "*")).orderBy("position").collect()
    assert [(r.position, r.record) for r in got] == list(enumerate(["a0", "a1", "a2", "b0", "b1"]))


def test_tables_by_pattern_whether_files_or_folders(spark, tmp_path):
    """A table in parts is one table; what else lies there isn't read."""
    at = tmp_path / "some tables+more"
    (at / "documents.parquet").mkdir(parents=True)
    for part in (0, 1):
        put(at / "documents.parquet", f"part-{part}", f"select i as doc_id, 'a' as text from range({part + 2}) t(i)")
    put(at, "labels", "select i as doc_id, 0 as toxic from range(3) t(i)")
    put(at, "others", "select i as doc_id from range(9) t(i)")
    got, told = both(spark, "files_by_pattern", at)
    assert got == told == ["('documents.parquet', 5)", "('labels.parquet', 3)"]


def test_similar_bits_by_class(spark, tmp_path):
    """Pairs and memberships, expanded, are what brute force finds; a class of 400 copies costs 399 rows, not 79,800."""
    from itertools import combinations
    from random import Random

    draw = Random(5)
    sets = {i: frozenset(draw.sample(range(24), draw.randint(0, 9))) for i in range(150)} | {i: frozenset({1, 2, 3}) for i in range(150, 550)}
    rows = spark.createDataFrame([(i, sorted(s, reverse=True)) for i, s in sets.items()], "k long, bits array<int>")
    for least in (0.3, 0.5, 1.0):
        got = [tuple(r) for r in Z.bit_similarity(rows, "k", "bits", least).collect()]
        home = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items() if s}
        between = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(set(home.values())), 2)}
        want = {(a, b, v) for (a, b), v in between.items() if v >= least} | {(a, i, 1.0) for i, a in home.items() if i != a}
        assert len(got) == len(want) and set(got) == want
    put(tmp_path, "documents", "select i * 4096 + j as doc_id from range(4) t(i), range(60) u(j)")
    got, told = both(spark, "bit_similarity", tmp_path)
    assert got == told and len([r for r in got if r.endswith("1.0)")]) >= 120


def test_similar_bits_of_every_two_rows(spark, tmp_path, monkeypatch):
    """Every pair that brute force finds, once, members of one class and of two, in few packs and in many; the query gives pairs of documents."""
    from itertools import combinations
    from random import Random

    draw = Random(6)
    sets = {i: frozenset(draw.sample(range(9), draw.randint(0, 5))) for i in range(120)} | {i: frozenset({1, 2, 3}) for i in range(120, 150)}
    rows = spark.createDataFrame([*((i, sorted(s)) for i, s in sets.items()), (None, [1, 2, 3]), (999, None)], "k long, bits array<int>")
    between = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b]}
    for pack, pairs in ((512, 4_000_000), (4, 100)):
        monkeypatch.setattr(Z, "PACK", pack)
        monkeypatch.setattr(Z, "TASK_PAIRS", pairs)
        for least in (0.3, 1.0):
            got = [tuple(r) for r in Z.bit_pairs(rows, "k", "bits", least).collect()]
            want = {(a, b, v) for (a, b), v in between.items() if v >= least}
            assert len(got) == len(want) and set(got) == want
    put(tmp_path, "documents", "select i * 4096 + j as doc_id from range(6) t(i), range(20) u(j)")
    got, told = both(spark, "bit_similarity", tmp_path)
    assert got == told and len([r for r in got if r.endswith(", 1.0)")]) >= 2 * 3 * 20  # three documents of each class


def test_parts_by_length_are_of_a_size(spark):
    """Few long texts, many short ones, a length that most rows have, and null: no part holds much more than asked for."""
    from collections import defaultdict

    texts = ["x" * (i % 50) for i in range(2000)] + [chr(97 + i % 26) * 100 for i in range(3000)] + ["y" * 2000] * 200 + [None] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = A.length_bucketed(df, "text", 8, 20_000).rdd.mapPartitionsWithIndex(lambda p, rows: ((p, r.doc_id, r.text) for r in rows)).collect()
    assert {i: t for _, i, t in got} == dict(enumerate(texts)) and len(got) == len(texts)
    parts = defaultdict(list)
    for p, _, t in got:
        parts[p].append(-1 if t is None else len(t))
    assert all(ns == sorted(ns) for ns in parts.values()) and max(sum(n + 16 for n in ns) for ns in parts.values()) < 50_000
    order = [parts[p] for p in sorted(parts)]
    assert all(a[-1] <= b[0] for a, b in zip(order, order[1:])) and len(order) > 30
    assert A.length_bucketed(df.limit(0), "text", 8).count() == 0


def test_texts_by_length_leave_out_null_and_empty_ones(spark, tmp_path):
    """A blank is a text, and so is a row without an id; nothing and null are none, as the SQL says."""
    put(tmp_path, "documents", "select * from (values (0, 'a'), (1, ''), (2, null), (3, ' '), (4, 'é'), (null, 'zz'), (6, 'a'), (6, 'a')) t(doc_id, text)")
    got, told = both(spark, "length_bucketed", tmp_path)
    assert got == told and len(got) == 6


def test_components_are_shuffled_by_record_only(spark):
    """No exchange deals a record's components by their text as well, which would move all texts twice."""
    import re

    df = spark.createDataFrame([(1, "C.O"), (2, "CC.CC"), (3, "CC.CCC"), (4, None)], "k long, v string")
    words = C.dictionary(spark)
    for got in (C.classify_records(df, "k", "v", words), C.classify_blocked(df, "k", "v", words)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(k#\d+L?, [^0-9]", plan)
    assert {r.k: r.status for r in C.classify_records(df, "k", "v", words).collect()} == {1: "salt_removed", 2: "clean", 3: "mixture", 4: "invalid_smiles"}
