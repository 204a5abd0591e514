"""The pipeline's stages: each takes effect, keeps clean rows and all columns."""

import pathlib
import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    draw = random.Random(8)
    prose = lambda: " ".join(f"word{draw.randint(0, 5000)}" for _ in range(draw.randint(70, 200)))
    rows = [(i, prose(), "en", f"s{i % 2}", 0) for i in range(300)]
    rows += [(400 + i, prose() + " vile rotten nasty", "en", "s0", 0) for i in range(60)]
    rows += [(500, "too short", "en", "s0", 0), (501, None, None, None, None)]
    copy = rows[0][1]
    rows += [(600 + i, copy + " end", "en", "s1", 0) for i in range(3)]
    labels = [(i, 1, int(400 <= i < 460)) for i in [*range(300), *range(400, 460)]]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{len(seen)}")
        docs = spark.read.parquet(f"{folder}/{len(seen)}")
        seen.append([r.doc_id for r in docs.collect()])
    clean, toxic = set(range(300)), set(range(400, 460))
    assert set(seen[0]) == clean | toxic | {600, 601, 602}
    assert set(seen[1]) == clean | {600, 601, 602}
    assert set(seen[2]) == clean and len(seen[2]) == 300
    counts = {i: seen[3].count(i) for i in clean}
    assert max(counts.values()) <= 2 and 1.3 * 300 < len(seen[3]) < 1.7 * 300
    last = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert sorted(r.doc_id for r in last) == sorted(seen[3])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(seen[3])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, `__score` string, n_words string"


def awkward(spark):
    """Rows with nulls, shared and null doc_ids, equal rows, a long text and columns whose names might clash."""
    draw = random.Random(2)
    prose = lambda n: " ".join(f"word{draw.randint(0, 5000)}" for _ in range(n))
    same = prose(80)
    rows = [(i, prose(draw.randint(60, 120)), "en", "s") for i in range(80)]
    rows += [(None, prose(70), None, None), (None, prose(70), "en", None), (7, prose(90), "de", "s"), (7, same, "en", "s"), (8, same, "en", "t"), (8, same, "en", "t"), (90, None, None, "s"), (91, "", "en", "s"), (92, prose(30_000), "en", "s")]
    rows += [(93, "###!!! " * 100 + prose(60).replace(" ", "### "), "en", "s")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in rows], SCHEMA)


def test_stages_take_awkward_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = awkward(spark)
    every = sorted(map(repr, docs.collect()))
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and set(map(repr, got.collect())) <= set(every)
        assert stage(spark, docs.limit(0), folder).count() == 0
    by_text = lambda rows: {(r.doc_id, r.text) for r in rows}
    kept = by_text(corpus_pipeline.quality(spark, docs, folder).collect())
    assert {(d, t) for d, t in by_text(docs.collect()) if t and len(t.split()) >= 50} - kept <= {(r.doc_id, r.text) for r in docs.where("doc_id in (92, 93)").collect()}  # 92 has 300 times its group's words
    assert not {d for d, t in kept if not t}
    one = corpus_pipeline.near_dedup(spark, docs, folder).collect()
    assert len(one) == docs.count() - 2 and sum(r.text == docs.where("doc_id = 8").first().text for r in one) == 1  # 7 has that text too
    last = corpus_pipeline.encoding(spark, docs, folder)
    assert last.count() == docs.count() and last.where("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.encoding(spark, docs.limit(0), folder).count() == 0


def test_toxic_rows_go_by_their_own_text(spark, tmp_path):
    """A toxic row that shares its doc_id with a clean one goes; the clean one stays."""
    draw = random.Random(3)
    prose = lambda: " ".join(f"word{draw.randint(0, 900)}" for _ in range(60))
    rows = [(i, prose() + (" vile rotten nasty" if i % 5 == 0 else "")) for i in range(300)] + [(1000, prose()), (1000, prose() + " vile nasty rotten")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.text for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).where("doc_id = 1000").collect()]
    assert got == [rows[300][1]]


def test_runs_side_by_side_keep_to_themselves(spark, tmp_path):
    """Two runs in one driver agree, and leave no table of a stage but the last one's."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    draw = random.Random(5)
    prose = lambda: " ".join(f"word{draw.randint(0, 5000)}" for _ in range(draw.randint(70, 200)))
    rows = [(i, prose(), "en", f"s{i % 3}", 0) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shared = spark.conf.get("spark.checkpoint.dir")
    stored = lambda: {p.name for p in pathlib.Path(shared, "curatrix").glob("*")}
    tables, before = len(spark.catalog.listTables()), stored()
    run = inheritable_thread_target(spark)(lambda _: [(r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()])
    with ThreadPoolExecutor(2) as threads:
        one, other = threads.map(run, range(2))
    assert sorted(one) == sorted(other) and len(one) > 60
    assert {n.rpartition("-")[0] for n in stored() - before} == {"chunks"} and len(spark.catalog.listTables()) == tables + 2


def test_mixing_takes_any_column_names(spark):
    names = ["__copies", "__doc_id", "own", "row", "copy", "a.b", "sid", "n"]
    docs = spark.createDataFrame([(i, "a b c d", "s", *range(len(names))) for i in range(20)], ["doc_id", "text", "source", *names])
    got = corpus_pipeline.mixing(spark, docs, "")
    assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))
