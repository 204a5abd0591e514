"""The published cases of the status cascade and of both duplicate policies."""

import pytest

from curatrix.operators import cleaning as C
from curatrix.operators import dedup as W
from curatrix.operators import joins as J
from curatrix.plans import curation

CASES = [
    ("c1ccccc1", "clean", "c1ccccc1"),
    ("CC(=O)Oc1ccccc1C(=O)O", "clean", None),
    ("CCN.Cl", "salt_removed", "CCN"),
    ("CCN.CCO", "salt_removed", "CCN"),
    ("O.O.CCN", "salt_removed", "CCN"),
    ("CC(=O)O", "clean", None),
    ("OC(=O)CC(O)(CC(=O)O)C(=O)O", "clean", None),
    ("OC(=O)CCC(=O)O", "clean", None),
    ("OC(=O)C=CC(=O)O", "clean", None),
    ("OC(=O)C(O)C(O)C(=O)O", "clean", None),
    ("OC=O", "clean", None),
    ("OC(=O)C(F)(F)F", "clean", None),
    ("CCN.CC(=O)O", "mixture", None),
    ("CCN.CS(=O)(=O)O", "salt_removed", "CCN"),
    ("CCN.OC(=O)C(=O)O", "salt_removed", "CCN"),
    ("CC[NH3+].[Cl-]", "salt_removed", "CC[NH3+]"),
    ("CCO", "clean", "CCO"),
    ("CCN.c1ccccc1O", "mixture", None),
    ("[Na+].CC(=O)[O-]", "metal_complex", None),
    ("[Na+].[Cl-]", "metal_complex", None),
    ("[Fe+2].CC(=O)[O-].CC(=O)[O-]", "metal_complex", None),
    ("OS(=O)(=O)O", "no_parent", None),
    ("[NH4+]", "no_parent", None),
    ("O", "no_parent", None),
    ("not_real_smiles!!", "invalid_smiles", None),
    ("", "invalid_smiles", None),
    (None, "invalid_smiles", None),
    ("CCN.[He]", "ambiguous_fragment", None),
    ("N#N", "ambiguous_fragment", None),
    ("CCN.CCN", "clean", "CCN"),
    ("CCN.CCN.Cl", "salt_removed", "CCN"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "row_id long, value string")
    return {r.row_id: r for r in C.classify_records(df, "row_id", "value", C.dictionary(spark)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_status(verdicts, i):
    value, status, clean = CASES[i]
    assert verdicts[i].status == status, value
    if clean:
        assert verdicts[i].value_clean == clean


def test_component_strings_keep_their_order(verdicts):
    mixture = verdicts[17]
    assert (mixture.retained, mixture.removed, mixture.num_fragments) == ("CCN.c1ccccc1O", "", 2)
    assert verdicts[4].removed == "O.O" and verdicts[4].num_removed == 2
    assert verdicts[20].retained == "CC(=O)[O-].CC(=O)[O-].[Fe+2]"


def test_marks_are_null_not_zero_where_unresolved(spark):
    df = spark.createDataFrame([(0, "C[C@H](N)C(=O)O"), (1, "CCN"), (2, "[Na+].[Cl-]")], "row_id long, value string")
    got = {r.row_id: r.n_marks for r in C.classify_records(df, "row_id", "value", C.dictionary(spark)).collect()}
    assert got == {0: 1, 1: 0, 2: None}


def test_report_counts_marks(spark, tmp_path):
    rows = [(0, "a text with [C@H] in it"), (1, "another text"), (2, "[x@y]\n[z@] and two"), (3, "[C@H] of 3 is blocked")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = curation.curation_report(spark, str(tmp_path)).first()
    assert (got.total_records, got.n_clean, got.n_mixture, got.n_metal_complex, got.rows_with_marks) == (4, 2, 1, 1, 1)


def test_recovery(spark):
    rows = [(0, "[Na+].CC(=O)[O-]"), (1, "[Ca+2].CC(=O)[O-].CC(=O)[O-]"), (2, "[Na+].CCN.c1ccccc1"), (3, "C[Zn]C.CCN"), (4, "[Na+].[Cl-]"), (5, "[Na+].[He].CCN")]
    got = {r.row_id: r for r in C.classify_blocked(spark.createDataFrame(rows, "row_id long, value string"), "row_id", "value", C.dictionary(spark)).collect()}
    assert [got[i].recommendation for i in range(6)] == ["auto_recoverable"] * 2 + ["needs_manual_review"] * 4
    assert got[1].recovered_value == "CC(=O)[O-]" and got[0].reason == "removed: Na"
    clean = spark.createDataFrame([(9, "CCO")], "row_id long, value string")
    review = spark.createDataFrame(rows, "row_id long, value string")
    recovery = spark.createDataFrame([tuple(r) for r in got.values()], "row_id long, recommendation string, recovered_value string, reason string")
    once = J.merge_recovered(clean, review, recovery, "row_id", "value")
    twice = J.merge_recovered(*once, recovery, "row_id", "value")
    for c, r in (once, twice):
        assert sorted(x.row_id for x in c.collect()) == [0, 1, 9] and sorted(x.row_id for x in r.collect()) == [2, 3, 4, 5]


RECORDS = [(0, "k1", 1), (1, "k1", 1), (2, "k2", 1), (3, "k2", 0), (4, "k3", None), (5, "k3", None), (6, None, 1), (7, "k4", 0)]


def test_policy_a(spark):
    df = spark.createDataFrame([(*r, "clean") for r in RECORDS], "row_id long, key string, y int, status string")
    got = {r.row_id: r for r in W.resolve_duplicates_a(df, "row_id", "key", "y").collect()}
    assert [got[i].status for i in range(8)] == ["clean", "duplicate", "duplicate", "duplicate", "clean", "duplicate", "clean", "clean"]
    assert [got[i].duplicate_group_id for i in range(8)] == [0, 0, 1, 1, 2, 2, None, None]
    assert got[1].duplicate_reason == "duplicate of row 0" and "conflicting" in got[3].duplicate_reason
    bare = {r.row_id: r.status for r in W.resolve_duplicates_a(df, "row_id", "key").collect()}
    assert [bare[i] for i in range(8)] == ["duplicate"] * 6 + ["clean"] * 2


def test_policy_b(spark):
    df = spark.createDataFrame([(0, "k1", 0), (1, "k1", 0), (2, "k1", 1), (3, "k2", 0), (4, "k2", 0), (5, "k3", None), (6, "k3", 7)], "row_id long, key string, y int")
    model, conflicts, review = ([r.row_id for r in t.orderBy("row_id").collect()] for t in W.build_model_ready(df, "row_id", "key", "y"))
    assert (model, conflicts, review) == ([3], [0, 1, 2], [5, 6])


def test_bad_rows_do_not_stop_a_batch(spark):
    def embed(batch):
        return batch.assign(x=[1.0 / v for v in batch["v"]])[["row_id", "x"]]

    df = spark.createDataFrame([(0, 1), (1, 0), (2, 4)], "row_id long, v long")
    schema = "row_id long, x double"
    got = {r.row_id: r for r in df.mapInPandas(C.guarded(embed, schema), schema + ", ok boolean, error string").collect()}
    assert got[0].x == 1.0 and got[2].ok and not got[1].ok and "ZeroDivision" in got[1].error
