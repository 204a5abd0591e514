"""Curation jobs, and queries over components, duplicates and joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import identity_key
from ..functions.session import cut
from ..operators import cleaning as C
from ..operators import dedup as W
from ..operators import joins as J
from ..operators import profiling as A
from .catalog import base, load, query, rounded


def curate(df: DataFrame, row_id: str, value: str, words: DataFrame, label: str | None = None, **rules) -> dict[str, DataFrame]:
    """The whole curation of raw records (C17): clean, review and report tables, which partition the input.

    Verdicts are written once: the groups of duplicates and the resolved rows both read them. ``resolved``, from which
    the three derive, is worth persisting. Labels play no part in cleaning.
    """
    verdicts = cut(C.classify_records(df, row_id, value, words, **rules))
    joined = C.with_raw(df, value).join(verdicts, row_id).withColumn("status_before", F.col("status"))
    resolved = W.resolve_duplicates_a(joined, row_id, "key", label)
    clean, review = C.split_by(resolved, F.col("status").isin(*C.ELIGIBLE))
    return {"resolved": resolved, "clean": clean, "review": review, "report": A.curation_report(resolved)}


# Lines of documents stand for components: a line of digits is blocked, a line with lower-case letters
# may be a parent, and lines that several documents share are removable beside others.


def _blocked(c: Column) -> Column:
    return c.rlike("[0-9]")


def _parent(c: Column) -> Column:
    return c.rlike("[a-z]")


def _free(c: Column) -> Column:
    return c.rlike("^[^ ]+$") | c.rlike("^[^ ]+ [^ ]+ [^ ]+$")


def _names(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))


RULES: dict[str, Callable | str | None] = {"blocked": _blocked, "parent": _parent, "valid": None, "delim": "\n"}

LINES = """parts as (select doc_id, pos - 1 as pos, component, len(list) as n from (select doc_id, list_filter(string_split(trim(text), chr(10)), lambda x: x <> '') as list from documents) s,
  lateral (select unnest(list) as component, unnest(generate_series(1, len(list))) as pos) u),
shared as (select component, count(distinct doc_id) as k from parts group by component),
words as (select component, 'protected' as kind from shared where k >= 3 and starts_with(component, 'Licensed')
  union all select component, case when k >= 6 then 'removable' else 'sibling_removable' end from shared where k >= 3 and not starts_with(component, 'Licensed') and not regexp_matches(component, '[0-9]')),
cats as (select p.*, case when regexp_matches(p.component, '[0-9]') then 'metal' when kind = 'protected' then 'parent' when kind = 'removable' then 'removable' when kind = 'sibling_removable' and n > 1 then 'removable'
  when regexp_matches(p.component, '[a-z]') then 'parent' else 'ambiguous' end as category from parts p left join words w on p.component = w.component)"""

STATUS = (
    LINES
    + """,
sums as (select doc_id, count(*) as n, count_if(category = 'metal') as metals, count_if(category = 'ambiguous') as unclear, count_if(category = 'parent') as parents, count_if(category = 'removable') as gone,
  count(distinct case when category = 'parent' then component end) as kinds, arg_min(component, pos) filter (category = 'parent') as first_parent,
  coalesce(string_agg(component, chr(10) order by pos) filter (category = 'removable'), '') as removed,
  coalesce(string_agg(component, chr(10) order by case category when 'parent' then 0 when 'ambiguous' then 1 else 2 end, pos) filter (category <> 'removable'), '') as kept from cats group by doc_id),
st as (select x.doc_id, case when s.n is null then 'invalid_smiles' when metals > 0 then 'metal_complex' when unclear > 0 then 'ambiguous_fragment' when parents = 0 then 'no_parent'
  when kinds = 1 and gone = 0 then 'clean' when kinds = 1 then 'salt_removed' else 'mixture' end as status, s.* exclude (doc_id) from documents x left join sums s on x.doc_id = s.doc_id)"""
)


def shared_lines(spark, d) -> DataFrame:
    """The dictionary of lines that at least three documents share; a table, so that its size is known to whoever joins it."""
    parts = C.components(load(spark, d, "documents"), "doc_id", "text", "\n").where("component is not null")
    # Lines travel and are counted as digests; only those that are shared travel as text.
    marked = parts.select("doc_id", F.unhex(F.sha2("component", 256)).alias("h"))
    shared = cut(marked.groupBy("h").agg(F.count_distinct("doc_id").alias("k")).where("k >= 3"))
    named = parts.select("component", F.unhex(F.sha2("component", 256)).alias("h")).join(shared, "h").groupBy("component").agg(F.min("k").alias("k"))
    shared = cut(named)
    protected = shared.where(F.col("component").startswith("Licensed"))
    rest = C.build_removable(shared, protected, _blocked).join(shared, "component")
    return cut(protected.select("component", F.lit("protected").alias("kind")).union(rest.select("component", F.when(F.col("k") >= 6, "removable").otherwise("sibling_removable"))))


@query("with " + LINES + " select doc_id, cast(pos as int) as pos, component, cast(n as int) as n from parts")
def component_explode(spark, d):
    return C.components(load(spark, d, "documents"), "doc_id", "text", "\n")


@query("with " + LINES + " select component, kind from words")
def removable_dictionary(spark, d):
    return shared_lines(spark, d)


@query("with " + LINES + " select category, count(*) as n, count(distinct doc_id) as n_docs from cats group by category")
def component_categories(spark, d):
    parts = C.components(load(spark, d, "documents"), "doc_id", "text", "\n")
    cats = C.categorize(parts, shared_lines(spark, d), _blocked, _parent)
    return cats.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("with " + STATUS + " select doc_id, status, case when status in ('clean', 'salt_removed') then first_parent end as value_clean, cast(coalesce(n, 0) as int) as num_fragments, cast(coalesce(gone, 0) as int) as num_removed, coalesce(removed, '') as removed,"
    " case when status in ('clean', 'salt_removed', 'no_parent') then '' else coalesce(kept, '') end as retained, case when status in ('clean', 'salt_removed') then sha256(trim(first_parent)) end as key,"
    " case status when 'invalid_smiles' then 'missing value' when 'metal_complex' then 'contains a blocked component; manual review' when 'ambiguous_fragment' then 'a component could not be classified with confidence'"
    " when 'no_parent' then 'no parent component remained' when 'mixture' then 'several distinct parent components remain' else '' end as reason,"
    r" cast(case when status in ('clean', 'salt_removed') then len(regexp_extract_all(first_parent, '\[[^\]]*@[^\]]*\]')) end as int) as n_marks from st")
def record_status(spark, d):
    return C.classify_records(load(spark, d, "documents"), "doc_id", "text", shared_lines(spark, d), **RULES)


@query("with " + LINES + " select doc_id, count(distinct component) = 1 as one_kind, count(*) as n from parts group by doc_id")
def identical_fold(spark, d):
    parts = C.components(load(spark, d, "documents"), "doc_id", "text", "\n")
    return parts.groupBy("doc_id").agg((F.count_distinct("component") == 1).alias("one_kind"), F.count("*").alias("n"))


@query("with " + STATUS + """, blocked as (select c.* from cats c join st on c.doc_id = st.doc_id where st.status = 'metal_complex'),
r as (select doc_id, count_if(category = 'ambiguous') as unclear, count(distinct case when category = 'parent' then component end) as kinds, arg_min(component, pos) filter (category = 'parent') as first_parent,
  count_if(category = 'metal' and not (regexp_matches(component, '^[^ ]+$') or regexp_matches(component, '^[^ ]+ [^ ]+ [^ ]+$'))) as bound,
  array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(component, '[0-9]+')) filter (category = 'metal')))), ',') as symbols from blocked group by doc_id)
select doc_id, case when unclear = 0 and kinds = 1 and bound = 0 then 'auto_recoverable' else 'needs_manual_review' end as recommendation, case when unclear = 0 and kinds = 1 and bound = 0 then first_parent end as recovered_value,
  case when unclear > 0 then 'also has an ambiguous component' when kinds = 0 then 'no parent component remained' when kinds > 1 then kinds || ' different parents' when bound > 0 then 'a blocked component is not a free ion' else 'removed: ' || symbols end as reason from r""")
def recovery_recommendation(spark, d):
    words = shared_lines(spark, d)
    docs = load(spark, d, "documents")
    verdicts = C.classify_records(docs, "doc_id", "text", words, **RULES)
    blocked = docs.join(verdicts.where("status = 'metal_complex'").select("doc_id"), "doc_id", "left_semi")
    return C.classify_blocked(blocked, "doc_id", "text", words, _blocked, _parent, _free, _names, "\n")


#: What both duplicate policies see: labels that conflict within some keys.
CONFLICT = "case when d.toxic is null then null when d.doc_id % 7 = 0 then 1 - d.toxic else d.toxic end"
GROUPS = "elig as (select doc_id, key, lab from e where n_chars >= 200), g as (select key, count(*) as n, min(doc_id) as first_row, count(distinct lab) as n_labels from elig group by key having count(*) >= 2), gn as (select *, row_number() over (order by first_row) - 1 as gid from g)"


def _records(spark, d) -> DataFrame:
    lab = F.when(F.col("toxic").isNull(), None).when(F.col("doc_id") % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    return base(spark, d).withColumn("lab", lab).withColumn("status", F.when(F.col("n_chars") >= 200, "clean").otherwise("no_parent"))


@query("with {BASE}, e as (select d.*, " + CONFLICT + " as lab from d), " + GROUPS + """ select e.doc_id, case when gid is not null and (n_labels > 1 or e.doc_id <> first_row) then 'duplicate' when n_chars >= 200 then 'clean' else 'no_parent' end as status, gid as duplicate_group_id,
case when gid is null then null when n_labels > 1 then 'duplicate with conflicting labels' when e.doc_id <> first_row then 'duplicate of row ' || first_row end as duplicate_reason from e left join gn on e.key = gn.key and e.n_chars >= 200""")
def dedup_policy_a(spark, d):
    return W.resolve_duplicates_a(_records(spark, d), "doc_id", "key", "lab").select("doc_id", "status", "duplicate_group_id", "duplicate_reason")


@query("with {BASE}, e as (select d.*, 0 as lab from d), " + GROUPS + " select e.doc_id, case when gid is not null then 'duplicate' when n_chars >= 200 then 'clean' else 'no_parent' end as status from e left join gn on e.key = gn.key and e.n_chars >= 200")
def dedup_policy_a_nolabel(spark, d):
    return W.resolve_duplicates_a(_records(spark, d), "doc_id", "key").select("doc_id", "status")


@query("with {BASE}, e as (select d.*, " + CONFLICT + " as lab from d), " + GROUPS + " select key, n, first_row, gid as duplicate_group_id from gn")
def dedup_group_ids(spark, d):
    groups = W.key_groups(_records(spark, d).where("n_chars >= 200"), "key", "doc_id", "lab")
    return W.number_groups(groups).select("key", "n", "first_row", "duplicate_group_id")


@query("with {BASE}, e as (select d.*, " + CONFLICT + " as lab from d), " + GROUPS + """ select count(*) as duplicate_groups, cast(sum(case when n_labels > 1 then n else n - 1 end) as bigint) as duplicate_rows_flagged, count_if(n_labels > 1) as conflicting_groups, cast(coalesce(sum(n) filter (n_labels > 1), 0) as bigint) as conflicting_rows from g""")
def dedup_stats(spark, d):
    return W.duplicate_stats(_records(spark, d), "doc_id", "key", "lab", F.col("n_chars") >= 200)


POLICY_B = "e as (select d.*, " + CONFLICT + " as lab from d), ok as (select * from e where lab in (0, 1)), g as (select key, min(doc_id) as first_row, count(distinct lab) as k from ok group by key)"


@query("with {BASE}, " + POLICY_B + " select ok.doc_id, ok.lab, ok.key from ok join g on ok.key = g.key where k = 1 and doc_id = first_row")
def model_ready(spark, d):
    return W.build_model_ready(_records(spark, d), "doc_id", "key", "lab")[0].select("doc_id", "lab", "key")


@query("with {BASE}, " + POLICY_B + " select ok.doc_id, ok.lab, ok.key from ok join g on ok.key = g.key where k > 1")
def label_conflicts(spark, d):
    return W.build_model_ready(_records(spark, d), "doc_id", "key", "lab")[1].select("doc_id", "lab", "key")


@query("with {BASE} select doc_id from d where toxic is null")
def label_review(spark, d):
    return W.build_model_ready(_records(spark, d), "doc_id", "key", "lab")[2].select("doc_id")


@query("with {BASE} select doc_id, count(*) over (partition by key) > 1 as is_duplicate from d")
def duplicate_flags(spark, d):
    return W.flag_duplicates(base(spark, d), "key").select("doc_id", "is_duplicate")


@query("with {BASE} select key, min(doc_id) as doc_id, arg_min(lang, doc_id) as lang from d group by key")
def first_by_key(spark, d):
    return W.distinct_first(base(spark, d).select("key", "doc_id", "lang"), "key", "doc_id")


@query("with {BASE} select count(*) - count(distinct toxic) - max((toxic is null)::int) as n_duplicates from d")
def dup_count(spark, d):
    return W.dup_count(base(spark, d), "toxic")


@query("with " + STATUS + ", names(status) as (values ('clean'), ('salt_removed'), ('mixture'), ('metal_complex'), ('ambiguous_fragment'), ('no_parent'), ('invalid_smiles'), ('duplicate')) select n.status, count(st.doc_id) as n from names n left join st on n.status = st.status group by n.status")
def status_counts_zero_filled(spark, d):
    return A.status_counts(C.classify_records(load(spark, d, "documents"), "doc_id", "text", shared_lines(spark, d), **RULES))


RESOLVED = STATUS + """, lab as (select st.*, l.toxic, sha256(trim(first_parent)) as key from st left join labels l on st.doc_id = l.doc_id),
g as (select key, min(doc_id) as first_row, count(*) as k, count(distinct toxic) as n_labels from lab where status in ('clean', 'salt_removed') group by key having count(*) >= 2),
res as (select lab.*, g.key as gkey, g.n_labels, case when g.key is not null and (g.n_labels > 1 or doc_id <> first_row) then 'duplicate' else status end as final from lab left join g on lab.key = g.key and status in ('clean', 'salt_removed'))"""


TOTALS = r""" count(*) as total_records, count_if(final <> 'invalid_smiles') as valid_records, count_if(final = 'clean') as n_clean, count_if(final = 'salt_removed') as n_salt_removed, count_if(final = 'mixture') as n_mixture,
 count_if(final = 'metal_complex') as n_metal_complex, count_if(final = 'ambiguous_fragment') as n_ambiguous_fragment, count_if(final = 'no_parent') as n_no_parent, count_if(final = 'invalid_smiles') as n_invalid_smiles, count_if(final = 'duplicate') as n_duplicate,
 count(distinct gkey) as duplicate_groups, count(distinct gkey) filter (n_labels > 1) as conflicting_groups, count_if(coalesce(n_labels > 1, false)) as conflicting_rows, count_if(final in ('clean', 'salt_removed') and len(regexp_extract_all(first_parent, '\[[^\]]*@[^\]]*\]')) > 0) as rows_with_marks,
 count_if(final in ('clean', 'salt_removed')) as records_retained, count_if(final not in ('clean', 'salt_removed')) as records_excluded"""


@query("with " + RESOLVED + " select" + TOTALS + " from res")
def curation_report(spark, d):
    rows = base(spark, d).select("doc_id", "text", "toxic")
    return curate(rows, "doc_id", "text", shared_lines(spark, d), "toxic", **RULES)["report"]


#: What a run of the report's query is about; a job adds its time, versions and content hashes.
ABOUT = {"input_file": "documents", "clean_output_file": "clean", "review_output_file": "review", "smiles_column": "text", "target_column": "toxic"}


def _counts_sql(column: str) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{s}":' || count_if({column} = '{s}')""" for s in C.STATUSES) + " || '}'"


@query("with " + RESOLVED + " select " + ", ".join(f"'{v}' as {k}" for k, v in ABOUT.items()) + "," + TOTALS + f", {_counts_sql('status')} as pre_duplicate_status_counts, {_counts_sql('final')} as final_status_counts, count_if(final = 'duplicate') as duplicates_flagged from res")
def curation_document(spark, d):
    rows = base(spark, d).select("doc_id", "text", "toxic")
    return A.report_document(curate(rows, "doc_id", "text", shared_lines(spark, d), "toxic", **RULES)["resolved"], ABOUT)


@query("with " + RESOLVED + " select status as status_before, final as status_after, count(*) as n from res group by 1, 2")
def status_moves(spark, d):
    rows = base(spark, d).select("doc_id", "text", "toxic")
    return A.status_moves(curate(rows, "doc_id", "text", shared_lines(spark, d), "toxic", **RULES)["resolved"], "status_before", "status")


#: Labels that conflict within some keys, as they hardly do by themselves.
CLASHING = RESOLVED.replace("l.toxic,", "case when l.toxic is null then null when st.doc_id % 7 = 0 then 1 - l.toxic else l.toxic end as toxic,")


def clashing_records(spark, d) -> dict[str, DataFrame]:
    lab = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    return curate(base(spark, d).select("doc_id", "text", lab.alias("toxic")), "doc_id", "text", shared_lines(spark, d), "toxic", **RULES)


@query("with " + CLASHING + """, e as (select res.final as status, res.n_labels > 1 as clash, x.doc_id, case when length(text) > 70 then substr(text, 1, 67) || '...' else text end as v, row_number() over (partition by res.final order by x.doc_id) as k from res join documents x on res.doc_id = x.doc_id)
select status, count(*) as n, count_if(clash) as n_conflicts, string_agg(v, ' / ' order by doc_id) filter (k <= 3) as examples from e group by status""")
def review_summary(spark, d):
    """Of resolved records, so that duplicates with conflicting labels count."""
    return A.review_summary(clashing_records(spark, d)["resolved"], "doc_id", "text", reason="duplicate_reason")


@query("with {BASE} select d.doc_id, len(e.embedding) as dim from d join embeddings e on d.doc_id = e.vec_id")
def attach_vectors(spark, d):
    store = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return J.attach_vectors(base(spark, d), store, "doc_id")[0].select("doc_id", F.size("vector").cast("long").alias("dim"))


@query("with {BASE} select distinct key from d where key not in (select sha256(trim(text)) from documents where doc_id % 3 = 0) and key not in (select sha256(trim(text)) from benchmark)")
def pending_work(spark, d):
    rows = base(spark, d)
    bench = load(spark, d, "benchmark").select(identity_key(F.col("text")).alias("key"))
    return J.pending(rows, "key", rows.where("doc_id % 3 = 0"), bench)


@query("with {BASE} select doc_id from d where text not in (select text from d where toxic = 1)")
def exclude_recovered(spark, d):
    rows = base(spark, d)
    return J.exclude(rows, rows.where("toxic = 1"), "text").select("doc_id")


@query("""with {BASE}, clean as (select doc_id, text from d where n_chars >= 1000), review as (select doc_id, text from d where n_chars < 1000), auto as (select doc_id, text || '!' as v from review where doc_id % 2 = 0)
select doc_id, length(text) as n, 'clean' as side from clean union all select a.doc_id, length(a.v), 'clean' from auto a union all select doc_id, length(text), 'review' from review where doc_id % 2 <> 0""")
def merge_recovered(spark, d):
    rows = base(spark, d).select("doc_id", "text", "n_chars")
    clean, review = rows.where("n_chars >= 1000").drop("n_chars"), rows.where("n_chars < 1000").drop("n_chars")
    recovery = review.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "auto_recoverable").otherwise("needs_manual_review").alias("recommendation"), F.concat("text", F.lit("!")).alias("recovered_value"))
    merged, left = J.merge_recovered(clean, review, recovery, "doc_id", "text")
    again, rest = J.merge_recovered(merged, left, recovery, "doc_id", "text")
    return again.withColumn("side", F.lit("clean")).union(rest.withColumn("side", F.lit("review"))).select("doc_id", F.length("text").cast("long").alias("n"), "side")


@query("with {BASE}, s as (select distinct key, case doc_id % 5 when 0 then 'test' when 1 then 'val' else 'train' end as split from d) select a.split as split_a, b.split as split_b, count(*) as n_keys from s a join s b on a.key = b.key and a.split < b.split group by 1, 2")
def split_key_overlap(spark, d):
    split = F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "val").otherwise("train")
    return J.leakage_report(base(spark, d).withColumn("split", split), "split", "key")


@query("with {BASE} select source, count(distinct lang) as n_splits from d group by source having count(distinct lang) > 1")
def group_leakage(spark, d):
    return J.group_leaks(base(spark, d), "source", "lang")


@query("with {BASE} select doc_id, coalesce(n.display_name, 'row ' || doc_id) as display_name from d left join (select key, arg_min(source, doc_id) as display_name from d where n_chars > 500 group by key) n on d.key = n.key")
def display_names(spark, d):
    rows = base(spark, d)
    return J.first_name(rows, rows.where("n_chars > 500"), "key", "source", "doc_id").select("doc_id", "display_name")


@query("with {BASE}, m as (select lang, avg(score) as auc from d group by lang) select m.lang, m.auc, r.ref, m.auc - r.ref as gap from m left join (values ('en', 0.92e0), ('de', 0.88e0), ('fr', 0.87e0)) r(lang, ref) on m.lang = r.lang")
@rounded("auc", "ref", "gap")
def market_gap(spark, d):
    market = spark.createDataFrame([("en", 0.92), ("de", 0.88), ("fr", 0.87)], "lang string, ref double")
    return J.gap_report(base(spark, d).groupBy("lang").agg(F.avg("score").alias("auc")), market, "lang", "auc", "ref")


@query("select count(*) as n, cast(sum(len(text)) as bigint) as total from (select text from documents union all select text from benchmark)")
def pooled_union(spark, d):
    both = J.union_common(load(spark, d, "documents"), load(spark, d, "benchmark"))
    return both.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total"))


@query("select l_partkey as partkey from lineitem where l_quantity > 49 intersect select p_partkey from part where p_size > 40")
def common_keys(spark, d):
    a = load(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("partkey"))
    return J.common_keys(a, load(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("partkey")), "partkey")


@query("select p_type from part except all select p_type from part where p_size > 10")
def name_difference(spark, d):
    part = load(spark, d, "part")
    return J.name_difference(part.select("p_type"), part.where("p_size > 10").select("p_type"))


@query("with {BASE} select lang, count_if(toxic not in (0, 1)) = 0 as binary, count_if(doc_id % 3 not in (0, 1)) = 0 as thirds from d group by lang")
def subset_test(spark, d):
    return base(spark, d).groupBy("lang").agg(J.is_subset(F.col("toxic"), (0, 1)).alias("binary"), J.is_subset(F.col("doc_id") % 3, (0, 1)).alias("thirds"))
