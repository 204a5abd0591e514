"""Queries over splits, features, metrics, calibration, lineage and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.session import cut, fresh_folder
from ..operators import boosting as B
from ..operators import calibration as L
from ..operators import extensions as Z
from ..operators import features as X
from ..operators import learning as N
from ..operators import lineage as R
from ..operators import metrics as M
from ..operators import profiling as A
from ..operators import record_qc as V
from ..operators import splits as G
from ..operators import vector_store as Q
from ..operators.dedup import build_model_ready
from ..operators.joins import union_all
from .catalog import base, load, pseudo_score, query, rounded

# ---- splits -------------------------------------------------------------------------------------

#: The histogram fold as recursion over distinct sizes, large first.
FOLD = """grp as (select lang || '-' || (n_chars // 500) as grp, count(*) as size from documents group by 1),
h as (select size, count(*) as c, row_number() over (order by size desc) as i from grp group by size), tot as (select sum(size) as n from grp),
fold(i, size, a, b, t, v) as (select 0::bigint, 0::bigint, 0::bigint, 0::bigint, floor(0.8e0 * n)::bigint, floor(0.1e0 * n)::bigint from tot
 union all select h.i, h.size, least(h.c, f.t // h.size), least(h.c - least(h.c, f.t // h.size), f.v // h.size), f.t - h.size * least(h.c, f.t // h.size), f.v - h.size * least(h.c - least(h.c, f.t // h.size), f.v // h.size) from fold f join h on h.i = f.i + 1),
ranked as (select grp, size, row_number() over (partition by size order by grp) as k from grp),
placed as (select r.grp, r.size, case when k <= a then 'train' when k <= a + b then 'val' else 'test' end as split from ranked r join fold f on r.size = f.size)"""


def _grouped(spark, d):
    return load(spark, d, "documents").withColumn("grp", F.concat("lang", F.lit("-"), F.floor(F.col("n_chars") / 500).cast("string")))


@query("with recursive " + FOLD + " select split, cast(sum(size) as bigint) as n, count(*) as n_groups from placed group by split")
def group_split_sizes(spark, d):
    return G.group_split(_grouped(spark, d), "grp").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("n_groups"))


@query("with recursive " + FOLD + " select d.doc_id, p.split from documents d join placed p on p.grp = d.lang || '-' || (d.n_chars // 500)")
def group_split_in_name_order(spark, d):
    return G.group_split(_grouped(spark, d), "grp", tie=F.lit(0)).select("doc_id", "split")


@query("with recursive " + FOLD.replace("order by grp)", "order by cast('0x' || substr(md5('99:' || grp), 1, 15) as bigint), grp)") + ", m as (select *, lang || '-' || (n_chars // 500) as grp from documents) select m.doc_id, m.grp, p.split from m join placed p on m.grp = p.grp")
def group_split_members(spark, d):
    return G.group_split(_grouped(spark, d), "grp", seed=99).select("doc_id", "grp", "split")


@query("""with g as (select lang || '-' || (n_chars // 500) as grp, count(*) as size from documents group by 1)
select count(*) as n_groups, max(size) as largest, (select string_agg(size, ',' order by size desc) from (select size from g order by size desc limit 5)) as top5, count_if(size = 1) as n_singletons, count_if(size = 1) * 1e0 / count(*) as singleton_rate, count(*) < 10 as few from g""")
@rounded("singleton_rate")
def group_diagnostics(spark, d):
    return G.group_diagnostics(_grouped(spark, d), "grp")


MODULO = "case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end"


def _modulo_split():
    return F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")


@query("with {BASE}, s as (select " + MODULO + """ as split, toxic from d), t(split, target) as (values ('train', 0.7e0), ('val', 0.1e0), ('test', 0.1e0)),
c as (select split, count(*) as n, count_if(toxic = 1) as n_pos, count(distinct toxic) as k, count(*) * 1e0 / sum(count(*)) over () as fraction from s group by split)
select c.split, n, n_pos, fraction, abs(fraction - target) > 0.03e0 as off_target, n < 30 as small, k < 2 as single_class from c join t on c.split = t.split""")
@rounded("fraction")
def split_diagnostics(spark, d):
    return G.split_diagnostics(base(spark, d).withColumn("split", _modulo_split()), "split", "toxic", {"train": 0.7, "val": 0.1, "test": 0.1})


ORDER = "(doc_id * 104729 + n_chars * 7919)"
STRATA = "st as (select doc_id, toxic, row_number() over (partition by toxic order by " + ORDER + " % 10007, " + ORDER + ") - 1 as k, count(*) over (partition by toxic) as n from d where toxic is not null)"


def _order():
    return F.col("doc_id") * 104729 + F.col("n_chars") * 7919


def _labelled(spark, d):
    return base(spark, d).where("toxic is not null")


@query("with {BASE}, " + STRATA + " select doc_id, k < floor(n * 0.2e0) as holdout from st")
def stratified_holdout(spark, d):
    return G.stratified_holdout(_labelled(spark, d), "toxic", 0.2, _order()).select("doc_id", "holdout")


@query("with {BASE}, c as (select toxic, count(*) as n from d where toxic is not null group by toxic) select count(*) >= 2 and min(n) >= 2 and min(floor(n * 0.2e0)) >= 1 as enabled, case when count(*) < 2 then 'single class' when min(n) < 2 then 'a class has fewer than 2 rows' when min(floor(n * 0.2e0)) < 1 then 'a class would be missing from the hold-out' else '' end as reason from c")
def holdout_guard(spark, d):
    return G.holdout_guard(base(spark, d), "toxic", 0.2)


@query("with {BASE}, " + STRATA + " select doc_id, cast(k % 5 as int) as fold from st")
def stratified_folds(spark, d):
    return G.stratified_folds(_labelled(spark, d), "toxic", 5, _order()).select("doc_id", "fold")


@query("with {BASE}, " + STRATA + """, c as (select toxic, count(*) as n from d where toxic is not null group by toxic), p as (select arg_min(toxic, n) as small, cast(greatest(floor(max(n) * 0.5e0) - min(n), 0) as bigint) as extra from c)
select doc_id, toxic, false as is_copy from st union all select doc_id, toxic, true from (select st.*, unnest(range(cast(extra // n + (k < extra % n)::int as bigint))) as i from st join p on st.toxic = p.small)""")
def oversample_minority(spark, d):
    return G.oversample(_labelled(spark, d).select("doc_id", "toxic", "n_chars"), "toxic", _order(), 0.5).select("doc_id", "toxic", "is_copy")


@query("with {BASE}, " + STRATA + """, c as (select toxic, count(*) as n from d where toxic is not null group by toxic), p as (select arg_min(toxic, n) as small, min(n) as m, cast(floor(max(n) * 0.5e0) - min(n) as bigint) as extra from c),
draws as (select small, cast(('0x' || substr(md5('42:' || r), 1, 15)) as bigint) % m as k from (select small, m, unnest(range(extra)) as r from p) q)
select doc_id, toxic, false as is_copy from st union all select st.doc_id, st.toxic, true from st join draws on st.toxic = draws.small and st.k = draws.k""")
def oversample_drawn(spark, d):
    return G.oversample_drawn(_labelled(spark, d).select("doc_id", "toxic", "n_chars"), "toxic", _order(), 0.5).select("doc_id", "toxic", "is_copy")


@query("with {BASE} select toxic, count(*) as n, max(count(*)) over () * 1e0 / count(*) as weight from d where toxic is not null group by toxic")
@rounded("weight")
def class_weights(spark, d):
    return G.class_weights(base(spark, d), "toxic")


@query("select l_suppkey as suppkey, count(*) as n, case when count(*) < 400 then 'tiny' when count(*) < 1500 then 'small' when count(*) < 5000 then 'medium' else 'large' end as tier from lineitem group by 1")
def size_tier(spark, d):
    counts = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey")).agg(F.count("*").alias("n"))
    return counts.withColumn("tier", G.pick_tier(F.col("n")))


@query("with {BASE} select 'merged' as strategy, count(*) as n from d where " + MODULO + " <> 'test' union all select 'train', count(*) from d where " + MODULO + " = 'train'")
def training_pool(spark, d):
    rows = base(spark, d).withColumn("split", _modulo_split())
    return union_all(*[G.training_pool(rows, s).agg(F.count("*").alias("n")).select(F.lit(s).alias("strategy"), "n") for s in ("merged", "train")])


@query("with {BASE}, s as (select *, " + MODULO + " as split from d where toxic in (0, 1)), g as (select split, key, min(doc_id) as first_row, count(distinct toxic) as k from s group by 1, 2) select split, first_row as doc_id from g where k = 1")
def dedup_per_split(spark, d):
    return G.per_split(base(spark, d).withColumn("split", _modulo_split()), "doc_id", "key", "toxic").select("split", "doc_id")


@query("with {BASE}, ok as (select * from d where toxic in (0, 1)), g as (select key, min(doc_id) as first_row, count(distinct toxic) as k from ok group by key), m as (select ok.*, " + MODULO.replace("doc_id", "(ok.doc_id // 1)") + " as split from ok join g on ok.key = g.key and ok.doc_id = g.first_row where k = 1) select split, toxic, count(*) as n, count(*) * 1e0 / sum(count(*)) over (partition by split) as fraction from m group by split, toxic")
@rounded("fraction")
def model_ready_by_modulo_balance(spark, d):
    model = build_model_ready(base(spark, d), "doc_id", "key", "toxic")[0]
    return A.label_balance(model.withColumn("split", _modulo_split()), "toxic", ["split"])


#: Groups of a size in the order of a digest.
READY = """with recursive {BASE}, ok as (select * from d where toxic in (0, 1)), g as (select key, min(doc_id) as first_row, count(distinct toxic) as k from ok group by key),
ready as (select ok.* from ok join g on ok.key = g.key and ok.doc_id = g.first_row where k = 1), grp as (select coalesce(trim(source), '') as grp, count(*) as size from ready group by 1), """


@query(READY + FOLD[FOLD.index("h as"):].replace("order by grp)", "order by cast('0x' || substr(md5('42:' || grp), 1, 15) as bigint), grp)") + " select split, toxic, count(*) as n, count(*) * 1e0 / sum(count(*)) over (partition by split) as fraction from ready r join placed p on coalesce(trim(r.source), '') = p.grp group by split, toxic")
@rounded("fraction")
def model_ready_split_balance(spark, d):
    """Flagship: clean labelled rows, split by source without leakage, with each split's label balance."""
    model = build_model_ready(base(spark, d), "doc_id", "key", "toxic")[0]
    rows = model.withColumn("grp", G.group_key(F.col("source")))
    return A.label_balance(G.group_split(rows, "grp"), "toxic", ["split"])


# ---- features -----------------------------------------------------------------------------------


def _bits():
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.pmod(F.col("doc_id") * 31 + i * i * 17 + F.col("n_chars"), F.lit(2048)).cast("int"))))


BITS = "list_sort(list_distinct(list_transform(range(20), lambda i: (doc_id * 31 + i * i * 17 + n_chars) % 2048)))"


@query("with b as (select doc_id, " + BITS + " as bits from documents), h as (select doc_id, unnest(range(256)) as i, bits from b) select doc_id, string_agg(printf('%02X', cast(coalesce(list_sum(list_transform(list_filter(bits, lambda x: x // 8 = i), lambda x: 1 << cast(7 - x % 8 as int))), 0) as bigint)), '' order by i) as packed from h group by doc_id")
def pack_bits(spark, d):
    return load(spark, d, "documents").select("doc_id", F.hex(X.pack_bits(_bits())).alias("packed"))


@query("with b as (select doc_id, " + BITS + " as bits from documents) select doc_id, array_to_string(bits, ',') as bits, len(bits) as n from b")
def unpack_bits(spark, d):
    back = X.unpack_bits(X.pack_bits(_bits()))
    return load(spark, d, "documents").select("doc_id", back.alias("b")).select("doc_id", F.array_join("b", ",").alias("bits"), F.size("b").cast("long").alias("n"))


@query("with b as (select doc_id, " + BITS + " as bits from documents) select doc_id, array_to_string(bits, ',') as bits from b")
def unpack_bits_fast(spark, d):
    packed = load(spark, d, "documents").select("doc_id", X.pack_bits_fast(_bits()).alias("p"))
    return packed.select("doc_id", F.array_join(X.unpack_bits_fast("p"), ",").alias("bits"))


@query()
def fingerprint_tokens(spark, d):
    return load(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("bits"))


@query("with x as (select label, unnest(range(64)) as dim, unnest(embedding) as v, (vec_id % 3 > 0)::int as m from embeddings) select label, cast(dim as int) as dim, sum(v::double * m) / greatest(sum(m), 1e-9) as mean from x group by 1, 2")
@rounded("mean")
def masked_mean_pool(spark, d):
    rows = load(spark, d, "embeddings").withColumn("m", (F.col("vec_id") % 3 > 0).cast("int"))
    return X.masked_mean_rows(rows, "label", "embedding", "m")


@query("select vec_id, len(embedding) = 64 as ok64, len(embedding) = 63 as ok63, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings")
@rounded("norm")
def valid_vectors(spark, d):
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", S.valid_vector(e, 64).alias("ok64"), S.valid_vector(e, 63).alias("ok63"), S.norm(e).alias("norm"))


@query("with {BASE} select d.doc_id, case when e.embedding is null then 'no vector' else 'ok' end as reason from d left join embeddings e on d.doc_id = e.vec_id")
def combined_features(spark, d):
    store = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    good, bad = X.build_combined(base(spark, d).select("doc_id"), store, "doc_id", 64)
    return good.select("doc_id", F.lit("ok").alias("reason")).union(bad.select("doc_id", "reason"))


@query("with {BASE} select doc_id, text is null or trim(text) = '' as is_missing, count(*) over (partition by key) > 1 as is_duplicate, length(text) * 1e0 as chars, case when n_chars % 4 = 0 then 'NaN'::double else 1e0 / (n_chars % 4) end as inverse from d")
@rounded("chars", "inverse")
def featurized(spark, d):
    exprs = {"chars": F.length("text"), "inverse": F.expr("try_divide(1.0D, n_chars % 4)")}
    return X.featurize(load(spark, d, "documents"), "doc_id", "text", S.identity_key(F.col("text")), exprs).select("doc_id", "is_missing", "is_duplicate", "chars", "inverse")


@query("with {BASE}, ok as (select * from d where toxic in (0, 1)), g as (select key, count(*) as c, count(distinct toxic) as k from ok group by key) select (select count(*) from d) as n_full, count_if(k = 1) as n_model, cast(coalesce(sum(c) filter (k > 1), 0) as bigint) as n_conflicts, (select count(*) from d where toxic is null) as n_label_review from g")
def feature_job_meta(spark, d):
    full = X.featurize(base(spark, d).drop("key"), "doc_id", "text", S.identity_key(F.col("text")), {"chars": F.length("text")})
    return X.featurize_job(full, "doc_id", "toxic")["meta"]


def _embed(keys):
    """Facts of a text as a vector; texts with a bar and a hash sign are beyond it."""
    import numpy as np

    if any("|" in k and "#" in k for k in keys):
        raise ValueError("can't embed")
    return np.array([[len(k), k.count(" "), k.count("e")] for k in keys], dtype=np.float32)


@query("""with k as (select text as key, min(case when doc_id % 2 = 0 then 1 else 2 end) as round from documents where text is not null group by text),
j as (select key, length(key) > 2000 as long, contains(key, '|') and contains(key, '#') as bad, round from k),
s as (select sha256(key) as key, case when long then 'skip_permanent' when bad then 'retry' else 'ok' end as status, case when bad and not long then 2 else round end as round,
 case when not long and not bad then concat_ws(',', length(key), length(key) - length(replace(key, ' ', '')), length(key) - length(replace(key, 'e', ''))) end as vector from j)
select *, 0 as added_again from s""")
def embedding_cache(spark, d):
    """Two rounds into one store, the second of all texts: what is stored or skipped stays, what failed is tried again; a
    third of what is stored adds nothing."""
    path, meta = fresh_folder(spark, "store"), {"model": "facts", "pooling": "none"}
    docs = load(spark, d, "documents")
    Q.create_store(spark, path, buckets=8, blocks=4, **meta)
    for rows in (docs.where("doc_id % 2 = 0"), docs):
        Q.update_vectors(rows, "text", path, _embed, **meta)
    again = Q.pending_keys(docs.where(~(F.contains("text", F.lit("|")) & F.contains("text", F.lit("#"))) | (F.length("text") > 2000)), "text", path).count()
    vector = F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",")
    return Q.read_vectors(spark, path).select(F.sha2("key", 256).alias("key"), "status", "round", vector.alias("vector"), F.lit(again).alias("added_again"))


# ---- metrics ------------------------------------------------------------------------------------

LAB = "w as (select *, coalesce(toxic, (doc_id % 5 = 0)::int) as y, round(score, 2) as s from d)"
RANK = """, h as (select {by} s, sum(y) as pos, count(*) - sum(y) as neg from w group by {by} s), r as (select *, coalesce(sum(pos) over (partition by {part} order by s desc rows between unbounded preceding and 1 preceding), 0) as pa, coalesce(sum(neg) over (partition by {part} order by s desc rows between unbounded preceding and 1 preceding), 0) as na from h),
m as (select {by} cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg, case when sum(pos) > 0 and sum(neg) > 0 then sum(neg * (pa + pos / 2e0)) / (sum(pos)::double * sum(neg)) end as auc, case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (pa + pos) * 1e0 / (pa + pos + na + neg)) / sum(pos) end as ap from r {grp})"""
WHOLE, BY_LANG = RANK.format(by="", part="1", grp=""), RANK.format(by="lang,", part="lang", grp="group by lang")
CONF = "c as (select {by} count_if(s >= 0.5e0 and y = 1) as tp, count_if(s >= 0.5e0 and y = 0) as fp, count_if(s < 0.5e0 and y = 1) as fn, count_if(s < 0.5e0 and y = 0) as tn, avg((s - y) ** 2) as brier from w {grp})"
F1 = "case when 2 * tp + fp + fn > 0 then 2e0 * tp / (2 * tp + fp + fn) else 0 end"
MCC = "case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then (tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end"


def _scored(spark, d):
    y = F.coalesce("toxic", (F.col("doc_id") % 5 == 0).cast("int"))
    return base(spark, d).withColumns({"y": y, "s": F.round("score", 2)})


@query("with {BASE}, " + LAB + WHOLE + " select auc from m")
@rounded("auc")
def roc_auc(spark, d):
    return M.roc_auc(_scored(spark, d), "s", "y")


@query("with {BASE}, " + LAB + BY_LANG + " select lang, ap from m")
@rounded("ap")
def average_precision(spark, d):
    return M.average_precision(_scored(spark, d), "s", "y", ["lang"])


@query("with {BASE}, " + LAB + ", " + CONF.format(by="", grp="") + f" select tp, fp, fn, tn, {F1} as f1, {MCC} as mcc from c")
@rounded("f1", "mcc")
def f1_mcc_at_threshold(spark, d):
    return M.f1_mcc(_scored(spark, d), "s", "y", 0.5)


SWEEP = """, g as (select k, 0.1e0 + (0.9e0 - 0.1e0) * k / 80 as t from (select unnest(range(81)) as k)), q as (select k, t, count_if(s >= t and y = 1) as tp, count_if(s >= t and y = 0) as fp, count_if(s < t and y = 1) as fn, count_if(s < t and y = 0) as tn from w cross join g group by k, t),
f as (select k, t, {F1} as f1, {MCC} as mcc from q)""".format(F1=F1, MCC=MCC)


@query("with {BASE}, " + LAB + SWEEP + " select arg_min(t, (-round(f1, 12), k)) as f1_threshold, max(f1) as f1, arg_min(t, (-round(mcc, 12), k)) as mcc_threshold, max(mcc) as mcc from f")
@rounded("f1_threshold", "f1", "mcc_threshold", "mcc")
def best_threshold(spark, d):
    return M.best_threshold(_scored(spark, d), "s", "y")


@query("with {BASE}, " + LAB + " select source, avg((s - y) ** 2) as brier from w group by source")
@rounded("brier")
def brier(spark, d):
    return M.brier(_scored(spark, d), "s", "y", ["source"])


ECE = "b as (select {by} case when s < 1 then len(list_filter(list_transform(range(10), lambda k: k / 10e0), lambda e: e <= s)) - 1 end as bin, count(*) as n, avg(s) as conf, avg(y * 1e0) as acc from w group by {by} 2), e as (select {by} sum(case when bin >= 0 then n * abs(acc - conf) else 0 end) / sum(n) as ece from b {grp})"


@query("with {BASE}, " + LAB + ", " + ECE.format(by="", grp="").replace("group by  2", "group by 1") + " select ece from e")
@rounded("ece")
def ece(spark, d):
    return M.ece(_scored(spark, d), "s", "y")


@query("with {BASE}, " + LAB + BY_LANG + ", " + CONF.format(by="lang,", grp="group by lang") + ", " + ECE.format(by="lang,", grp="group by lang") + f" select m.lang, n_pos, n_neg, round_even(auc, 4) as auc, round_even(ap, 4) as ap, round_even({F1}, 4) as f1, round_even({MCC}, 4) as mcc, round_even(brier, 4) as brier, round_even(ece, 4) as ece from m join c on m.lang = c.lang join e on m.lang = e.lang")
@rounded("auc", "ap", "f1", "mcc", "brier", "ece")
def metrics_by_group(spark, d):
    return M.binary_metrics(_scored(spark, d), "s", "y", by=["lang"])


@query("with {BASE}, " + LAB + WHOLE + ", " + CONF.format(by="", grp="") + ", " + ECE.format(by="", grp="").replace("group by  2", "group by 1") + f" select n_pos, n_neg, round_even(auc, 4) as auc, round_even(ap, 4) as ap, round_even({F1}, 4) as f1, round_even({MCC}, 4) as mcc, round_even(brier, 4) as brier, round_even(ece, 4) as ece from m, c, e")
@rounded("auc", "ap", "f1", "mcc", "brier", "ece")
def binary_metrics(spark, d):
    return M.binary_metrics(_scored(spark, d), "s", "y")


@query("with {BASE}, " + LAB + BY_LANG + ", v(lang, saved_auc) as (values ('en', 0.5e0), ('de', 0.6e0)) select m.lang, auc, 1 - auc as auc_flipped, saved_auc, auc - saved_auc as drift from m left join v on m.lang = v.lang")
@rounded("auc", "auc_flipped", "saved_auc", "drift")
def rescore(spark, d):
    saved = spark.createDataFrame([("en", 0.5), ("de", 0.6)], "lang string, saved_auc double")
    return M.rescore(_scored(spark, d), "s", "y", saved, ["lang"])


# ---- ensembles, calibration, conformal ----------------------------------------------------------

SEEDS = (104729, 15485863, 32452843)
SEEDED = "sd as (" + " union all ".join(f"select doc_id, {i} as seed, case when doc_id % 11 = {i} then null else ((doc_id * {m} + n_chars * 7919) % 10007) / 10007e0 end as p from documents" for i, m in enumerate(SEEDS)) + ")"


def _seeded(spark, d):
    docs = load(spark, d, "documents")
    return union_all(*[docs.select("doc_id", F.lit(i).alias("seed"), F.when(F.col("doc_id") % 11 != i, pseudo_score(m)).alias("p")) for i, m in enumerate(SEEDS)])


@query("with " + SEEDED + " select doc_id, avg(p) as score, count(p) as n_members from sd group by doc_id")
@rounded("score")
def ensemble_mean(spark, d):
    return L.ensemble_mean(_seeded(spark, d), "doc_id", "p")


@query("with " + SEEDED + " select doc_id, avg(p) as score, count(p) as n_members, count(p) = 3 as complete from sd group by doc_id")
@rounded("score")
def oof_ensemble(spark, d):
    return L.ensemble_oof(_seeded(spark, d), "doc_id", "p", 3)


@query("with " + SEEDED + ", e as (select doc_id, stddev_pop(p) as sd from sd group by doc_id) select count(*) as n_rows, avg(sd) as mean_sd, max(sd) as max_sd, count_if(sd > 0.15e0) as n_alert from e")
@rounded("mean_sd", "max_sd")
def seed_disagreement(spark, d):
    return L.seed_disagreement(_seeded(spark, d), "doc_id", "p")


CONFORMAL = LAB + """, cal as (select y as class, case when y = 1 then 1 - s else s end as nc from w where doc_id % 2 = 0), tst as (select doc_id, 0 as class, s as nc from w where doc_id % 2 = 1 union all select doc_id, 1, 1 - s from w where doc_id % 2 = 1),
n as (select class, count(*) as n from cal group by class), p as (select t.doc_id, t.class, (1 + count(c.nc)) * 1e0 / (any_value(n.n) + 1) as p from tst t join n on t.class = n.class left join cal c on c.class = t.class and c.nc >= t.nc group by 1, 2)"""


def _pvalues(spark, d):
    w = _scored(spark, d)
    return L.conformal_pvalues(w.where("doc_id % 2 = 1"), "doc_id", "s", L.nonconformity(w.where("doc_id % 2 = 0"), "s", "y"))


@query("with {BASE}, " + CONFORMAL + " select doc_id, class, p from p")
@rounded("p")
def conformal_pvalues(spark, d):
    return _pvalues(spark, d)


@query("with {BASE}, " + CONFORMAL + " select doc_id, coalesce(string_agg(class, ',' order by class) filter (p > 0.1e0), '') as classes, count_if(p > 0.1e0) <> 1 as abstain from p group by doc_id")
def prediction_sets(spark, d):
    sets = L.prediction_sets(_pvalues(spark, d), "doc_id")
    return sets.withColumn("classes", F.array_join("classes", ","))


@query("with {BASE}, " + CONFORMAL + ", s as (select doc_id, count_if(p > 0.1e0) <> 1 as abstain from p group by doc_id) select count(*) as n_rows, count_if(abstain) as n_abstain, avg(abstain::int) as abstain_rate from s")
@rounded("abstain_rate")
def uncertainty_report(spark, d):
    return L.uncertainty(L.prediction_sets(_pvalues(spark, d), "doc_id"))


#: The highest, over the first scores of a run up to here, of the lowest frequency of runs from there to here or beyond.
MAX_MIN = """, ip as (select s, sum(count(*)) over (order by s) as cn, sum(sum(y)) over (order by s) as cp, count(*) as n, sum(y) as p from w group by s),
ir as (select a.s as a, b.s as b, (b.cp - a.cp + a.p) * 1e0 / (b.cn - a.cn + a.n) as f from ip a join ip b on a.s <= b.s),
lowest as (select a, b, min(f) over (partition by a order by b desc) as f from ir), iso as (select b as s, max(f) as f from lowest group by b)"""


@query("with {BASE}, " + LAB + MAX_MIN + " select w.doc_id, w.s, iso.f as calibrated from w join iso on w.s = iso.s")
@rounded("calibrated")
def isotonic_apply(spark, d):
    w = _scored(spark, d)
    return L.apply_isotonic(L.fit_isotonic(w, "s", "y"), w, "s").select("doc_id", "s", "calibrated")


@query("with {BASE}, " + LAB + MAX_MIN + " select min(w.s) as lo, max(w.s) as hi, count(*) as n, cast(sum(y) as bigint) as pos from w join iso on w.s = iso.s group by round(iso.f, 12)")
def isotonic_blocks(spark, d):
    """Ranges of scores that share a frequency, hull by hull."""
    return L.isotonic_blocks(_scored(spark, d), "s", "y")


# ---- checks of records --------------------------------------------------------------------------


@query("with s as (select label, avg(embedding[1]) as m, stddev_pop(embedding[1]) as sd, count(*) as n from embeddings group by label) select e.vec_id, case when n >= 8 then (e.embedding[1] - m) / (sd + 1e-9) end as z, coalesce(case when n >= 8 then abs((e.embedding[1] - m) / (sd + 1e-9)) > 2 end, false) as is_outlier from embeddings e join s on e.label = s.label")
@rounded("z")
def zscore_outliers(spark, d):
    rows = load(spark, d, "embeddings").withColumn("x", F.get("embedding", F.lit(0)).cast("double"))
    return V.zscore_outliers(rows, "x", "label", limit=2.0).select("vec_id", "z", "is_outlier")


def _points(spark, d):
    place = lambda i: F.array(*[F.get(F.col("embedding"), 3 * i + k).cast("double") * 3 for k in range(3)])
    n = F.col("vec_id") % 6
    atoms = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i % 2 == 0, "C").otherwise("O"))
    cut = lambda a, m: F.slice(a, F.lit(1), m.cast("int"))
    rows = load(spark, d, "embeddings").select("vec_id", "label", cut(atoms, F.when(F.col("vec_id") % 17 == 0, n + 1).otherwise(n)).alias("atoms"), cut(F.transform(F.sequence(F.lit(0), F.lit(5)), place), n).alias("points"))
    return V.qc_records(rows, "vec_id", "atoms", "points", {"C": 0.76, "O": 0.66}, spread=1.2)


QC = """with recursive p as (select vec_id, cast(vec_id % 6 as int) as n, case when vec_id % 17 = 0 then least(vec_id % 6 + 1, 6) else vec_id % 6 end as na, list_transform(embedding, lambda x: x::double * 3) as e from embeddings),
pt as (select vec_id, n, i, e[3*i+1] as x, e[3*i+2] as y, e[3*i+3] as z, case when i % 2 = 0 then 0.76e0 else 0.66e0 end as r from (select *, unnest(range(n)) as i from p)),
pr as (select a.vec_id, a.i, b.i as j, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) as d, a.r + b.r as r from pt a join pt b on a.vec_id = b.vec_id and a.i < b.i),
bd as (select vec_id, i as u, j as v from pr where d <= 1.3e0 * r union select vec_id, j, i from pr where d <= 1.3e0 * r), rc(vec_id, u, v) as (select vec_id, i, i from pt union select rc.vec_id, rc.u, bd.v from rc join bd on rc.vec_id = bd.vec_id and rc.v = bd.u),
cc as (select vec_id, count(distinct c) as k from (select vec_id, u, min(v) as c from rc group by 1, 2) group by 1), ct as (select vec_id, avg(x) as cx, avg(y) as cy, avg(z) as cz from pt group by 1),
sp as (select pt.vec_id, max(sqrt((x-cx)**2 + (y-cy)**2 + (z-cz)**2)) as s from pt join ct on pt.vec_id = ct.vec_id group by 1), mx as (select vec_id, max(d) as m, bool_or(d > 1.3e0 * r and d < 0.9e0 * r) as clash from pr group by 1)
select p.vec_id, case when na <> n then 'length mismatch' when n < 1 then 'empty' when n > 1 and clash then 'clash' when n > 1 and m > 30 then 'exploded' when n > 1 and k > 1 then 'disconnected' when n > 1 and s > 1.2e0 then 'spread' end as issue
from p left join cc on p.vec_id = cc.vec_id left join sp on p.vec_id = sp.vec_id left join mx on p.vec_id = mx.vec_id"""


@query(QC)
def vector_qc(spark, d):
    return _points(spark, d).select("vec_id", "issue")


@query(f"with q as ({QC}), bad as (select vec_id, row_number() over (order by vec_id) as k from q where issue is not null) select count(*) as n_checked, count_if(issue is not null) as n_suspicious, cast(0 as bigint) as n_outliers, (select string_agg(vec_id, ',' order by vec_id) from bad where k <= 20) as examples from q")
def vector_qc_summary(spark, d):
    return V.qc_summary(_points(spark, d), "vec_id")


@query("""with recursive e as (select distinct o_custkey as u, 1000000 + o_orderkey % 997 as v from orders), b as (select u, v from e union select v, u from e), r(u, c) as (select u, u from b union select b.v, r.c from r join b on r.u = b.u) select u as node, min(c) as component from r where c < 1000000 group by u""")
def connected_components(spark, d):
    edges = load(spark, d, "orders").select(F.col("o_custkey").alias("src"), (1000000 + F.col("o_orderkey") % 997).alias("dst"))
    return V.connected_components(edges)


@query("with v as (select p_brand as brand, p_partkey, case when p_size % 7 <> 0 then p_retailprice end as e from part), k as (select brand, p_partkey, e, row_number() over (partition by brand order by e nulls last, p_partkey) as k from v) select brand, case when e is not null then p_partkey end as payload, e as energy, e is not null as ok from k where k = 1")
@rounded("energy")
def best_variant(spark, d):
    part = load(spark, d, "part").withColumn("e", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")))
    return V.best_variant(part.withColumnRenamed("p_brand", "brand"), "brand", "e", F.col("p_partkey"))


# ---- lineage ------------------------------------------------------------------------------------

def _lineage_sql(dataset: str) -> str:
    """``lin``: all events as rounds, as ``_lineage`` makes them."""
    return f"ln as (select {dataset} as dataset, cast(row_number() over (partition by {dataset} order by ts, event_id) - 1 as int) as version, event_id, value, ts from events), lin as (select dataset, version, case when version > 0 then version - 1 - (version - 1) % 2 end as parent_version, case when version % 4 = 0 then 'full' else 'incremental' end as type, sha256(cast(event_id as varchar)) as model_hash, value as held_out_auc, ts from ln)"


LINEAGE, BY_USER = _lineage_sql("event_type"), _lineage_sql("concat_ws('-', event_type, cast(user_id as varchar))")


def _lineage(spark, d, *dataset):
    """All events as rounds: version = place by time within the dataset (the event type, unless columns are given).

    Places are counted within hours and added to the rows before, so no window holds a whole dataset."""
    from pyspark.sql.window import Window

    name = F.concat_ws("-", *dataset) if dataset else F.col("event_type")
    e = load(spark, d, "events").select(name.alias("dataset"), F.date_trunc("hour", "ts").alias("hour"), "event_id", "value", "ts")
    before = Window.partitionBy("dataset").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = e.groupBy("dataset", "hour").agg(F.count("*").alias("n")).select(F.col("dataset").alias("d"), F.col("hour").alias("h"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = e.join(hours, F.col("dataset").eqNullSafe(F.col("d")) & F.col("hour").eqNullSafe(F.col("h")))
    v = (F.col("base") + F.row_number().over(Window.partitionBy("dataset", "hour").orderBy("ts", "event_id")) - 1).cast("int")
    rows = placed.select("dataset", v.alias("version"), "event_id", "value", "ts")
    parent = F.when(F.col("version") > 0, F.col("version") - 1 - (F.col("version") - 1) % 2)
    kind = F.when(F.col("version") % 4 == 0, "full").otherwise("incremental")
    return rows.select("dataset", "version", parent.alias("parent_version"), kind.alias("type"), F.sha2(F.col("event_id").cast("string"), 256).alias("model_hash"), F.col("value").alias("held_out_auc"), "ts")


@query("with recursive " + BY_USER + ", w(dataset, version, ancestor, depth) as (select dataset, version, parent_version, 1 from lin where parent_version is not null union all select w.dataset, w.version, l.parent_version, w.depth + 1 from w join lin l on w.dataset = l.dataset and w.ancestor = l.version where l.parent_version is not null) select dataset, version, ancestor, depth from w")
def lineage_ancestry(spark, d):
    # A version has as many rows as ancestors, so a user's events of a type are a dataset: all take part and chains are short.
    return R.ancestry(_lineage(spark, d, "event_type", "user_id"))


@query("with " + LINEAGE + " select dataset, max(version) as version, arg_max(model_hash, version) as model_hash from lin group by dataset")
def latest_version(spark, d):
    return R.latest_version(_lineage(spark, d)).select("dataset", "version", "model_hash")


@query("with " + LINEAGE + " select dataset, count_if(type = 'incremental') as n_later, count_if(type = 'incremental') = 0 as may_rebuild from lin group by dataset")
def rebuild_guard(spark, d):
    return R.rebuild_guard(_lineage(spark, d))


@query("with " + LINEAGE + ", x as (select dataset, max(version) as version, arg_max(model_hash, version) as h from lin group by dataset) select dataset, version, dataset <> 'click' as ok from x")
def verify_parent(spark, d):
    lin = _lineage(spark, d)
    files = R.latest_version(lin).select("dataset", F.when(F.col("dataset") == "click", "other").otherwise(F.col("model_hash")).alias("file_hash"))
    return R.verify_parent(lin, files)


@query("with " + LINEAGE + " select 'view' as dataset, cast(coalesce(max(version) + 1, 0) as int) as version, max(version) as parent_version, 'incremental' as type from lin where dataset = 'view'")
def next_version(spark, d):
    row = R.append_version(_lineage(spark, d), "view", "incremental", "hash", 0.9, True, F.to_timestamp(F.lit("2026-01-01")))
    return row.select("dataset", "version", "parent_version", "type")


#: An event type's versions are trained on the users of their events; a version's parent is two or one before it.
TRAINED = "tr as (select distinct dataset, version % 40 as version, cast(user_id * 7919 as bigint) as row_id from lin join ln using (dataset, version)), parents as (select distinct dataset, version % 40 as version, case when version % 40 > 0 then version % 40 - 1 - (version % 40 - 1) % 2 end as parent_version from lin)"


def _members(spark, d):
    lin = _lineage(spark, d).withColumn("version", F.col("version") % 40)
    parent = F.when(F.col("version") > 0, F.col("version") - 1 - (F.col("version") - 1) % 2)
    users = load(spark, d, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("model_hash"), (F.col("user_id") * 7919).alias("row_id"))
    trained = lin.join(users, "model_hash").select("dataset", "version", "row_id")
    return R.membership(trained, "row_id"), lin.select("dataset", "version", parent.alias("parent_version")).distinct()


@query("with recursive " + LINEAGE.replace("event_id, value, ts from events", "event_id, user_id, value, ts from events") + ", " + TRAINED + """, anc(dataset, version) as (select distinct dataset, 9 from parents union select a.dataset, p.parent_version from anc a join parents p on a.dataset = p.dataset and a.version = p.version where p.parent_version is not null),
seen as (select distinct t.dataset, t.row_id from tr t join anc a on t.dataset = a.dataset and t.version = a.version), held as (select distinct event_type as dataset, cast(user_id * 7919 as bigint) as row_id from events)
select h.dataset, h.row_id from held h left join seen s on h.dataset = s.dataset and h.row_id = s.row_id where s.row_id is null""")
def fair_holdout(spark, d):
    """Users of an event type that neither its version 9 nor any version that it descends from was trained on."""
    members, lin = _members(spark, d)
    heads = lin.where("version = 9").select("dataset", "version")
    held = load(spark, d, "events").select(F.col("event_type").alias("dataset"), (F.col("user_id") * 7919).alias("row_id")).distinct()
    return R.fair_holdout(held, "row_id", R.seen_by(members, lin, heads))


@query("with m as (select user_id as dataset, avg(value) filter (event_id % 2 = 0) as candidate_auc, avg(value) filter (event_id % 2 = 1) as baseline_auc from events group by user_id) select *, candidate_auc - baseline_auc as delta, case when coalesce(candidate_auc - baseline_auc >= -0.5e0, false) then 'promoted' else 'rejected' end as decision from m")
@rounded("candidate_auc", "baseline_auc", "delta")
def promotion_gate(spark, d):
    even = F.col("event_id") % 2 == 0
    m = load(spark, d, "events").groupBy(F.col("user_id").alias("dataset")).agg(F.avg(F.when(even, F.col("value"))).alias("candidate_auc"), F.avg(F.when(~even, F.col("value"))).alias("baseline_auc"))
    return R.promote(m, 0.5)


@query("""with p as (select user_id, min(event_type) as tier, count(*) // 10 as k from events where event_id % 2 = 0 group by 1), c as (select user_id, min(event_type) as tier, count(*) // 10 as k from events where event_id % 2 = 1 group by 1)
select c.user_id, case when p.user_id is null then 'no previous run' else concat_ws('; ', case when p.tier <> c.tier then 'tier: ' || p.tier || ', now ' || c.tier end, case when p.k <> c.k then 'k: ' || p.k || ', now ' || c.k end) end as reasons, p.user_id is not null and p.tier = c.tier and p.k = c.k as ok from c left join p on c.user_id = p.user_id""")
def compatibility_reasons(spark, d):
    run = lambda r: load(spark, d, "events").where(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.min("event_type").alias("tier"), F.floor(F.count("*") / 10).alias("k"))
    return R.compatibility(run(0), run(1), "user_id", ["tier", "k"])


@query("with {BASE}, " + LAB + BY_LANG + " select lang, lang || ' auc=' || coalesce(printf('%.3f', auc), 'n/a') || ' ap=' || coalesce(printf('%.3f', ap), 'n/a') as line from m")
def benchmark_report(spark, d):
    return A.benchmark_report(M.ranking(_scored(spark, d), "s", "y", ["lang"]), "lang", ["auc", "ap"])


@query()
def table_hash(spark, d):
    return R.table_hash(load(spark, d, "documents"), ["doc_id", "text"])


@query("with h as (select doc_id // 4096 as c, sha256(string_agg(sha256(text), ',' order by doc_id)) as h from documents group by 1) select sha256(string_agg(h, ',' order by c)) as order_hash from h")
def ordered_hash(spark, d):
    return R.ordered_hash(load(spark, d, "documents"), F.col("text"), "doc_id")


# ---- learning -----------------------------------------------------------------------------------

FEATURES = ["chars", "words", "symbols", "upper"]


def _learnable(spark, d):
    t = F.col("text")
    exprs = {"chars": F.length(t), "words": F.size(F.split(t, " ")), "symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")), "upper": F.regexp_count(t, F.lit("[A-Z]"))}
    return X.descriptors(base(spark, d), exprs).where("quality is not null").select("doc_id", "source", "quality", "n_chars", *FEATURES)


@query()
def fit_and_score(spark, d):
    """The endpoints' depth, step and rounds; the validation split chooses the best round and, a few rounds without a better
    one later, ends the fit."""
    rows = cut(G.group_split(_learnable(spark, d), "source"))
    run = B.fit_boosted(rows.where("split <> 'test'").withColumn("stops", F.col("split") == "val"), FEATURES, "quality", B.Boosting(patience=6, every=8), "stops")
    return M.ranking(N.score(run.ensemble, rows), "score", "quality", ["split"]).withColumn("best_iteration", F.lit(run.best_iteration))


@query()
def nested_cv(spark, d):
    """All settings of the grid tried within each outer fold, with the endpoints' own rounds and patience: a tenth of the rows of each
    class, in no fit learned from, chooses its best round and ends it."""
    rows = G.stratified_holdout(_learnable(spark, d), "quality", N.HELD, _order())
    trials = N.trial_table({"depth": [2, 4], "step": [0.05, 0.3], "shrink": [1.0, 3.0]}, {"depth": 4, "step": 0.05, "shrink": 3.0})
    return N.nested_cv(rows, "doc_id", FEATURES, "quality", [t | {"validation": "holdout"} for t in trials], 3, 2, _order(), together=True)


@query()
def test_evaluated_once(spark, d):
    w = _scored(spark, d)
    oof = union_all(*[w.where("doc_id % 2 = 0").select("doc_id", F.lit(i).alias("seed"), F.col("y"), pseudo_score(m).alias("score")) for i, m in enumerate(SEEDS)])
    return N.evaluate_test_once(oof, w.where("doc_id % 2 = 1").select("doc_id", "y", "score"), "doc_id", "y", 3)["metrics"]


# ---- extensions ---------------------------------------------------------------------------------


@query("with b as (select doc_id, list_sort(list_distinct(list_transform(range(40), lambda i: (doc_id // 4 * 31 + i * (doc_id % 4 + 40)) % 2048))) as bits from documents), x as (select doc_id, len(bits) as n, unnest(bits) as bit from b), s as (select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) as n, any_value(b.n) as m from x a join x b on a.bit = b.bit and a.doc_id < b.doc_id group by 1, 2) select a, b, k * 1e0 / (n + m - k) as similarity from s where k * 1e0 / (n + m - k) >= 0.3e0")
@rounded("similarity")
def bit_similarity(spark, d):
    """Every two documents that share enough bits, those of equal bits too."""
    bits = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: ((F.floor(F.col("doc_id") / 4) * 31 + i * (F.col("doc_id") % 4 + 40)) % 2048).cast("int"))))
    return Z.bit_pairs(load(spark, d, "documents").select("doc_id", bits.alias("bits")), "doc_id", "bits", 0.3)


@query("with {BASE} select doc_id, case when toxic is null then score else (3 * score + toxic) / 4 end as fused, case when score >= 0.8e0 or score <= 1 - 0.8e0 then score else coalesce(toxic, score) end as cascaded from d")
@rounded("fused", "cascaded")
def fusion(spark, d):
    rows = base(spark, d).withColumn("t", F.col("toxic").cast("double"))
    return rows.select("doc_id", Z.fuse(["score", "t"], [3.0, 1.0]).alias("fused"), Z.cascade(["score", "t"]).alias("cascaded"))


@query("select doc_id, min(toxic) as toxic, min(quality) as quality from (select doc_id, toxic, null as quality from labels where doc_id % 2 = 0 union all select doc_id, null, quality from labels where doc_id % 3 = 0) group by doc_id")
def multi_task_labels(spark, d):
    labels = load(spark, d, "labels")
    tables = {"toxic": labels.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("y")), "quality": labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("y"))}
    return Z.multi_task(tables, "doc_id", "y")
