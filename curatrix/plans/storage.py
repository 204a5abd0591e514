"""Queries that write tables in every form and read them back, and the default rules over tokens."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import identity_key
from ..functions.session import cut, fresh_folder
from ..operators import cleaning as C
from ..operators import features as X
from ..operators import joins as J
from ..operators import lineage as R
from ..operators import profiling as A
from ..sources import snapshots as H
from ..sources import tables as S
from .catalog import base, load, query, rounded
from .curation import CLASHING, STATUS, clashing_records, shared_lines

PARTS = "p_partkey, p_name, p_brand, p_size, p_retailprice"


@query(f"select {PARTS} from part")
@rounded("p_retailprice")
def csv_round_trip(spark, d):
    path = fresh_folder(spark, "csv")
    rows = load(spark, d, "part").select(*PARTS.split(", "))
    S.write_table(rows, path, "csv")
    return S.read_table(spark, path, "csv", rows.schema)


@query("select doc_id, text, lang from documents")
def csv_of_texts(spark, d):
    """Quotes, line breaks and separators inside values come back as they were; an empty value as null."""
    path = fresh_folder(spark, "csv")
    rows = load(spark, d, "documents").select("doc_id", "text", "lang")
    S.write_table(rows, path, "csv")
    return S.read_table(spark, path, "csv", rows.schema)


@query("select event_type, count(*) as n, min(event_id) as first, max(event_id) as last from events group by event_type")
def json_documents(spark, d):
    """A report per event type, one JSON document a file, read as documents."""
    path = fresh_folder(spark, "json")
    sums = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    one = sums.select(F.col("event_type").alias("file"), F.to_json(F.struct("event_type", "n", "first", "last")).alias("value"))
    one.repartition("file").write.partitionBy("file").text(path)
    schema = T.StructType.fromDDL("event_type string, n long, first long, last long")
    return S.read_json_docs(spark, path + "/*", schema, "*.txt")[0].drop("file_name", "file")


@query("select user_id, count(*) as n, max(event_id) as last from events group by user_id")
def registry_log(spark, d):
    """Two rounds of events appended to a log of JSON lines, read as one."""
    path = fresh_folder(spark, "log")
    events = load(spark, d, "events").select("event_id", "user_id")
    for rest in (0, 1):
        S.append_registry(events.where(F.col("event_id") % 2 == rest), path)
    return S.read_registry(spark, path, "event_id long, user_id long").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("select conv_id, turn, length(text) as n from conversations where regexp_matches(text, '[^ ]')")
def delimited_records(spark, d):
    """Turns as records between separators: every record once, its position its own."""
    path = fresh_folder(spark, "records")
    turns = load(spark, d, "conversations")
    turns.select(F.concat_ws("|", "conv_id", "turn", "text").alias("value")).write.option("lineSep", "$$$$\n").text(path)
    got = S.read_records(spark, path)
    distinct = got.groupBy("position").agg(F.first("record").alias("record"))  # a position that two records had would lose one
    own = F.split("record", r"\|", 3)
    return distinct.where(F.get(own, F.lit(2)).rlike("[^ ]")).select(own[0].cast("long").alias("conv_id"), own[1].cast("long").alias("turn"), F.length(own[2]).cast("long").alias("n"))


#: Two files of one record a turn: the second, far larger, is dealt out first.
FILES = "f as (select case when conv_id % 50 = 0 then 'a' else 'b' end as file, conv_id, turn from conversations), k as (select *, row_number() over (order by file, conv_id, turn) - 1 as position from f)"


@query("with " + FILES + " select file, conv_id, turn, position, case when position < 20 then 1 else 0 end as label from k")
def record_positions(spark, d):
    """Positions over files of unequal size, and the labels that they decide."""
    path = fresh_folder(spark, "records")
    turns = load(spark, d, "conversations").select(F.when(F.col("conv_id") % 50 == 0, "a").otherwise("b").alias("file"), "conv_id", "turn")
    for name in "ab":  # a file each, in order
        own = turns.where(F.col("file") == name).select("conv_id", "turn").repartitionByRange(1, "conv_id").sortWithinPartitions("conv_id", "turn")
        own.select(F.concat_ws("|", "conv_id", "turn").alias("value")).write.option("lineSep", "$$$$\n").text(f"{path}/{name}")
    got = S.label_by_position(S.read_records(spark, f"{path}/*"), 20).withColumn("own", F.split("record", r"\|"))
    return got.select(F.when(F.col("own")[0].cast("long") % 50 == 0, "a").otherwise("b").alias("file"), F.col("own")[0].cast("long").alias("conv_id"), F.col("own")[1].cast("long").alias("turn"), "position", "label")


@query("select doc_id, n_chars, case when doc_id % 2 = 0 then 'train' else 'test' end as split from documents where doc_id % 2 = 0")
def split_folders(spark, d):
    """A folder per split; a reader of one reads no other."""
    path = fresh_folder(spark, "splits")
    rows = load(spark, d, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"))
    S.write_split(rows, path)
    return S.read_table(spark, path).where("split = 'train'").select("doc_id", "n_chars", "split")


@query("select doc_id, n_chars + 1 as n_chars from documents where lang = 'en'")
def replace_in_place(spark, d):
    """A table overwritten by what is derived from it."""
    path = fresh_folder(spark, "table")
    S.write_table(load(spark, d, "documents").select("doc_id", "n_chars", "lang"), path)
    S.replace_table(S.read_table(spark, path).where("lang = 'en'").select("doc_id", (F.col("n_chars") + 1).alias("n_chars")), path)
    return S.read_table(spark, path)


@query("""select 'rows' as what, lang, count(*) as n from documents where lang <> 'fr' group by lang union all select 'rows', 'fr', 2 * count(*) from documents where lang = 'fr'
union all select 'first', lang, count(*) from documents group by lang union all select 'commits', operation, n from (values ('append', 2), ('replace', 1)) t(operation, n)""")
def snapshot_merge(spark, d):
    """A table appended to, merged in place and appended to again; its first commit still reads as it was."""
    path = fresh_folder(spark, "snapshots")
    docs = load(spark, d, "documents").select("doc_id", "lang")
    H.append_rows(docs, path)
    H.update(spark, path, lambda now: now.where("lang <> 'fr'"))
    french = docs.where("lang = 'fr'")
    H.append_rows(french.union(french), path)
    count = lambda df, what, key="lang": df.groupBy(F.col(key).alias("lang")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "lang", "n")
    return J.union_all(count(H.read_snapshot(spark, path), "rows"), count(H.read_snapshot(spark, path, 0), "first"), count(H.history(spark, path), "commits", "operation"))


@query("""with t as (select distinct event_type as dataset from events), two as (select dataset, unnest([0, 1]) as version from t)
select 'now' as at, dataset, version, case when version > 0 then version - 1 end as parent_version, case when version = 0 then 'full' else 'incremental' end as type from two where dataset <> 'view'
union all select 'now', 'view', 0, null, 'full' union all select 'before', dataset, version, case when version > 0 then version - 1 end, case when version = 0 then 'full' else 'incremental' end from two""")
def lineage_commits(spark, d):
    """Writers of all datasets add their rounds at once, then one dataset is archived and built anew."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    path = fresh_folder(spark, "lineage")
    names = [r.event_type for r in load(spark, d, "events").select("event_type").distinct().collect()]
    ts = F.to_timestamp(F.lit("2026-01-01"))

    def rounds(name: str) -> None:
        for kind in ("full", "incremental"):
            R.commit_version(spark, path, name, kind, f"{name}-{kind}", 0.5, True, ts)

    with ThreadPoolExecutor(4) as threads:
        list(threads.map(inheritable_thread_target(spark)(rounds), names))
    archived = R.archive_rounds(spark, path, "view", confirmed=True)
    R.commit_version(spark, path, "view", "full", "anew", 0.6, True, ts)
    told = lambda at, v=None: H.read_snapshot(spark, path, v).select(F.lit(at).alias("at"), "dataset", "version", "parent_version", "type")
    return told("now").union(told("before", archived - 1))


@query("select lang, count(*) as n from documents group by lang union all select 'none', 0")
def written_if_any(spark, d):
    """Tables of the languages that have rows; an empty one isn't written."""
    path, docs = fresh_folder(spark, "any"), load(spark, d, "documents")
    found = S.write_if_any(docs.select("lang"), path)
    empty = S.write_if_any(docs.where("doc_id < 0 and doc_id > 0").select("lang"), path + "-none")
    counts = S.read_table(spark, path).groupBy("lang").agg(F.count("*").alias("n"))
    return J.union_all(counts.where(F.lit(found)), spark.createDataFrame([("none", int(empty))], "lang string, n long"))


@query("select vec_id, label, list_sum(list_transform(embedding, lambda x: cast(x as double))) as total, len(embedding) as n from embeddings")
@rounded("total")
def nested_round_trip(spark, d):
    path = fresh_folder(spark, "nested")
    S.write_nested(load(spark, d, "embeddings").select("vec_id", F.struct("label", F.array("embedding").alias("rows")).alias("record")), path)
    v = F.col("record.rows")[0]
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return S.read_table(spark, path).select("vec_id", F.col("record.label").alias("label"), total.alias("total"), F.size(v).cast("long").alias("n"))


REASONS = " ".join(f"when '{k}' then '{v}'" for k, v in (
    ("invalid_smiles", "missing value"), ("metal_complex", "contains a blocked component; manual review"), ("ambiguous_fragment", "a component could not be classified with confidence"),
    ("no_parent", "no parent component remained"), ("mixture", "several distinct parent components remain"),
))


@query("with " + CLASHING + """, gn as (select key, first_row, row_number() over (order by first_row) - 1 as gid from g), o as (select res.*, gid, first_row, status in ('clean', 'salt_removed') as good from res left join gn on res.gkey = gn.key)
select o.doc_id, x.text as text_raw, toxic, o.status as status_before, final as status, case when good then first_parent end as value_clean, cast(coalesce(n, 0) as int) as num_fragments, cast(coalesce(gone, 0) as int) as num_removed,
coalesce(removed, '') as removed, case when good or o.status = 'no_parent' then '' else coalesce(kept, '') end as retained, case when good then key end as key, case o.status """ + REASONS + r""" else '' end as reason,
cast(case when good then len(regexp_extract_all(first_parent, '\[[^\]]*@[^\]]*\]')) end as int) as n_marks, gid as duplicate_group_id,
case when gid is null then null when n_labels > 1 then 'duplicate with conflicting labels' when o.doc_id <> first_row then 'duplicate of row ' || first_row end as duplicate_reason,
case when final in ('clean', 'salt_removed') then 'clean' else 'review' end as part, count(*) over (partition by final in ('clean', 'salt_removed')) as rows_of_part from o join documents x on o.doc_id = x.doc_id""")
def curation_outputs(spark, d):
    """What the curation job ships: clean and review tables with all columns, duplicates resolved, and the JSON report;
    all written, and read back."""
    path, out = fresh_folder(spark, "curation"), clashing_records(spark, d)
    resolved = cut(out["resolved"].drop("text"))  # text_raw has it
    sides = dict(zip(("clean", "review"), C.split_by(resolved, F.col("status").isin(*C.ELIGIBLE)), strict=True))
    for name, rows in sides.items():
        S.write_table(rows, f"{path}/{name}")
    S.write_report(A.curation_report(resolved), f"{path}/report")
    report = spark.read.schema(out["report"].schema).json(f"{path}/report").first()
    told = {"clean": report.records_retained, "review": report.records_excluded}
    return J.union_all(*[S.read_table(spark, f"{path}/{name}").withColumns({"part": F.lit(name), "rows_of_part": F.lit(n).cast("long")}) for name, n in told.items()])


# ---- the default rules, over values that the words of the texts spell ------------------------------

#: A word's first two letters as a bracketed atom with a charge, the rest as bare atoms; by the length also a marked centre, an open
#: parenthesis, a ring's digit alone or twice, or an ion at the end.
WORDS = """w as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{2,12}')) as word from documents),
v as (select word, '[' || upper(substr(word, 1, 1)) || lower(substr(word, 2, 1)) || '+]' || upper(substr(word, 3)) || case when length(word) % 3 = 0 then '[C@H]' else '' end || case when length(word) % 4 = 0 then '(' else '' end
  || case length(word) % 5 when 0 then 'C1' when 1 then 'C1CC1' else '' end || case when length(word) % 7 = 0 then '.[Na+]' else '' end as value from w)"""
SYMBOLS = ", ".join(f"'{s}'" for s in C.BLOCKED_SYMBOLS)


def _values(spark, d):
    word = load(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,12}"), F.lit(0))).alias("word")).distinct()
    w = F.col("word")
    n = F.length(w)
    head = F.concat(F.lit("["), F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1)), F.lit("+]"), F.upper(F.substring(w, 3, 12)))
    return word.withColumn("value", F.concat(head, F.when(n % 3 == 0, "[C@H]").otherwise(""), F.when(n % 4 == 0, "(").otherwise(""), F.when(n % 5 == 0, "C1").when(n % 5 == 1, "C1CC1").otherwise(""), F.when(n % 7 == 0, ".[Na+]").otherwise("")))


@query("with " + WORDS + f""" select word, list_has_any(regexp_extract_all(value, '\\[[0-9]*([A-Z][a-z]?)', 1), [{SYMBOLS}]) as blocked,
regexp_matches(replace(regexp_replace(value, '\\[[^\\]]*\\]', '', 'g'), 'Cl', ''), '[Cc]') or regexp_matches(value, '\\[[0-9]*[Cc][^a-z]') as parent,
regexp_matches(value, '^\\[[0-9]*({'|'.join(C.BLOCKED_SYMBOLS)})(\\+|-)+[0-9]*\\]$') as free,
regexp_full_match(value, '(Cl|Br|[BCNOPSFIbcnops]|\\[[^\\[\\]]+\\]|[-=#$:/\\\\.()%0-9~*@+])+') and length(word) % 4 <> 0 and len(regexp_extract_all(regexp_replace(value, '\\[[^\\]]*\\]', '', 'g'), '1')) % 2 = 0 as valid,
case when length(word) % 2 = 0 then len(regexp_extract_all(value, '\\[[^\\]]*@[^\\]]*\\]')) end as marks from v""")
def default_rules(spark, d):
    v, even = F.col("value"), F.length("word") % 2 == 0
    return _values(spark, d).select(
        "word", C.is_blocked(v).alias("blocked"), C.has_parent_token(v).alias("parent"), C.is_free_ion(v).alias("free"), C.lexically_valid(v).alias("valid"), C.count_marks(v, even).cast("long").alias("marks")
    )


@query("with " + STATUS + """, blocked as (select c.* from cats c join st on c.doc_id = st.doc_id where st.status = 'metal_complex'),
r as (select doc_id, count_if(category = 'ambiguous') as unclear, count(distinct case when category = 'parent' then component end) as kinds,
  count_if(category = 'metal' and not (regexp_matches(component, '^[^ ]+$') or regexp_matches(component, '^[^ ]+ [^ ]+ [^ ]+$'))) as bound from blocked group by doc_id)
select case when unclear = 0 and kinds = 1 and bound = 0 then 'auto_recoverable' else 'needs_manual_review' end as recommendation, count(*) as n from r group by 1""")
def recovery_counts(spark, d):
    from .curation import recovery_recommendation

    return C.recovery_counts(recovery_recommendation(spark, d))


# ---- assembly, keys, hashes -----------------------------------------------------------------------


@query("with {BASE} select d.doc_id, d.lang, d.score, l.quality, len(e.embedding) as dim from d left join labels l on d.doc_id = l.doc_id left join embeddings e on d.doc_id = e.vec_id")
@rounded("score")
def assembled_by_key(spark, d):
    docs = base(spark, d).select("doc_id", "lang", "score")
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("dim"))
    return J.assemble(docs, [load(spark, d, "labels").select("doc_id", "quality"), vectors], "doc_id")


@query("select count(*) as n, true as same, false as other from documents")
def content_keys(spark, d):
    """A content's key is the same in any order of its rows and another once a row changes."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    key = X.cache_key(docs, ["doc_id", "text"])
    mixed = X.cache_key(docs.repartition(7, "text"), ["doc_id", "text"])
    changed = X.cache_key(docs.withColumn("text", F.when(F.col("doc_id") == 0, "x").otherwise(F.col("text"))), ["doc_id", "text"])
    return docs.agg(F.count("*").alias("n")).withColumns({"same": F.lit(key == mixed), "other": F.lit(key == changed)})


@query("select count(*) as n, true as same from documents")
def table_hash_of_any_order(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    a, b = R.table_hash(docs, ["doc_id", "text"]), R.table_hash(docs.orderBy(F.desc("text")), ["doc_id", "text"])
    return a.join(b.select(F.col("content_hash").alias("other"), F.col("n").alias("m")), F.col("n") == F.col("m")).select("n", (F.col("content_hash") == F.col("other")).alias("same"))


@query(r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents)
select doc_id, array_to_string(list_sort(list_distinct(list_transform(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % 2048))), ',') as bits from w""")
def shingle_fingerprints(spark, d):
    """The set bits of each text's three-word shingles, folded to 2,048."""
    return load(spark, d, "documents").select("doc_id", F.array_join(X.fingerprint(F.col("text")), ",").alias("bits"))


@query("with {BASE} select lang, count(distinct key) as n_keys, count(*) as n from d group by lang")
def identity_keys(spark, d):
    docs = load(spark, d, "documents").withColumn("key", identity_key(F.col("text")))
    return docs.groupBy("lang").agg(F.count_distinct("key").alias("n_keys"), F.count("*").alias("n"))
