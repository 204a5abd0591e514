"""SQL of the queries for the checking engine, where SQL can express them."""

from __future__ import annotations

from . import clustering, mixing, quality_rules
from .lexical_search import TERM
from .mixing import Mix

WORDS = r"'[^\x20\x09-\x0D]+'"

OP3 = r"""
with recursive urls as (
  select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path, regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1) as query, html
  from pages
), rules(rule, verdict, host, path) as (
  values {rules}
), tags as (
  select url, host, path, tag from (select *, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) as tag from urls)
  where regexp_matches(tag, '(?is)rel\s*=\s*["'']?canonical\b|http-equiv\s*=\s*["'']?refresh\b')
), targets as (
  select url, host, path, trim(regexp_extract(tag, '(?is)(?:href\s*=\s*["'']?|url\s*=\s*["'']?)([^"''>\s]+)', 1)) as raw from tags
), absolute as (
  select url, case when contains(raw, '://') then raw when starts_with(raw, '//') then 'x:' || raw when starts_with(raw, '/') then 'x://' || host || raw
    else 'x://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || raw end as dst from targets where raw <> ''
), forms as (
  select distinct u as url, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path, regexp_extract(u, '(?s)^[^?#]*(\?[^#]*)', 1) as query from (select url as u from absolute union select dst from absolute)
), edges as (
  select a.host || a.path || a.query as u, b.host || b.path || b.query as v from absolute e join forms a on e.url = a.url join forms b on e.dst = b.url where a.host <> '' and b.host <> ''
), both_ways as (
  select u, v from edges union select v, u from edges union select u, u from edges union select v, v from edges
), reach as (
  select u, v from both_ways union select r.u, b.v from reach r join both_ways b on r.v = b.u
), classes as (
  select u as node, min(v) as component from reach group by u
), judged as (
  select c.component, c.node, (select r.verdict from rules r join forms f on f.host || f.path || f.query = c.node
    where ends_with('.' || f.host, '.' || r.host) and starts_with(f.path, r.path) order by length(r.rule) desc, r.verdict limit 1) as said from classes c
), barred as (
  select node, component, bool_or(coalesce(said = 'block', false)) over (partition by component) and not bool_or(coalesce(said = 'allow', false)) over (partition by component) as barred from judged
), hits as (
  select u.*, r.rule, r.verdict, row_number() over (partition by u.page_id, u.url order by length(r.rule) desc nulls last, r.verdict) as k
  from urls u left join rules r on ends_with('.' || u.host, '.' || r.host) and starts_with(u.path, r.path)
)
select h.page_id, h.host, h.path, h.rule, coalesce(h.verdict, case when b.barred then 'block' else 'allow' end) as verdict, b.component
from hits h left join barred b on h.host <> '' and b.node = h.host || h.path || coalesce(h.query, '') where h.k = 1
"""

OP4 = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from words
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), links as (
  select s.a, s.b from shared s join sizes x on s.a = x.doc_id join sizes y on s.b = y.doc_id where 100 * s.n >= 80 * (x.n + y.n - s.n)
), reach as (
  select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a
)
select d.doc_id, coalesce(z.n, 0) as n_shingles, min(r.b) as component_id, d.doc_id = min(r.b) as kept
from documents d join reach r on d.doc_id = r.a left join sizes z on d.doc_id = z.doc_id group by d.doc_id, z.n
"""

STATISTICS = r"""
select d.doc_id, d.lang, d.source, cast(len(w) as bigint) as n_words, cast(coalesce(length(array_to_string(w, '')), 0) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast((select count(distinct i + k) from (select i, count(*) over (partition by s) as c from (select unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as s) g) h, range(3) t(k) where c > 1) as bigint) as n_repeat_words
from (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents) d
"""


OP12 = r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') as t from documents
), sizes as materialized (
  select r, doc_id, cast(len(t) as bigint) as n from docs where len(t) > 0
), whole as (
  select count(*) as docs, cast(sum(n) as bigint) as total from sizes
), wanted as materialized (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) as term from benchmark
), held as materialized (
  select r, term, count(*) as tf from (select r, unnest(t) as term from docs) x where term in (select term from wanted) group by r, term
), weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from held, whole group by term, docs
), impacts as (
  select h.r, h.term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)) as value from held h join sizes s on h.r = s.r, whole
), scores as (
  select item_id, i.r, cast(sum(w * value) as bigint) as score from wanted a join weights b on a.term = b.term join impacts i on a.term = i.term group by item_id, i.r
)
select item_id, cast(k as int) as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as k from scores c join sizes s on c.r = s.r where score > 0) x where k <= 10
"""


def op12() -> str:
    return OP12.replace("{TERM}", TERM)


def op13(s: clustering.Settings = clustering.Settings()) -> str:
    """Every round as two steps: vectors to centroids, centroids to rounded-down means."""
    far = f"list_sum(list_transform(range(1, {s.dim + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    parts = [
        ("kept", f"""select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({s.scale} * cast(x as double)) as bigint)) as v from embeddings
        where len(embedding) = {s.dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {s.dim}"""),
        ("c0", f"select row_number() over (order by h, v) - 1 as c, v from (select sha256('{s.seed}:' || coalesce(cast(vec_id as varchar), '')) as h, v from kept order by h, v limit {s.k}) x"),
    ]
    for k in range(s.rounds + 1):
        parts.append((f"a{k}", f"select r, vec_id, any_value(v) as v, arg_min(c, d * {s.k} + c) as c, min(d) as d from (select x.*, c.c, cast({far} as hugeint) as d from kept x cross join c{k} c) y group by r, vec_id"))
        if k < s.rounds:
            total = f"select c, i, sum(v[i]) as t, count(*) as n from (select c, v, unnest(range(1, {s.dim + 1})) as i from a{k}) x group by c, i"
            parts.append((f"m{k}", f"select c, list(cast((t - ((t % n) + n) % n) // n as bigint) order by i) as v from ({total}) x group by c"))
            parts.append((f"c{k + 1}", f"select c.c, coalesce(m.v, c.v) as v from c{k} c left join m{k} m on c.c = m.c"))
    last = s.rounds
    return (
        "with " + ", ".join(f"{name} as materialized ({sql})" for name, sql in parts)
        + " select a.vec_id, cast(a.c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,"
        f" sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{last} a join c{last} c on a.c = c.c"
    )


def op3(rules: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    return OP3.replace("{rules}", rows)


def op5() -> str:
    """The steps in a row, with as many from the best start as Spark takes at most; further ones change nothing."""
    percentile = "quantile_cont({x}, {p})"
    steps = quality_rules.first_steps(percentile)
    for k in range(1, quality_rules.MOST_STEPS + 1):
        steps += quality_rules.next_steps(k, percentile)
    steps += quality_rules.last_steps(quality_rules.MOST_STEPS, percentile)
    narrow = "select doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words from base where not base_failed"
    base = f"select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from ({STATISTICS}) s"
    parts = [("base", base), ("stats", narrow), *[s[:2] for s in steps]]
    return (
        "with "
        + ", ".join(f"{name} as materialized ({sql})" for name, sql in parts)
        + " select b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed, round(d.d2, 6) as distance2,"
        f" not b.base_failed and coalesce(round(d.d2, 6), 0) <= {quality_rules.CUTOFF} as kept from base b left join distances d on b.doc_id = d.doc_id"
    )


def op6() -> str:
    return mixing.mixing_oracle(Mix(), f"select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), {WORDS})) as bigint) as size from documents")
