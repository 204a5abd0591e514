"""Training jobs end to end."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import identity_key
from ..functions.session import cut, fresh_folder
from ..operators import boosting as B
from ..operators import features as X
from ..operators import joins as J
from ..operators import learning as N
from ..operators import metrics as M
from ..operators import splits as G
from .boosting_sql import bins, boosting
from .catalog import base, query, rounded


def run_endpoint(df: DataFrame, row_id: str, value: str, group: str, label: str, exprs: dict[str, Column], seed: int = 42, **fit) -> dict:
    """Split by group, featurize and deduplicate within each split, fit on train, measure on all."""
    split = G.group_split(df.where(F.col(label).isNotNull()), group, seed=seed)
    ready = G.per_split(X.featurize(split, row_id, value, identity_key(F.col(value)), exprs).where("is_valid"), row_id, "key", label)
    ready = cut(ready)
    G.require_splits(ready, ["train", "test"])
    model = N.fit_endpoint(ready.where("split = 'train'"), list(exprs), label, **fit)
    scored = N.score(model, ready)
    return {"model": model, "ready": ready, "metrics": M.ranking(scored, "score", label, ["split"])}


def score_list(df: DataFrame, row_id: str, value: str, name: str, exprs: dict[str, Column], models: dict[str, PipelineModel]) -> DataFrame:
    """Scores of a raw list, wide, with display names; null for invalid values."""
    full = X.featurize(df, row_id, value, identity_key(F.col(value)), exprs)
    wide = N.wide_scores(N.score_batch(full, row_id, models, F.col("is_valid")), row_id, list(models))
    return J.first_name(full.select(row_id, "key"), full.select(row_id, "key", name), "key", name, row_id).join(wide, row_id)


def _exprs() -> dict[str, Column]:
    t = F.col("text")
    return {"chars": F.length(t), "symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")), "upper": F.regexp_count(t, F.lit("[A-Z]"))}


def _docs(spark, d) -> DataFrame:
    return base(spark, d).drop("key")


FIT: dict[str, float] = {"depth": 3, "step": 0.3, "rounds": 4}


@query()
def endpoint_run(spark, d):
    return run_endpoint(_docs(spark, d), "doc_id", "text", "source", "quality", _exprs(), **FIT)["metrics"]


@query()
def scored_list(spark, d):
    docs = _docs(spark, d)
    model = run_endpoint(docs, "doc_id", "text", "source", "quality", _exprs(), **FIT)["model"]
    return score_list(docs, "doc_id", "text", "source", _exprs(), {"quality": model})


# ---- boosting, grown alike in both engines --------------------------------------------------------

#: Features of a text and their bins' edges.
NAMES = ["chars", "words", "symbols", "upper"]
EDGES = [[100.0, 200.0, 400.0, 800.0, 1600.0, 3200.0], [20.0, 40.0, 80.0, 160.0, 320.0, 640.0], [0.0, 1.0, 2.0, 5.0, 10.0], [2.0, 5.0, 10.0, 20.0, 50.0]]
TEXT = ["length(text)", "len(string_split(text, ' '))", "len(regexp_extract_all(text, '[#*$%&|<>]'))", "len(regexp_extract_all(text, '[A-Z]'))"]


def _rows(spark, d, label: str) -> DataFrame:
    t = F.col("text")
    exprs = {"chars": F.length(t), "words": F.size(F.split(t, " ")), "symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")), "upper": F.regexp_count(t, F.lit("[A-Z]"))}
    return X.descriptors(base(spark, d), exprs).where(F.col(label).isNotNull()).select("doc_id", "n_chars", F.col(label).alias("y"), *NAMES)


def _sql(label: str, learn: str, name: str = "x", where: str = "true") -> str:
    return f"{name} as materialized (select doc_id as id, n_chars, {label} as y, {bins(TEXT, EDGES)} as b, {learn} as learn from d where {label} is not null and {where})"


def _order():
    return F.col("doc_id") * 104729 + F.col("n_chars") * 7919


#: The loss of staged margins (r, id, m) of rows (id, y).
LOSS = "select r, count(*) as n, avg(ln(1 + exp(case when y = 1 then -1e0 else 1e0 end * m / 1e6))) as loss from {stages} s join {rows} x on s.id = x.id where not x.learn group by r"
#: The area under the curve of each round.
AREA = """select r, case when sum(p) > 0 and sum(q) > 0 then sum(q * (pa + p / 2e0)) / (sum(p)::double * sum(q)) end as auc from (
  select *, coalesce(sum(p) over (partition by r order by m desc rows between unbounded preceding and 1 preceding), 0) as pa from (
    select r, m, sum(y) as p, count(*) - sum(y) as q from {stages} s join {rows} x on s.id = x.id where not x.learn group by r, m) h) k group by r"""


def _stages(name: str, rounds: int) -> str:
    return " union all ".join(f"select {r} as r, id, m from {name}_m{r + 1}" for r in range(rounds))


def _steps(*parts: str) -> str:
    return "with {BASE}, " + ", ".join(parts)


@query(_steps(_sql("quality", "true"), *boosting("x", 3, 3, 0.3, 3.0)) + " select * from b_trees")
def boosted_trees(spark, d):
    """Three trees of depth 3, node by node."""
    run = B.fit_boosted(_rows(spark, d, "quality"), NAMES, "y", B.Boosting(depth=3, step=0.3, rounds=3), edges=EDGES)
    return B.tree_table(spark, run.ensemble)


@query(_steps(_sql("toxic", "doc_id % 5 <> 0"), *boosting("x", 6, 2, 0.5, 3.0), f"st as materialized ({_stages('b', 6)})", f"lo as ({LOSS.format(stages='st', rows='x')})", f"ar as ({AREA.format(stages='st', rows='x')})")
       + " select cast(lo.r as int) as round, n, auc, loss, lo.r = (select arg_min(r, (round(loss, 9), r)) from lo) as best from lo join ar on lo.r = ar.r")
@rounded("auc", "loss")
def staged_losses(spark, d):
    """Each round's metrics on rows that weren't learned from, all rounds of a pass; the best is what a refit freezes."""
    rows = _rows(spark, d, "toxic").withColumn("stops", F.col("doc_id") % 5 == 0)
    run = B.fit_boosted(rows, NAMES, "y", B.Boosting(depth=2, step=0.5, rounds=6, metric="loss", every=4), "stops", edges=EDGES)
    return spark.createDataFrame([(*s, s[0] == run.best_iteration) for s in run.stages], "round int, n long, auc double, loss double, best boolean")


@query(_steps(_sql("toxic", "doc_id % 5 <> 0"), "y as (select * replace (true as learn) from x)", *boosting("x", 6, 2, 0.5, 3.0), *boosting("y", 6, 2, 0.5, 3.0, name="f"), f"st as materialized ({_stages('b', 6)})", f"fi as materialized ({_stages('f', 6)})", f"lo as ({LOSS.format(stages='st', rows='x')})")
       + " select id as doc_id, 1 / (1 + exp(-(m / 1e6))) as score from fi where r = (select arg_min(r, (round(loss, 9), r)) from lo)")
@rounded("score")
def final_refit(spark, d):
    """All rows, with as many rounds as a validated run, saved and read back, found best."""
    path = fresh_folder(spark, "run")
    rows = cut(_rows(spark, d, "toxic").withColumn("stops", F.col("doc_id") % 5 == 0))
    s = B.Boosting(depth=2, step=0.5, rounds=6, metric="loss")
    B.save_run(spark, path, B.fit_boosted(rows, NAMES, "y", s, "stops", edges=EDGES), dataset="documents")
    found = B.refit_boosted(rows, NAMES, "y", B.load_run(spark, path)[0], s)
    return B.score_boosted(found.ensemble, rows).select("doc_id", "score")


#: Old rows, and the new ones of which a fifth of each class, the first by a hash, is held out.
ROUNDS = [
    _sql("toxic", "true", "old", "doc_id % 3 <> 0"),
    _sql("toxic", "true", "new0", "doc_id % 3 = 0"),
    """new as materialized (select * exclude (k, n) replace (k >= floor(n * 0.2e0) as learn) from (select *, row_number() over (partition by y order by (id * 104729 + n_chars * 7919) % 10007, id * 104729 + n_chars * 7919) - 1 as k,
    count(*) over (partition by y) as n from new0) z)""",
    *boosting("old", 2, 2, 0.5, 3.0, name="p"),
    # The parent's margins of the new rows: rows to judge, none to learn from.
    "seen as materialized (select * from old union all by name select * replace (false as learn) from new)",
    *boosting("seen", 2, 2, 0.5, 3.0, name="q"),
    "off as materialized (select id, m from q_m2 where id in (select id from new))",
    *boosting("new", 4, 2, 0.5, 3.0, name="c", start="off"),
    f"st as materialized ({_stages('c', 4)})",
    f"lo as ({LOSS.format(stages='st', rows='new')})",
    "best as (select arg_min(r, (round(loss, 9), r)) as r from lo)",
]


def _increment(spark, d) -> tuple[B.Ensemble, dict]:
    rows = cut(_rows(spark, d, "toxic"))
    old, new = rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 = 0")
    parent = B.fit_boosted(old, NAMES, "y", B.Boosting(depth=2, step=0.5, rounds=2), edges=EDGES).ensemble
    return parent, N.fit_increment(parent, new, "y", "doc_id", _order(), old, 0.2, many=3, depth=2, step=0.5, rounds=4, metric="loss")


@query(_steps(*ROUNDS, f"ar as ({AREA.format(stages='st', rows='new')})")
       + " select (select count(*) from new where not learn and y = 1) as n_pos, (select count(*) from new where not learn and y = 0) as n_neg, auc, cast(best.r + 1 as int) as n_new, best.r + 3 >= 3 as too_many from ar join best on ar.r = best.r")
@rounded("auc")
def incremental_round(spark, d):
    """Trees of new rows on top of a parent's; what was held out of the new rows first gives the metrics."""
    _, got = _increment(spark, d)
    return got["metrics"].select("n_pos", "n_neg", "auc", F.lit(got["n_new"]).alias("n_new"), F.lit(got["too_many"]).alias("too_many"))


@query(_steps(*ROUNDS) + " select tree, node, feature, cut, value, 'parent' as origin from p_trees union all select cast(tree + 2 as int), node, feature, cut, value, 'increment' from c_trees where tree <= (select r from best)")
def increment_trees(spark, d):
    """The ensemble after an increment, node by node: the parent's trees, as they were, then the new ones."""
    parent, got = _increment(spark, d)
    n = len(parent.trees)
    return B.tree_table(spark, got["run"].ensemble).withColumn("origin", F.when(F.col("tree") < n, "parent").otherwise("increment"))


@query(_steps(_sql("quality", "true"), *boosting("x", 3, 3, 0.3, 3.0)) + " select x.id as doc_id, case when x.b[1] >= 1 then 1 / (1 + exp(-(m.m / 1e6))) end as quality from x join b_m3 m on x.id = m.id")
@rounded("quality")
def batch_scoring(spark, d):
    """Scores of all labelled rows, a column per endpoint; none for texts of up to 100 characters (the first bin), which aren't valid."""
    rows = _rows(spark, d, "quality")
    models = {"quality": B.fit_boosted(rows, NAMES, "y", B.Boosting(depth=3, step=0.3, rounds=3), edges=EDGES).ensemble}
    return N.wide_scores(N.score_batch(rows, "doc_id", models, F.col("chars") > 100), "doc_id", list(models))
