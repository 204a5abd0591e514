"""Quality rules: robust multivariate outliers per language and source (native: SQL functions only).

The minimum covariance determinant is estimated as the deterministic variant does it (Hubert, Rousseeuw
and Verdonck, 2012): from several starts, concentration steps keep the nearest half of a group and
estimate centre and covariance from it, until the determinant falls no further (by a hundredth); the least one wins. A
step is one grouped sum of integers, so results don't depend on how rows are dealt to tasks. The
statements are written once, for Spark and for the engine that checks them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, materialize, word_count

#: The transformed statistics, in thousandths of a natural logarithm.
FEATURES = {
    "x1": "1000 * ln(1e0 + n_words)",
    "x2": "1000 * ln((1e0 + word_chars) / (1e0 + n_words))",
    "x3": "1000 * ln(1e0 + 2e1 * n_symbols / (1e0 + n_words))",
    "x4": "1000 * ln(1e0 + 1e1 * n_repeat_words / (1e0 + n_words))",
    "x5": "1000 * ln(1e0 + n_dup_lines)",
}
X = list(FEATURES)
#: Added to each variance (a standard deviation of 0.8 in natural logarithms), so that a statistic that is 0
#: nearly everywhere has a scale, and a difference of that size is nothing unusual in any group.
RIDGE = 640000
#: A group needs so many rows for an estimate of its own; smaller ones join their language's rest, then all rests.
MIN_GROUP = 60
#: Quantiles of chi-square with five degrees of freedom: half, what the last estimate rests on (97.5 %), and the
#: cut (99.9 %) beyond which a row is rejected.
MIDDLE, WITHIN, CUTOFF = 4.351460, 12.832502, 20.515006
#: The bound on the steps from the best start.
MOST_STEPS = 16


def text_statistics(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text, all long.

    Words are compared by chained 64-bit hashes of three at a time. A text without repeated windows
    needs one pass; only others sort their windows (n log n, so very long texts stay cheap).
    """
    text = F.coalesce(text, F.lit(""))
    n = word_count(text)
    lines = let(F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD)), lambda a: F.size(a) - F.size(F.array_distinct(a)))

    def repeated(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            placed,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, j + 1)["h"] == x["h"]).eqNullSafe(True)),
                            lambda x: F.sequence(x["i"], x["i"] + 2),
                        )
                    )
                )
            ),
        )

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    windows = let(
        words,
        lambda w: F.transform(
            F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    )
    repeats = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeated(h)))
    return F.struct(
        n.alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
    )


def _cholesky() -> tuple[str, str]:
    """SQL of the factor's entries from covariance columns, level by level, and of the squared distance."""
    d = len(X)
    nested = "select * from {inner}"
    for j in range(d):
        diagonal = f"sqrt(s{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j)) + f") as l{j}{j}"
        nested = f"select *, {diagonal} from ({nested}) q{j}a"
        if j + 1 < d:
            below = ", ".join(f"(s{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} as l{i}{j}" for i in range(j + 1, d))
            nested = f"select *, {below} from ({nested}) q{j}b"
    return nested, " + ".join(f"z{i} * z{i}" for i in range(d))


def _moments(kept: str, source: str) -> str:
    """SQL of a group's centre and regularised covariance from the rows where ``kept``."""
    d = len(X)
    sums = ", ".join(f"sum({x}) as t{i}" for i, x in enumerate(X))
    cross = ", ".join(f"sum({X[i]} * {X[j]}) as c{i}{j}" for i in range(d) for j in range(i, d))
    centre = ", ".join(f"cast(t{i} as double) / n as m{i}" for i in range(d))
    spread = ", ".join(
        f"cast(c{i}{j} as double) / n - (cast(t{i} as double) / n) * (cast(t{j} as double) / n)" + f" + {RIDGE}" * (i == j) + f" as s{i}{j}"
        for i in range(d)
        for j in range(i, d)
    )
    return f"select grp, n, {centre}, {spread} from (select grp, count(*) as n, {sums}, {cross} from {source} where {kept} group by grp) sums"


def _distances(rows: str, estimate: str, carry: str = "", values: list[str] = X) -> str:
    """SQL of ``carry``, the group, X and ``d2``, the squared Mahalanobis distance of each row's ``values``, by
    forward substitution."""
    factor, square = _cholesky()
    names = [f"l{i}{j}" for i in range(len(X)) for j in range(i + 1)] + [f"m{i}" for i in range(len(X))]
    inner = f"select r.*, {', '.join('e.' + n for n in names)} from {rows} r join ({factor.replace('{inner}', estimate)}) e on r.grp = e.grp"
    for i in range(len(X)):
        z = f"({values[i]} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i} as z{i}"
        inner = f"select *, {z} from ({inner}) z{i}q"
    return f"select {carry}grp, {', '.join(X)}, {square} as d2 from ({inner}) dist"


#: A step is (name, SQL, whether later steps read it more than once).
Step = tuple[str, str, bool]
D = range(len(X))
MOMENTS = ["grp", "n", *(f"m{i}" for i in D), *(f"s{i}{j}" for i in D for j in range(i, len(X)))]
LOGDET = " + ".join(f"ln(l{i}{i})" for i in D)


def _binned(table: str) -> str:
    return f"select *, cast(floor(least(d2, 1e5) * 16) as bigint) as bin from {table}"


def _concentrate(k: str, rows: str, distances: str, percentile: str) -> list[Step]:
    return [
        (f"cuts{k}", f"select grp, {percentile.format(x='bin', p=0.5)} as cut from ({_binned(distances)}) b group by grp", False),
        (f"near{k}", f"select b.* from ({_binned(distances)}) b join cuts{k} c on b.grp = c.grp where b.bin <= c.cut", False),
        (f"estimate{k}", _moments("true", f"near{k}"), True),
        (f"distances{k}", _distances(rows, f"estimate{k}"), False),
    ]


def first_steps(percentile: str) -> list[Step]:
    """From ``stats(doc_id, lang, source, ...)`` to ``distances0``, by the best of three starts in each group.

    ``percentile``: the engine's exact percentile with ``{x}`` and ``{p}``; it sees integers of a
    bounded range, so its state is bounded too. The starts order a group's rows by their norm, by the
    scatter of hyperbolic tangents and by that of spatial signs, all of values standardised by median
    and scale, and take two concentration steps each.
    """
    whole = ", ".join(f"cast(round({sql}) as bigint) as {x}" for x, sql in FEATURES.items())
    kept = ", ".join(X)
    ys = ", ".join(f"cast(round(1000 * ({x} - m{i}) / sqrt(2.2e0 * w{i} * w{i} + {RIDGE})) as bigint) as y{i}" for i, x in enumerate(X))
    norm = "sqrt(1e0 + " + " + ".join(f"1e0 * y{i} * y{i}" for i in D) + ")"
    placed = "stats s join homes h on s.lang is not distinct from h.lang and s.source is not distinct from h.source"
    steps = [
        ("sizes", "select lang, source, count(*) as n from stats group by lang, source", True),
        ("rests", f"select lang, sum(n) as rest from sizes where n < {MIN_GROUP} group by lang", False),
        (
            "homes",
            f"select s.lang, s.source, case when s.n >= {MIN_GROUP} then concat('s', coalesce(s.lang, ''), chr(31), coalesce(s.source, ''), chr(31), case when s.lang is null then '-' else '' end, case when s.source is null then '-' else '' end)"
            f" when r.rest >= {MIN_GROUP} then concat('l', coalesce(s.lang, ''), case when s.lang is null then '-' else '' end) else 'all' end as grp from sizes s left join rests r on s.lang is not distinct from r.lang",
            True,
        ),
        ("points", f"select h.grp, {whole} from {placed}", True),
        ("whole", f"select s.doc_id, h.grp, {whole} from {placed}", False),
        ("medians", "select grp, " + ", ".join(f"cast({percentile.format(x=x, p=0.5)} as double) as m{i}" for i, x in enumerate(X)) + " from points group by grp", True),
        (
            "scales",
            "select p.grp, " + ", ".join(f"cast({percentile.format(x=f'cast(abs({x} - m{i}) as bigint)', p=0.5)} as double) as w{i}" for i, x in enumerate(X)) + " from points p join medians m on p.grp = m.grp group by p.grp",
            True,
        ),
        ("narrow", f"select p.grp, {kept}, {ys} from points p join medians m on p.grp = m.grp join scales w on p.grp = w.grp", True),
        ("ordered0", f"select concat('n', grp) as grp, {kept}, " + " + ".join(f"y{i} * y{i} / 1e6" for i in D) + " as d2 from narrow", False),
    ]
    shapes = {"t": "1000 * tanh(y{i} / 1e3)", "s": "2000 * y{i} / " + norm}
    each = " union all ".join(f"select concat('{n}', grp) as grp, " + ", ".join(f"cast(round({shape.format(i=i)}) as bigint) as {x}" for i, x in enumerate(X)) + " from narrow" for n, shape in shapes.items())
    both = " union all ".join(f"select concat('{n}', grp) as grp, {kept}, {', '.join(f'y{i}' for i in D)} from narrow" for n in shapes)
    steps += [
        ("shapes", each, False),
        ("scatter", _moments("true", "shapes"), True),
        ("shaped", both, False),
        ("starts", f"select * from ordered0 union all {_distances('shaped', 'scatter', values=[f'y{i}' for i in D])}", True),
    ]
    steps += _concentrate("a", "starts", "starts", percentile) + _concentrate("b", "starts", "distancesa", percentile)
    columns = ", ".join(MOMENTS[1:])
    factor = _cholesky()[0].replace("{inner}", "estimateb")
    ranked = f"select *, row_number() over (partition by substr(grp, 2) order by {LOGDET}, grp) as k from ({factor}) f"
    return [*steps, ("least", f"select substr(grp, 2) as grp, {columns} from ({ranked}) r where k = 1", True), ("distances0", _distances("narrow", "least"), False)]


def next_steps(k: int, percentile: str) -> list[Step]:
    """The k-th concentration step from the best start. Groups whose determinant it lowers by a hundredth at
    least (``fell`` in ``estimate{k}``) take its estimate, the others keep theirs: so further steps change
    nothing once none fell."""
    sized = lambda estimate: f"(select *, {LOGDET} as v from ({_cholesky()[0].replace('{inner}', estimate)}) f)"
    before = f"estimate{k - 1}" if k > 1 else "least"
    cuts, near, (_, moments, _), _ = _concentrate(str(k), "narrow", f"distances{k - 1}", percentile)
    chosen = ", ".join(f"case when c.v < e.v - 5e-3 then c.{m} else e.{m} end as {m}" for m in MOMENTS[1:])
    return [
        cuts,
        near,
        (f"candidate{k}", moments, False),
        (f"estimate{k}", f"select e.grp, {chosen}, c.v < e.v - 5e-3 as fell from {sized(before)} e join {sized(f'candidate{k}')} c on e.grp = c.grp", True),
        (f"distances{k}", _distances("narrow", f"estimate{k}"), False),
    ]


def last_steps(k: int, percentile: str) -> list[Step]:
    """From the k-th step to ``distances(doc_id, d2)``: all rows within the 97.5 % ellipsoid give the estimate.

    A covariance from the nearest half is too small; the median of d2 puts its scale right (the factor
    of consistency), first over all rows, of which up to half may be junk, then over the good ones.
    """
    middle = lambda t: f"select grp, ({percentile.format(x='bin', p=0.5)} + 5e-1) / 16 as half from ({_binned(t)}) b group by grp"
    return [
        ("middle0", middle(f"distances{k}"), True),
        ("good0", f"select d.* from distances{k} d join middle0 m on d.grp = m.grp where d.d2 / greatest(m.half / {MIDDLE}e0, 25e-2) <= {WITHIN}", False),
        ("estimate", _moments("true", "good0"), True),
        ("middle", middle(f"({_distances('good0', 'estimate')}) g"), True),
        ("far", _distances("whole", "estimate", "doc_id, "), False),
        ("distances", f"select f.doc_id, f.d2 / greatest(m.half / {MIDDLE}e0, 25e-2) as d2 from far f join middle m on f.grp = m.grp", False),
    ]


def judge_quality(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``docs(doc_id, text, lang, source)``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance2, kept``. A row is kept unless it fails the base rules (fewer than 50 words, or more
    than half of its words in repeated three-word windows) or its robust squared Mahalanobis distance
    within its language and source exceeds ``CUTOFF``, which a normal row does once in a thousand.

    Texts that fail the base rules take no part in the estimates and have a null distance. Null or
    empty texts have no words and fail. Null languages and sources are groups of their own; groups of
    under ``MIN_GROUP`` rows share the estimate of their language's small ones, then of all small ones.
    Rows with the same doc_id are judged each by its own text. Other columns are ignored; an empty
    table gives no rows. The texts are read once; all that follows runs on narrow statistics.
    """
    s = docs.select("doc_id", "lang", "source", text_statistics(F.col("text")).alias("s")).select("doc_id", "lang", "source", "s.*")
    return with_verdicts(materialize(s.withColumn("base_failed", _failed()), "statistics")).drop("lang", "source")


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, all columns kept; each row by its own text. The texts are
    written once beside their statistics, and not shuffled."""
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select("lang", "source", text_statistics(F.col("text")).alias("s"), F.struct(*names).alias("doc_id"))
    base = rows.select("lang", "source", "s.*", "doc_id").withColumn("base_failed", _failed())
    return with_verdicts(materialize(base, "statistics")).where("kept").select("doc_id.*").select(names)


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_verdicts(base: DataFrame) -> DataFrame:
    """``base`` with ``distance2`` and ``kept``, from its statistics.

    What several steps reread (the points, and a row per group for each estimate) is written as a
    table, so that a step's plan doesn't hold those before it. Steps go on until no determinant falls.
    """
    spark, percentile = base.sparkSession, "percentile({x}, {p})"
    known = {"stats": base.where("not base_failed").withColumn("doc_id", F.struct(*base.columns))}

    def take(steps: list[Step]) -> None:
        for name, sql, keep in steps:
            known[name] = spark.sql(_named(sql, known), **{k: v for k, v in known.items() if _named(sql, [k]) != sql})
            if keep:
                known[name] = materialize(known[name], name)

    take(first_steps(percentile))
    for k in range(1, MOST_STEPS + 1):
        take(next_steps(k, percentile))
        if known[f"estimate{k}"].where("fell").isEmpty():
            break
    take(last_steps(k, percentile))
    far = known["distances"].select("doc_id.*", F.round("d2", 6).alias("distance2"))
    out = far.union(base.where("base_failed").withColumn("distance2", F.lit(None).cast("double")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF))


def _named(sql: str, names) -> str:
    """Put the tables of those names as parameters of ``spark.sql``."""
    return re.sub(r"\b(from|join) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in names else m[0], sql)
