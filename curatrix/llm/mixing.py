"""Mixing sources to target weights (native: SQL functions only).

Each source's texts, laid end to end, are a stream of words cut into blocks of fixed length. A
source's slots read its blocks through a pseudorandom permutation of block indexes, pass after
pass, and every slot draws its output shard. The statements are written once, for Spark and for
the engine that checks them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import running
from .common import materialize, word_count
from .quality_rules import _named

#: The modulus of the permutation's arithmetic, a prime below 2^31, and its rounds.
PRIME, ROUNDS = 2147483647, 8
#: One copy of a document, in the integers of which running shares are sums.
ONE = 1 << 20
#: How each engine repeats one expression of (acc, k) over a list, and draws by a digest of the slot.
DRAWN = "concat(cast(sid as string), ',', cast(pass as string), ',', cast(j as string), ',', '{seed}')"
SPARK = {"draw": "cast(conv(substr(md5(" + DRAWN + "), 1, 15), 16, 10) as bigint) % {n}", "series": "explode(sequence(cast({a} as bigint), cast({b} as bigint)))", "fold": "aggregate(array({ks}), cast({x} as bigint), (acc, k) -> {body})"}
CHECKER = {"draw": "cast('0x' || substr(md5(" + DRAWN + "), 1, 15) as bigint) % {n}", "series": "unnest(generate_series(cast({a} as bigint), cast({b} as bigint)))", "fold": "list_reduce([cast({x} as bigint), {ks}], lambda acc, k: {body})"}


@dataclass(frozen=True)
class Mix:
    """Parameters. ``weights`` repeat over the sources in code point order; ``share`` is the total of
    all targets and ``cap`` the most of one, as multiples of sizes; ``buckets`` cuts a source's
    running sum into pieces that tasks share; ``run`` is how many slots one task's row makes."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    block: int = 128
    shards: int = 64
    seed: int = 20240229
    buckets: int = 16384
    run: int = 4096


def _permuted(x: str, n: str, p: Mix, fold: str, inverse: bool = False) -> str:
    """SQL of the place of ``x`` in a pseudorandom permutation of 0 to n - 1, from columns sid and pass.

    Swap-or-not rounds (Hoang, Morris and Rogaway, 2012): each swaps x with its mirror image or not,
    by a bit that both share, so a round undoes itself and the rounds in reverse order are the inverse.
    """
    key = f"((({p.seed} + sid * (48271 + 7919 * k) + pass * (69621 + 104729 * k)) % {PRIME}) * 39373 % {PRIME})"
    mirror = f"(({key} % {n} + {n} - acc) % {n})"
    bit = f"((greatest(acc, {mirror}) % {PRIME}) * (40692 + 1299709 * k) + {key}) % {PRIME} % 65521 % 2"
    ks = [f"cast({k} as bigint)" for k in range(ROUNDS)]
    return fold.format(x=x, ks=", ".join(ks[::-1] if inverse else ks), body=f"case when {bit} = 1 then {mirror} else acc end")


def mix_steps(p: Mix, engine: dict[str, str]) -> list[tuple[str, str]]:
    """(name, SQL) over a table ``sized(doc_id, source, size)``.

    The last steps are ``mixed``, a row per stretch of words that a slot takes from a document, and
    ``digest``, a row per document.
    """
    n_w, size = len(p.weights), p.block
    weight = " ".join(f"when {i} then {w}" for i, w in enumerate(p.weights))
    grow = lambda a, b: engine["series"].format(a=a, b=b)
    whole = lambda x: f"cast(floor({x} / {size}e0) as bigint)"
    bucket = f"((coalesce(doc_id, 0) % 1000003 + 1000003) % 1000003) * 7919 % {p.buckets}"
    return [
        ("totals", "select source, cast(sum(size) as bigint) as source_size from sized group by source"),
        ("numbered", "select *, cast(row_number() over (order by source nulls last) - 1 as bigint) as sid, sum(source_size) over () as total from totals"),
        ("weighted", f"select *, case sid % {n_w} {weight} end as w from numbered"),
        ("ratios", f"select *, {p.cap}e0 * source_size / w as ratio from weighted"),
        (
            "levels",
            f"select *, ({p.share}e0 * total - coalesce(sum({p.cap} * source_size) over (order by ratio, sid rows between unbounded preceding and 1 preceding), 0))"
            " / sum(w) over (order by ratio, sid rows between current row and unbounded following) as lam from ratios",
        ),
        ("level", "select max(lam) as lam from levels where lam <= ratio"),
        ("targets", f"select t.source, t.sid, t.source_size, least({p.cap}e0 * t.source_size, t.w * l.lam) as target from ratios t join level l on l.lam is not null"),
        ("quotas", f"select *, cast(round(target) as bigint) as quota, {whole(f'(source_size + {size - 1})')} as nb from targets where source_size > 0"),
        ("passes", f"select *, {grow(0, p.cap - 1)} as pass from quotas"),
        ("parts", f"select *, source_size - (nb - 1) * {size} as short, least(source_size, quota - pass * source_size) as rest from passes where quota > pass * source_size"),
        ("ends", f"select sid, pass, nb, short, rest, {_permuted('nb - 1', 'nb', p, engine['fold'], inverse=True)} as j0 from parts"),
        ("runs", f"select sid, pass, nb, short, rest, j0, {grow(0, f'cast(floor({whole(f"(rest - 1 + {size} - short)")} / {p.run}e0) as bigint)')} as chunk from ends"),
        ("slots", f"select sid, pass, nb, short, rest, j0, {grow(f'chunk * {p.run}', f'least(chunk * {p.run} + {p.run - 1}, nb - 1, {whole(f"(rest - 1 + {size} - short)")})')} as j from runs where chunk * {p.run} < nb"),
        ("begun", f"select *, j * {size} - case when j > j0 then {size} - short else 0 end as before from slots"),
        ("mapped", f"select *, {_permuted('j', 'nb', p, engine['fold'])} as block from begun where before < rest"),
        (
            "drawn",
            f"select sid, pass, j, block, least(case when block = nb - 1 then short else {size} end, rest - before) as take,"
            f" cast({engine['draw'].format(seed=p.seed, n=p.shards)} as int) as shard from mapped",
        ),
        ("homes", f"select s.doc_id, s.size, t.sid, {bucket} as bucket from sized s join targets t on s.source is not distinct from t.source where s.size > 0"),
        ("counted", "select sid, bucket, sum(size) as n from homes group by sid, bucket"),
        ("offsets", "select sid, bucket, coalesce(sum(n) over (partition by sid order by bucket rows between unbounded preceding and 1 preceding), 0) as base from counted"),
        ("running", "select *, coalesce(sum(size) over (partition by sid, bucket order by doc_id, size rows between unbounded preceding and 1 preceding), 0) as within from homes"),
        ("placed", "select r.doc_id, r.sid, r.size, cast(o.base + r.within as bigint) as begins from running r join offsets o on r.sid = o.sid and r.bucket = o.bucket"),
        ("pieces", f"select *, {grow(whole('begins'), whole('(begins + size - 1)'))} as block from placed"),
        ("cut", f"select *, greatest(begins - block * {size}, 0) as lo, least(begins + size - block * {size}, {size}) as hi from pieces"),
        ("met", "select d.shard, d.pass, d.j as slot, c.sid, c.block, c.doc_id, c.begins, c.size, d.take, c.lo, c.hi from cut c join drawn d on c.sid = d.sid and c.block = d.block"),
        ("mixed", f"select shard, pass, slot, sid, block, doc_id, begins, size, block * {size} + lo - begins as from_word, least(hi, take) - lo as n_words from met where least(hi, take) > lo"),
        ("sums", "select sid, begins, sum(n_words) as n, sum(n_words * (shard + 1)) as spread from mixed group by sid, begins"),
        (
            "digest",
            "select p.doc_id, cast(p.size as bigint) as size, cast(t.source_size as bigint) as source_size, t.target, cast(coalesce(s.n, 0) as bigint) as taken, cast(coalesce(s.spread, 0) as bigint) as spread"
            " from placed p join targets t on p.sid = t.sid left join sums s on p.sid = s.sid and p.begins = s.begins"
            " union all select z.doc_id, cast(0 as bigint), cast(t.source_size as bigint), t.target, cast(0 as bigint), cast(0 as bigint) from sized z join targets t on z.source is not distinct from t.source where z.size = 0",
        ),
    ]


def _numbered(known: dict[str, DataFrame], p: Mix) -> DataFrame:
    """The step of that name without a window over all sources, as there may be a source per web domain."""
    total = known["totals"].agg(F.sum("source_size")).first()[0]
    return running(known["totals"], [F.col("source").asc_nulls_last()], {"sid": F.lit(1)}).withColumn("total", F.lit(total).cast("long"))


def _levels(known: dict[str, DataFrame], p: Mix) -> DataFrame:
    weight = F.col("w").cast("long")
    every = known["ratios"].agg(F.sum(weight)).first()[0] or 0
    below = running(known["ratios"], [F.col("ratio"), F.col("sid")], {"sizes": F.col("source_size"), "weights": weight})
    return below.withColumn("lam", (p.share * F.col("total") - p.cap * F.col("sizes")) / (F.lit(every) - F.col("weights"))).drop("sizes", "weights")


#: Steps that Spark takes by ranges.
WIDE = {"numbered": _numbered, "levels": _levels}


def mix_sources(docs: DataFrame, p: Mix = Mix()) -> dict[str, DataFrame]:
    """Mix ``docs(doc_id, text, source)``: the tables of ``mix_steps``, of which these are for use:

    ``targets(source, sid, source_size, target)``; ``drawn(sid, pass, j, block, take, shard)``, the
    output slots; ``mixed(shard, pass, slot, sid, block, doc_id, begins, size, from_word, n_words)``,
    the words each slot takes; ``digest(doc_id, size, source_size, target, taken, spread)``, a row per input row:
    ``spread`` sums the taken words, each times one more than the number of its shard.

    Targets share ``share`` times all words by weight; a source whose share exceeds ``cap`` times its
    words gets that, and the excess is shared by weight among the others until none is above. The
    shards' counts of a source are a multinomial draw given its total (each slot draws its shard by a
    digest), so each total is its target to within half a word, and no word is taken more than ``cap`` times. Equal input gives equal output.

    Null texts and texts without words have size 0 and take nothing. A null source is one of the
    sources, the last. Rows with equal doc_id each have their own words. No rows, or no words at
    all: targets 0. Other columns are ignored. A source of any share of the rows is dealt over
    ``buckets`` by doc_id, its slots in runs of ``run``.
    """
    spark = docs.sparkSession
    known = {"sized": materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, sql in mix_steps(p, SPARK):
        if name in WIDE:
            known[name] = WIDE[name](known, p)
            continue
        known[name] = spark.sql(_named(sql, known), **{k: v for k, v in known.items() if _named(sql, [k]) != sql})
        if name in ("targets", "ends", "drawn", "placed"):
            known[name] = materialize(known[name], name)
        if name == "runs":
            known[name] = known[name].repartition(n, "sid", "pass", "chunk")
    return known


def repeat_by_mix(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words, all columns kept.

    What rounding leaves of a document is carried along its source, short documents first: copies are
    the whole number of the running share up to and with the document less that before it. So a
    source's copies meet its share among documents of about any length, whatever the ratio. Running
    shares are integers, summed within buckets of a length and added to those before.

    Rows that share a doc_id are counted together, with the first of their sources. Rows without words go.
    """
    known = mix_sources(docs, p)
    sums = known["sums"].select(F.col("sid").alias("__sid"), F.col("begins").alias("__begins"), "n")
    rows = known["placed"].join(sums, (F.col("sid") == F.col("__sid")) & (F.col("begins") == F.col("__begins")), "left")
    of_doc = rows.groupBy("doc_id").agg(F.min("sid").alias("sid"), F.sum("size").alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("taken"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(p.buckets))
    shares = materialize(of_doc.select("doc_id", "sid", F.floor(F.log2("size") * 2).alias("length"), bucket.alias("bucket"), F.floor(F.col("taken") * ONE / F.col("size")).alias("share")), "shares")
    before = Window.partitionBy("sid").orderBy("length", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shares.groupBy("sid", "length", "bucket").agg(F.sum("share").alias("n")).select("sid", "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "length", "bucket").orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = shares.withColumn("within", F.sum("share").over(within)).join(offsets, ["sid", "length", "bucket"])
    whole = lambda x: F.floor((x + ONE // 2) / ONE)
    upto = F.col("base") + F.col("within")
    taken = run.select("doc_id", (whole(upto) - whole(upto - F.col("share"))).cast("int").alias("__copies"))
    # A row travels as one value, so no column of its can clash with those here.
    whole_rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own"))
    joined = whole_rows.join(taken.where("__copies > 0"), F.col("own").eqNullSafe(F.col("doc_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy")).select("row.*")


def mixing_oracle(p: Mix, sized: str) -> str:
    """The digest as one statement for an engine with ``unnest(generate_series(a, b))``."""
    steps = mix_steps(p, CHECKER)
    return f"with sized as materialized ({sized}), " + ", ".join(f"{name} as materialized ({sql})" for name, sql in steps) + " select * from digest"


