"""Multi-component records: split, classify, arbitrate, never guess.

A record is text of delimited components. Its components are exploded once; dictionary matches are
equi-joins; all decisions of a record fall in one grouped aggregation by its id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import identity_key, is_missing

Rule = Callable[[Column], Column]

#: The statuses in their fixed order, and those that may enter the clean table.
STATUSES = ("clean", "salt_removed", "mixture", "metal_complex", "ambiguous_fragment", "no_parent", "invalid_smiles", "duplicate")
ELIGIBLE = ("clean", "salt_removed")

#: Symbols that are never removed, and the dictionaries of whole components.
BLOCKED_SYMBOLS = (
    "Li", "Na", "K", "Rb", "Cs", "Fr", "Be", "Mg", "Ca", "Sr", "Ba", "Ra", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Y", "Zr", "Nb", "Mo",
    "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Al", "Ga", "In", "Sn", "Tl", "Pb", "Bi", "La", "Ce", "Pr", "Nd",
    "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu", "Ac", "Th", "Pa", "U", "Np", "Pu",
)
SOLVENTS = (
    "CO", "CCO", "CC(C)O", "CC(C)=O", "CS(C)=O", "O=CN(C)C", "C1CCOC1",
)
REMOVABLE = (
    "O", "[NH4+]", "Cl", "[Cl-]", "Br", "[Br-]", "I", "[I-]", "[OH-]", "OS(=O)(=O)O", "OP(=O)(O)O", "O=[N+]([O-])O", "OC(=O)O", "CS(=O)(=O)O",
    "Cc1ccc(cc1)S(=O)(=O)O", "OC(=O)C(=O)O",
)
PROTECTED = (
    "CC(=O)O", "CC(=O)[O-]", "OC(=O)CC(O)(CC(=O)O)C(=O)O", "OC(=O)CCC(=O)O", "OC(=O)/C=C/C(=O)O", "OC(=O)C=CC(=O)O", "OC(=O)C(O)C(O)C(=O)O", "OC=O",
    "[O-]C=O", "OC(=O)C(F)(F)F", "[O-]C(=O)C(F)(F)F",
)


def components(df: DataFrame, row_id: str, value: str, delim: str = ".") -> DataFrame:
    """``row_id, pos, component, n`` for every non-empty component."""
    parts = F.filter(F.split(F.trim(value), _literal(delim)), lambda x: x != "")
    return df.select(row_id, F.posexplode(parts).alias("pos", "component"), F.size(parts).alias("n"))


def _literal(delim: str) -> str:
    return "\\Q" + delim + "\\E"


def bracket_symbols(c: Column) -> Column:
    """The symbols of bracketed atoms, after an isotope number."""
    return F.regexp_extract_all(c, F.lit(r"\[[0-9]*([A-Z][a-z]?)"), F.lit(1))


def is_blocked(c: Column, symbols: Sequence[str] = BLOCKED_SYMBOLS) -> Column:
    """Whether a bracketed atom has one of the symbols."""
    return F.arrays_overlap(bracket_symbols(c), F.array(*map(F.lit, symbols)))


def has_parent_token(c: Column) -> Column:
    """Whether carbon occurs: bare C or c (but not Cl), or in brackets (C4)."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", ""), "Cl", "")
    return bare.rlike("[Cc]") | c.rlike(r"\[[0-9]*[Cc][^a-z]")


def is_free_ion(c: Column, symbols: Sequence[str] = BLOCKED_SYMBOLS) -> Column:
    """A single bracketed atom of the symbols with a charge."""
    return c.rlike(r"^\[[0-9]*(" + "|".join(symbols) + r")(\+|-)+[0-9]*\]$")


def lexically_valid(c: Column) -> Column:
    """Allowed tokens throughout, balanced parentheses, ring digits in pairs (C11). Weaker than a parser."""
    outside = F.regexp_replace(c, r"\[[^\]]*\]", "")
    pairs = F.lit(True)
    for digit in "0123456789":
        pairs = pairs & (F.regexp_count(outside, F.lit(digit)) % 2 == 0)
    tokens = c.rlike(r"^(Cl|Br|[BCNOPSFIbcnops]|\[[^\[\]]+\]|[-=#$:/\\.()%0-9~*@+])+$")
    return tokens & pairs & (F.regexp_count(c, F.lit(r"\(")) == F.regexp_count(c, F.lit(r"\)")))


def count_marks(c: Column, eligible: Column, pattern: str = r"\[[^\]]*@[^\]]*\]") -> Column:
    """Specified centres of an eligible value; null, not 0, for any other."""
    return F.when(eligible, F.regexp_count(c, F.lit(pattern)))


def dictionary(spark, protected: Sequence[str] = PROTECTED, removable: Sequence[str] = REMOVABLE, with_siblings: Sequence[str] = SOLVENTS) -> DataFrame:
    """The dictionary table ``component, kind`` from lists."""
    rows = [(c, k) for k, cs in (("protected", protected), ("removable", removable), ("sibling_removable", with_siblings)) for c in cs]
    return spark.createDataFrame(rows, "component string, kind string").dropDuplicates(["component"])


def build_removable(patterns: DataFrame, protected: DataFrame, blocked: Rule = is_blocked) -> DataFrame:
    """Patterns that are neither blocked nor protected."""
    return patterns.where(~blocked(F.col("component"))).join(protected.select("component"), "component", "left_anti").select("component").distinct()


def categorize(parts: DataFrame, words: DataFrame, blocked: Rule = is_blocked, parent: Rule = has_parent_token) -> DataFrame:
    """Adds ``category`` to components by ordered rules.

    Blocked; else a protected word is a parent; removable; removable beside others; what the parent
    rule accepts; ambiguous. A word matches a whole component only.
    """
    known = parts.join(words.select("component", "kind"), "component", "left")
    category = (
        F.when(blocked(F.col("component")), "metal")
        .when(F.col("kind") == "protected", "parent")
        .when(F.col("kind") == "removable", "removable")
        .when((F.col("kind") == "sibling_removable") & (F.col("n") > 1), "removable")
        .when(parent(F.col("component")), "parent")
        .otherwise("ambiguous")
    )
    return known.withColumn("category", category).drop("kind")


def _gathered() -> Column:
    """A record's components with their places and categories, in record order: its text is shuffled once, for all that is asked of it."""
    return F.array_sort(F.collect_list(F.struct("pos", "category", "component")))


def _of(kind: str) -> Column:
    """A record's components of a kind, in order, of what was gathered as ``list``."""
    return F.transform(F.filter("list", lambda x: x["category"] == kind), lambda x: x["component"])


def classify_records(
    df: DataFrame, row_id: str, value: str, words: DataFrame, blocked: Rule = is_blocked, parent: Rule = has_parent_token, valid: Rule | None = lexically_valid, delim: str = "."
) -> DataFrame:
    """A record's verdict (C7 to C9): ``row_id, value_clean, status, num_fragments, num_removed, removed,
    retained, key, reason, n_marks``.

    Missing, unreadable, blocked, ambiguous, without parent, one parent, several equal parents,
    mixture: the first that holds. Only the last but two have a clean value and key.
    """
    missing = is_missing(F.col(value))
    readable = ~missing & (valid(F.trim(value)) if valid else F.lit(True))
    flagged = df.select(row_id, F.col(value).alias("__value"), missing.alias("__missing"), F.coalesce(readable, F.lit(False)).alias("__readable"))
    parts = categorize(components(flagged.where("__readable"), row_id, "__value", delim), words, blocked, parent)
    of = lambda kind: F.size(_of(kind)).cast("long")
    grouped = parts.groupBy(row_id).agg(_gathered().alias("list")).select(
        row_id,
        F.size("list").alias("n"),
        of("metal").alias("metals"),
        of("ambiguous").alias("unclear"),
        of("parent").alias("parents"),
        F.size(_of("removable")).alias("gone"),
        F.size(F.array_distinct(_of("parent"))).alias("kinds"),
        F.get(_of("parent"), F.lit(0)).alias("first_parent"),
        F.array_join(_of("removable"), delim).alias("removed"),
        F.array_join(F.concat(_of("parent"), _of("ambiguous"), _of("metal")), delim).alias("kept"),
    )
    c = F.col
    status = (
        F.when(c("n").isNull(), "invalid_smiles")
        .when(c("metals") > 0, "metal_complex")
        .when(c("unclear") > 0, "ambiguous_fragment")
        .when(c("parents") == 0, "no_parent")
        .when((c("kinds") == 1) & (c("gone") == 0), "clean")
        .when(c("kinds") == 1, "salt_removed")
        .otherwise("mixture")
    )
    reason = (
        F.when(c("__missing"), "missing value")
        .when(~c("__readable"), "value could not be read")
        .when(c("status") == "metal_complex", "contains a blocked component; manual review")
        .when(c("status") == "ambiguous_fragment", "a component could not be classified with confidence")
        .when(c("status") == "no_parent", "no parent component remained")
        .when(c("status") == "mixture", "several distinct parent components remain")
        .otherwise("")
    )
    out = flagged.join(grouped, row_id, "left").withColumn("status", status)
    fine = c("status").isin(*ELIGIBLE)
    clean = F.when(fine, c("first_parent"))
    return out.select(
        row_id,
        clean.alias("value_clean"),
        "status",
        F.coalesce("n", F.lit(0)).alias("num_fragments"),
        F.coalesce("gone", F.lit(0)).alias("num_removed"),
        F.coalesce("removed", F.lit("")).alias("removed"),
        F.when(fine | (c("status") == "no_parent"), "").otherwise(F.coalesce("kept", F.lit(""))).alias("retained"),
        identity_key(clean).alias("key"),
        reason.alias("reason"),
        count_marks(clean, fine).cast("int").alias("n_marks"),
    )


def classify_blocked(df: DataFrame, row_id: str, value: str, words: DataFrame, blocked: Rule = is_blocked, parent: Rule = has_parent_token, free: Rule = is_free_ion, names: Rule = bracket_symbols, delim: str = ".") -> DataFrame:
    """Second pass over blocked records (C14): ``row_id, recommendation, recovered_value, reason``.

    Recoverable only with one distinct parent, nothing ambiguous and nothing blocked but free ions.
    """
    parts = categorize(components(df, row_id, value, delim), words, blocked, parent)
    metals = _of("metal")
    grouped = parts.groupBy(row_id).agg(_gathered().alias("list")).select(
        row_id,
        F.size(_of("ambiguous")).alias("unclear"),
        F.size(F.array_distinct(_of("parent"))).alias("kinds"),
        F.get(_of("parent"), F.lit(0)).alias("first_parent"),
        F.size(F.filter(metals, lambda x: ~free(x))).alias("bound"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(metals, names)))), ",").alias("symbols"),
    )
    auto = (F.col("unclear") == 0) & (F.col("kinds") == 1) & (F.col("bound") == 0)
    reason = (
        F.when(F.col("unclear") > 0, "also has an ambiguous component")
        .when(F.col("kinds") == 0, "no parent component remained")
        .when(F.col("kinds") > 1, F.concat(F.col("kinds").cast("string"), F.lit(" different parents")))
        .when(F.col("bound") > 0, "a blocked component is not a free ion")
        .otherwise(F.concat(F.lit("removed: "), "symbols"))
    )
    return grouped.select(row_id, F.when(auto, "auto_recoverable").otherwise("needs_manual_review").alias("recommendation"), F.when(auto, F.col("first_parent")).alias("recovered_value"), reason.alias("reason"))


def recovery_counts(classified: DataFrame) -> DataFrame:
    """Rows per recommendation."""
    return classified.groupBy("recommendation").agg(F.count("*").alias("n"))


def with_raw(df: DataFrame, value: str) -> DataFrame:
    """Keeps the value as it came beside the one to be overwritten."""
    return df.withColumn(f"{value}_raw", F.col(value))


def split_by(df: DataFrame, pred: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the predicate holds, and all others, those where it is null included."""
    holds = F.coalesce(pred, F.lit(False))
    return df.where(holds), df.where(~holds)


def bisected(fn: Callable[[list], list], values: list) -> tuple[list, list]:
    """``fn`` of all values, and the errors of those that it fails on: a list that fails is halved and tried again, so
    one bad value among n costs some 2 log n calls. As many results as values are asked for; fewer or more are a failure."""
    if not values:
        return [], []
    try:
        out = list(fn(values))
        if len(out) != len(values):
            raise ValueError(f"{len(out)} results for {len(values)} values")
        return out, [None] * len(values)
    except Exception as e:  # the value's own failure is its result
        if len(values) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = len(values) // 2
    left, right = bisected(fn, values[:half]), bisected(fn, values[half:])
    return left[0] + right[0], left[1] + right[1]


def hook(fn: Callable[[list], list], returns: str) -> Callable[[Column | str], Column]:
    """A user's function of many values as a column ``struct(value, error)`` (E1, C13): a key, a validity or any other
    rule, in Arrow batches. Null values aren't shown to it; they have no value and no error."""
    @F.pandas_udf(f"value {returns}, error string")
    def run(x: pd.Series) -> pd.DataFrame:
        known = x.notna().to_numpy()
        value, error = bisected(fn, x[known].tolist())
        out = pd.DataFrame({"value": pd.Series([None] * len(x), dtype=object), "error": pd.Series([None] * len(x), dtype=object)})
        out.loc[known, "value"], out.loc[known, "error"] = pd.Series(value, dtype=object).to_numpy(), pd.Series(error, dtype=object).to_numpy()
        return out

    return run


def guarded(batch_fn: Callable, schema: str) -> Callable:
    """Wrap a user's ``mapInPandas`` function (C13, E3, E4): a batch that fails is retried by halves, and
    a row that fails is marked ``ok = false`` with its error instead of stopping the job. ``schema`` is of
    the function's result; the wrapped one adds ``ok boolean, error string`` and keeps the row's ``row_id``.
    """
    columns = [c.split()[0] for c in schema.split(",")]

    def parts(batch):
        try:
            yield batch_fn(batch).assign(ok=True, error=None)
            return
        except Exception as e:
            if len(batch) < 2:  # the row's own failure is its result
                yield pd.DataFrame({c: batch[c].to_list() if c in batch else [None] * len(batch) for c in columns}).assign(ok=False, error=f"{type(e).__name__}: {e}")
                return
        yield from parts(batch.iloc[: len(batch) // 2])
        yield from parts(batch.iloc[len(batch) // 2 :])

    def run(batches):
        for batch in batches:
            yield from parts(batch)

    return run
