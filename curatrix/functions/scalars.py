"""Column functions shared by the operators. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``: else a lambda that uses it evaluates it again for each element."""
    return F.transform(F.array(value), body)[0]


def is_missing(c: Column) -> Column:
    """Null, or nothing but spaces (P10)."""
    return c.isNull() | (F.trim(c) == "")


def label_ok(c: Column, allowed: Sequence[int] | None = (0, 1)) -> Column:
    """Not null and, unless ``allowed`` is None, one of it; never null itself."""
    good = c.isNotNull()
    return good if allowed is None else good & F.coalesce(c.isin(*allowed), F.lit(False))


def contains_ci(c: Column, part: str) -> Column:
    """Case-insensitive substring test; null is false."""
    return F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))


def ellipsize(c: Column, most: int = 70) -> Column:
    """Longer values become their first ``most - 3`` characters and three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def coerce_label(c: Column) -> Column:
    """struct(label, ok): booleans and integral numbers as long; null stays null and is ok; others not ok."""
    text = F.lower(F.trim(c.cast("string")))
    number = text.try_cast("double")
    label = F.when(text == "true", F.lit(1)).when(text == "false", F.lit(0)).when(number == F.floor(number), F.floor(number)).cast("long")
    return F.struct(label.alias("label"), (c.isNull() | label.isNotNull()).alias("ok"))


def identity_key(c: Column, fold_case: bool = False) -> Column:
    """Hash of the trimmed value; case counts unless ``fold_case`` (C10). Null stays null."""
    text = F.trim(c)
    return F.sha2(F.lower(text) if fold_case else text, 256)


def hash_prefix(c: Column, digits: int) -> Column:
    """The first hex digits of a content hash."""
    return F.substring(F.sha2(c, 256), 1, digits)


def iso_utc(ts: Column) -> Column:
    """A timestamp as ISO 8601, for a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def valid_vector(c: Column, dim: int) -> Column:
    """Of the expected size, not empty, all finite."""
    return F.coalesce((F.size(c) == dim) & (F.size(c) > 0) & F.forall(c, lambda x: finite(x.cast("double"))), F.lit(False))


def norm(c: Column) -> Column:
    """Euclidean norm of an array."""
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return norm(gaps)


def bit_mask(bit: Column) -> Column:
    """The mask of a bit in its byte, most significant first."""
    return F.pow(F.lit(2), 7 - bit % 8).cast("int")


def round_half_even(c: Column, digits: int) -> Column:
    """Rounding as numpy and Python do it."""
    return F.bround(c, digits)
