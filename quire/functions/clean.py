"""Scalar coercions of metadata fields, and whole-record helpers over a field table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ordered_distinct


def text(value: Column) -> Column:
    """Trimmed, control characters but tab and line ends dropped, empty is null."""
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    plain = trimmed(F.regexp_replace(trimmed(value.cast("string")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.nullif(plain, F.lit(""))


def text_sql(value: str) -> str:
    """text() of an SQL expression, as SQL."""
    trimmed = lambda e: rf"regexp_replace({e}, r'(?U)^\s+|\s+$', '')"
    bare = trimmed(f"cast({value} as string)")
    return "nullif(" + trimmed(rf"regexp_replace({bare}, r'[\x00-\x08\x0B\x0C\x0E-\x1F]', '')") + ", '')"


def integer(value: Column) -> Column:
    """An integer, else a number cut to one, else null."""
    plain = text(value)
    return F.coalesce(plain.try_cast("bigint"), plain.try_cast("double").try_cast("bigint"))


def boolean(value: Column) -> Column:
    word = F.lower(text(value))
    return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)


def rating(value: Column) -> Column:
    """One decimal, half up; null outside 0..5."""
    number = F.round(value.cast("string").try_cast("decimal(20,6)"), 1).cast("decimal(20,1)")
    return F.when(number.between(0, 5), number.cast("decimal(2,1)"))


def one_of(value: Column, allowed: tuple[str, ...], default: str | None) -> Column:
    """The allowed value, exactly or but for case, else the default."""
    names = F.array(*[F.lit(a) for a in allowed])
    return F.coalesce(F.get(F.filter(names, lambda a: F.lower(a) == F.lower(F.trim(value))), F.lit(0)), F.lit(default))


def value_list(value: Column) -> Column:
    """Split on commas, cleaned, no empties, first of equals but for case."""
    return ordered_distinct(F.filter(F.transform(F.split(value, ","), text), lambda v: v.isNotNull()))


def fill_missing(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Fill empty fields from another column: pairs of (field, source); what is there wins (SR7)."""
    kinds = dict(df.dtypes)

    def filled(name: str, source: str) -> Column:
        if kinds[name].startswith("array"):
            return F.when(F.size(name) > 0, F.col(name)).otherwise(F.col(source))
        return F.coalesce(F.nullif(F.col(name), F.lit("")) if kinds[name] == "string" else F.col(name), F.col(source))

    return df.withColumns({a: filled(a, b) for a, b in pairs.items()})
