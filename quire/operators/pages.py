"""Choice of a wiki page for a book series: candidates in phases, graded, the first of the best (SO6, SO9, ST33, ST37, ST38)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ordered_distinct, title_key

# Words that name no work, title overrides by key, phases of the choice.
STOP_WORDS = ("漫畫", "漫画", "外傳", "外传", "番外", "篇", "卷", "冊", "册")
TITLE_OVERRIDES = {"死神": "BLEACH"}
DIRECT, SEARCHED, PARENT = 0, 1, 2
MOST_PARENTS = 4


def lookup_title(series: Column) -> Column:
    """The title that is looked up for a series (JN10)."""
    out = series
    for a, b in TITLE_OVERRIDES.items():
        out = F.when(title_key(series) == a, b).otherwise(out)
    return out


def query_tokens(query: Column) -> Column:
    """The words of a query, two characters at least, without stop words, each once (ST33)."""
    words = F.split(query, r"(?U)[\s_\-:：・,，。·《》「」『』【】\[\]()（）]+")
    return ordered_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def parent_titles(query: Column) -> Column:
    """Likely article roots of sequels and side stories, four at most (ST37, SO9)."""
    first = F.trim(F.get(F.split(query, r"(?U)[\s:：~～\-]+", 2), F.lit(0)))
    bare = F.trim(F.regexp_replace(first, r"(?iU)(?:[IVX]+|\d+)$", ""))
    lead, tail = F.regexp_extract(bare, r"^[一-鿿]+", 0), F.regexp_extract(bare, r"[一-鿿]{2}$", 0)
    found = F.array(first, bare, F.when(F.length(lead) > 2, F.left(lead, F.lit(2))), F.when(F.length(bare) > 2, tail))
    usable = F.filter(found, lambda t: t.isNotNull() & (t != "") & (title_key(t) != title_key(query)))
    return F.slice(F.array_distinct(usable), 1, MOST_PARENTS)


def same_title(requested: Column, title: Column, converted: Column) -> Column:
    """Whether a page is the one asked for, by its own title or by the script it was converted to (ST38)."""
    return (title_key(requested) == title_key(title)) | F.coalesce(title_key(converted) == title_key(title), F.lit(False))


def choose(candidates: DataFrame, query: str = "query", phase: str = "phase", rank: str = "rank", strength: str = "strength") -> DataFrame:
    """One candidate for each query: the first of strength 3 by phase and rank; else the strongest, the first of equals (SO6).

    Parent pages count with strength 3 only, and pages of strength 0 never.  Candidates are the pages of a query that were
    looked at, each once.
    """
    usable = candidates.where((F.col(strength) > 0) & ((F.col(phase) < PARENT) | (F.col(strength) == 3)))
    order = F.struct(-F.col(strength), F.col(phase), F.col(rank))
    row = F.struct(*[F.col(f"`{c}`") for c in candidates.columns])
    return usable.groupBy(query).agg(F.min_by(row, order).alias("__row")).select("__row.*")
