"""Keyed lookups and ranked choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import letters_key
from quire.operators.dedupe import first_wins
from quire.operators.pages import query_tokens

# Words for side stories, and hints for those of one series.
SIDE_STORIES = ("外傳", "番外")
HINT_NAME, HINT_LETTERS, HINT = "讓葉", "lc", 4


def ordered_inner(spine: DataFrame, manifest: DataFrame, key: str, manifest_order: str) -> DataFrame:
    """Spine rows with their manifest row, of which the last of an id counts; unmatched rows go, repeats stay (JN1)."""
    return spine.join(first_wins(manifest, key, [manifest_order], last=True).drop(manifest_order), key)


def left_last_wins(rows: DataFrame, tags: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the last tag of their key, or nulls (JN3, JN4)."""
    return rows.join(first_wins(tags, key, [order], last=True), key, "left")


def unseen(candidates: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Candidates whose key hasn't been seen (JN6)."""
    return candidates.join(seen.select(key).distinct(), key, "left_anti")


def with_fallbacks(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join whose fields come from the left where they are there (JN9, SC24)."""
    other = right.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return left.join(other, key, "left").withColumns({f: F.coalesce(f, f"__{f}") for f in fields}).drop(*[f"__{f}" for f in fields])


def best_scored(rows: DataFrame, group: str, score: Column, order: str) -> DataFrame:
    """The row of highest score in each group, the first by order on ties (SO5, SO6); tasks keep one row of a group before the shuffle."""
    scored = rows.withColumn("score", score)
    row = F.struct(*[F.col(f"`{c}`") for c in scored.columns])
    return scored.groupBy(group).agg(F.min_by(row, F.struct(-F.col("score"), F.col(order))).alias("__row")).select("__row.*")


def title_score(title: Column, query: Column, count: Column) -> Column:
    """10 for an equal title, else 5 for one contained in the other, 1 for a known count, 3 for each side story that both name
    and for each of the query's words in the title; titles compare by their letters (ST34)."""
    t, q = letters_key(title), letters_key(query)
    words = F.filter(query_tokens(query), lambda w: F.contains(t, letters_key(w)))
    whole = F.when((t != "") & (t == q), 10).when((t != "") & (F.contains(t, q) | F.contains(q, t)), 5).otherwise(0)
    sides = sum((F.when(F.contains(query, F.lit(w)) & F.contains(title, F.lit(w)), 3).otherwise(0) for w in SIDE_STORIES), F.lit(0))
    holds = lambda c, w: F.contains(c, F.lit(w))
    named = F.when(holds(query, HINT_NAME) & holds(title, HINT_NAME), HINT).otherwise(0)
    other = F.when(holds(q, HINT_LETTERS) & holds(query, SIDE_STORIES[0]) & holds(title, SIDE_STORIES[0]) & ~holds(title, HINT_NAME), HINT).otherwise(0)
    return whole + sides + F.when(count.isNotNull(), 1).otherwise(0) + 3 * F.size(words) + named + other


def titles_related(query: Column, title: Column) -> Column:
    """Equal by their letters, or a title of four letters or more, "the" aside, inside the query (ST36)."""
    q, t = letters_key(query), letters_key(title)
    bare = F.regexp_replace(t, "^the", "")
    return F.coalesce((title != "") & ((q == t) | ((F.length(bare) >= 4) & F.contains(q, bare))), F.lit(False))


def match_strength(query: Column, work_title: Column, works: Column, page_title: Column) -> Column:
    """3 for a page with the very work, 2 if its only work is related, 1 if it has none but a related title, else 0 (ST35)."""
    very = F.coalesce((work_title != "") & (letters_key(work_title) == letters_key(query)), F.lit(False))
    with_work = F.when(very, 3).when((works == 1) & titles_related(query, work_title), 2).otherwise(0)
    return F.when(works > 0, with_work).otherwise(titles_related(query, page_title).cast("int"))
