"""Disclaimers among a book's first pages: from lines that text recognition read, to decisions, to the pages that go.

`lines` has, for each line of a page: collection, book, page (from 0), line (its place), text, confidence and ys, the heights
of its box's corners.  Lines are gathered by page, which is as large as a page; nothing larger meets in a task.
The memory of known pages is a fold over the books of a collection in their order.  Its state is bounded, and so is what it
takes of a book: a few pages' fingerprints.  As each step needs the one before, a collection is one task's fold; collections
run side by side, and books stream through it.

Defined cases: a page without lines, or of a book that isn't recognised at all, isn't confirmed and stays, and so do the pages
after it; a page without a fingerprint is never known and isn't remembered; books of one number are taken by their rows' order of
pages; null texts are empty; a page whose lines lack a confidence keeps all of them, one that lacks a box has no title in its upper part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions.text import letters_key
from quire.operators.filters import category_hits, title_high
from quire.streaming import known_pages

PAGE = ["collection", "book", "page"]


@dataclass(frozen=True)
class Rules:
    """Words that make a page a disclaimer or an age warning; titles and phrases in order of precedence."""

    titles: tuple[str, ...] = K.DISCLAIMER_TITLES
    categories: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(K.DISCLAIMER_CATEGORIES))
    warnings: tuple[str, ...] = K.WARNING_TITLES
    restrictions: tuple[str, ...] = K.RESTRICTIONS
    least_confidence: float = K.LEAST_CONFIDENCE


def _first_in(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words that the text holds, both by their letters."""
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, letters_key(w)))
    return F.get(found, F.lit(0))


def page_decisions(lines: DataFrame, heights: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(collection, book, page, confirmed, score, hits) of each page that has lines (FI16, FI17, AG10, HP38).

    heights: (collection, book, page, height).  A page is confirmed by a title in its upper part with a category, by four
    categories, or by a warning in its upper part with a restriction.  A title counts 4, a warning 6, a category 1.
    """
    rules = rules or Rules()
    line = F.struct("line", F.coalesce("text", F.lit("")).alias("text"), "confidence", "ys")
    pages = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("all")).join(heights.select(*PAGE, "height"), PAGE, "left")
    rated = F.forall("all", lambda x: x["confidence"].isNotNull())
    kept = F.filter("all", lambda x: ~rated | (x["confidence"] >= rules.least_confidence))
    boxed = F.forall("all", lambda x: x["ys"].isNotNull() & (F.size(x["ys"]) > 0))
    centre = lambda x: F.aggregate(x["ys"], F.lit(0.0), lambda a, y: a + y) / F.size(x["ys"])
    rows = pages.withColumns({"kept": kept, "boxed": boxed})
    rows = rows.withColumns({"whole": letters_key(F.array_join(F.transform("kept", lambda x: x["text"]), "")), "placed": F.when(F.col("boxed"), F.transform("kept", lambda x: F.struct(x["text"].alias("text"), centre(x).alias("y"))))})
    whole = F.col("whole")
    rows = rows.withColumns({"title": _first_in(whole, rules.titles), "warning": _first_in(whole, rules.warnings), "restriction": _first_in(whole, rules.restrictions), "categories": category_hits(whole, rules.categories)})
    upper = lambda c: F.coalesce(F.col(c).isNotNull() & F.col("boxed") & title_high(F.col(c), F.col("placed"), F.col("height")), F.lit(False))
    rows = rows.withColumns({"title_up": upper("title"), "warning_up": upper("warning")})
    warned = F.col("warning_up") & F.col("restriction").isNotNull()
    n = F.size("categories")
    confirmed = warned | (F.col("title_up") & (n >= 1)) | (n >= 4)
    score = F.when(F.col("title").isNotNull(), 4).otherwise(0) + n + F.when(warned, 6).otherwise(0)
    where = lambda c, up, kind: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{kind}:"), c, F.lit("@"), F.when(F.col(up), "upper").otherwise("footer")))
    named = F.array_compact(F.array(where("title", "title_up", "title"), where("warning", "warning_up", "adult-warning"), F.concat(F.lit("adult-restriction:"), "restriction")))
    return rows.select(*PAGE, confirmed.alias("confirmed"), score.cast("int").alias("score"), F.concat(named, "categories").alias("hits"))


def _bits(words: Column) -> Column:
    """Four longs as the 32 bytes of a fingerprint."""
    return F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def first_pages(fingerprints: DataFrame, decisions: DataFrame, most: int = known_pages.MOST_PAGES) -> DataFrame:
    """Books as the fold takes them: (collection, book, pages), with the first pages' fingerprints and decisions.

    fingerprints: collection, book, page, aspect, difference and average (four longs each, or null).
    """
    rows = fingerprints.where(F.col("page") < most).join(decisions.select(*PAGE, "confirmed"), PAGE, "left")
    page = F.struct("page", F.struct("aspect", _bits(F.col("difference")).alias("dhash"), _bits(F.col("average")).alias("ahash"), F.coalesce("confirmed", F.lit(False)).alias("confirmed")).alias("p"))
    gathered = rows.groupBy("collection", "book").agg(F.array_sort(F.collect_list(page), lambda a, b: a["page"].cast("int") - b["page"].cast("int")).alias("pages"))
    return gathered.select(F.col("collection").cast("string").alias("collection"), F.col("book").cast("long").alias("book"), F.transform("pages", lambda x: x["p"]).alias("pages"))


def without_known_pages(books: DataFrame) -> DataFrame:
    """(collection, book, removed, remembered): the fold of known_pages over a table of books, in order of their numbers (ST-1, ST-2, HP37)."""
    return known_pages.Fold(books.asTable().partitionBy("collection").orderBy("book"))


def kept_pages(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """Pages without the leading ones that go (FI18)."""
    return pages.join(removed.select("collection", "book", "removed"), ["collection", "book"], "left").where(F.col("page") >= F.coalesce("removed", F.lit(0))).drop("removed")
