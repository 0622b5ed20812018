"""From a book series to its wiki page and its metadata: titles resolved over redirects, candidates in phases, choice, fallbacks.

Tables: `queries` (query), `hits` (query, rank, title), `hops` (title, to: redirects, normalised and converted titles in one table) and
`found` (pages as sources.wiki.page_data gives them, with `works`, the number of work boxes, and `work`, a struct of the one
for the page, whose field `title` may be null).  Pages are found by title_key, so small and capital letters don't matter.

Defined cases: of several hops of one title the least target counts; a chain into a circle, or to a title without a page, has no
page; null titles are none; of several pages with one title the least pageid counts; a query that finds nothing has no row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import title_key, wiki_title
from quire.operators.dedupe import first_wins
from quire.operators.lookup import match_strength
from quire.operators.pages import DIRECT, PARENT, SEARCHED, choose, lookup_title, parent_titles, same_title
from quire.session import checkpoint

# Fixed value: where metadata come from, the first source that has any counts.
SOURCES = ("url", "probe", "cache", "lookup")


def resolved(hops: DataFrame) -> DataFrame:
    """(title, to) with each title's end of chain; null where the chain runs in a circle (SC17).

    Pointer jumping: a round replaces each target by the target's own, which doubles the length of what is resolved, so a
    chain of n hops takes log2(n) rounds.  A title on a chain that is still under way when no chain can be that long is on a circle,
    or leads to one.  Each round is one keyed join, cut off by a checkpoint.
    """
    links = hops.where(F.col("title").isNotNull() & F.col("to").isNotNull()).groupBy("title").agg(F.min("to").alias("to"))
    links = checkpoint(links.select("title", "to", F.lit(False).alias("ended")))
    n = links.count()
    for _ in range(math.ceil(math.log2(n)) + 1 if n else 0):
        ahead = links.select(F.col("title").alias("to"), F.col("to").alias("__to"), F.col("ended").alias("__ended"))
        # a target that is no title of a hop is an end
        links = links.join(ahead, "to", "left").select("title", F.coalesce("__to", "to").alias("to"), (F.col("__to").isNull() | F.col("__ended")).alias("ended"))
        links = checkpoint(links)
        if links.where(~F.col("ended")).isEmpty():
            break
    return links.select("title", F.when(F.col("ended"), F.col("to")).alias("to"))


def pages_of(titles: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """titles (with a column `title`) with the page of each, as the struct `page`, by way of resolved() hops; titles without a page go."""
    by_key = first_wins(found.withColumn("__key", title_key("title")).where(F.col("__key").isNotNull()), "__key", ["pageid", "title"])
    pages = by_key.select("__key", F.struct(*[F.col(f"`{c}`") for c in found.columns]).alias("page"))
    routes = ends.select(F.col("title"), F.col("to"), F.lit(True).alias("__hop"))
    there = titles.join(routes, "title", "left").withColumn("__key", title_key(F.when(F.col("__hop"), F.col("to")).otherwise(F.col("title"))))
    return there.join(pages, "__key").drop("__key", "__hop", "to")


def candidates(queries: DataFrame, hits: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """Pages to look at for each query, each once, with phase, rank and strength: the title itself, search hits, parent titles (ST33-ST37, SO6)."""
    asked = queries.select("query", lookup_title(F.col("query")).alias("__asked")).distinct()
    direct = asked.select("query", "__asked", F.col("__asked").alias("title"), F.lit(DIRECT).alias("phase"), F.lit(0).alias("rank"))
    searched = hits.join(asked, "query").select("query", "__asked", "title", F.lit(SEARCHED).alias("phase"), F.col("rank").cast("int").alias("rank"))
    parents = asked.select("query", "__asked", F.posexplode(parent_titles(F.col("__asked"))).alias("rank", "title")).select("query", "__asked", "title", F.lit(PARENT).alias("phase"), "rank")
    rows = pages_of(direct.unionByName(searched).unionByName(parents), found, ends)
    once = first_wins(rows.withColumn("__seen", F.struct("query", title_key("page.title"))), "__seen", ["phase", "rank"]).drop("__seen")
    strength = match_strength(F.col("__asked"), F.col("page.work.title"), F.col("page.works"), F.col("page.title"))
    return once.withColumn("strength", strength).drop("__asked")


def _series(rows: DataFrame, key: str) -> DataFrame:
    """(key, page_title, pageid, page_url, wikibase_item, summary, series_sort, categories, title, partial, exact) of pages."""
    p = F.col("page")
    own = p["works"] > 0
    return rows.select(
        key, p["title"].alias("page_title"), p["pageid"].alias("pageid"), p["page_url"].alias("page_url"), p["wikibase_item"].alias("wikibase_item"),
        F.coalesce(p["extract"], F.when(~own, p["description"])).alias("summary"), p["defaultsort"].alias("series_sort"), p["categories"].alias("categories"),
        F.when(own, p["work"]["title"]).otherwise(p["title"]).alias("title"), (~own).alias("partial"), same_title(F.col(key), p["title"], p["converted_title"]).alias("exact"),
    )


def by_choice(queries: DataFrame, hits: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """Metadata of the page that fits a series best; where it has no work box, what the page itself says (SO6, SR18)."""
    return _series(choose(candidates(queries, hits, found, ends)), "query")


def by_number(queries: DataFrame, hits: DataFrame, found: DataFrame, ends: DataFrame, choices: DataFrame) -> DataFrame:
    """As by_choice, but where more than one hit is there the hit that `choices` (query, number from 1) names; no number, or another, is none (HP8).

    A title of strength 3 needs no choice.
    """
    order = Window.partitionBy("query").orderBy("rank")
    numbered = hits.withColumn("number", F.row_number().over(order)).withColumn("__n", F.count("*").over(Window.partitionBy("query")))
    several = numbered.where("__n > 1")
    sure = candidates(queries, hits.limit(0), found, ends).where((F.col("phase") == DIRECT) & (F.col("strength") == 3))
    open_ = queries.join(sure.select("query"), "query", "left_anti")
    chosen = several.join(open_, "query", "left_semi").join(choices.select("query", "number"), ["query", "number"]).select("query", "title")
    few = open_.join(several.select("query").distinct(), "query", "left_anti")
    rest = choose(candidates(few, hits, found, ends)).select("query", "page")
    return _series(sure.select("query", "page").unionByName(pages_of(chosen, found, ends).select("query", "page")).unionByName(rest), "query")


def by_title(titles: DataFrame, found: DataFrame, ends: DataFrame, key: str = "query") -> DataFrame:
    """Metadata of the pages with these titles (key, title); pages without a work box give none (HP25-HP27)."""
    return _series(pages_of(titles, found, ends), key).where(~F.col("partial"))


def by_url(addresses: DataFrame, found: DataFrame, ends: DataFrame, key: str = "query") -> DataFrame:
    """Metadata of the pages at these addresses (key, url); what fails has no row (SC19, HP22)."""
    return by_title(addresses.select(key, wiki_title(F.col("url")).alias("title")), found, ends, key)


def by_first_hit(hits: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """Metadata of the first hit's page of each query (SC18, HP28)."""
    return by_title(first_wins(hits.select("query", "rank", "title"), "query", ["rank"]).drop("rank"), found, ends)


def first_source(series: dict[str, DataFrame], key: str = "query", order: tuple[str, ...] = SOURCES) -> DataFrame:
    """One row for each key, of the first source that has it, with `source` (HP7, HP13)."""
    parts = [df.withColumns({"source": F.lit(name), "__order": F.lit(order.index(name))}) for name, df in series.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return first_wins(whole, key, ["__order"]).drop("__order")


