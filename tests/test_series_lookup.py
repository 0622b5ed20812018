"""Titles over redirects, candidates, choices and fallbacks, and cached records."""

import json

from pyspark.sql import functions as F

from quire.operators import series_lookup as S
from quire.sources import wiki

FOUND = "title string, pageid long, page_url string, wikibase_item string, extract string, description string, defaultsort string, categories array<string>, converted_title string, works int, work struct<title: string>"


def page(title, pageid, works=0, work=None, extract=None, description=None, converted=None):
    return (title, pageid, f"u/{pageid}", None, extract, description, "sort", ["c"], converted, works, (work,))


def world(spark):
    pages = [page("Star Saga", 1, 1, "Star Saga", "about"), page("Moon", 2, 0, None, None, "only described"), page("star saga", 9, 2, "x"), page("Sun Tale", 3, 2, "Sun Tale Zero"), page("Sun", 4, 1, "Sun Tale Zero"), page("Long End", 5, 1, None)]
    hops = [(f"h{k}", f"h{k + 1}") for k in range(9)] + [("h9", "Long End"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("in", "r1"), ("gone", "nowhere"), ("two", "z"), ("two", "Moon"), (None, "x"), ("y", None)]
    hits = [("moon q", 1, "nothing"), ("moon q", 2, "Moon"), ("Sun Tale Zero", 1, "Sun Tale"), ("Sun Tale Zero", 2, "Sun"), ("pick", 1, "Moon"), ("pick", 2, "Star Saga"), ("lone", 1, "Star Saga")]
    return spark.createDataFrame(hits, "query string, rank int, title string"), spark.createDataFrame(pages, FOUND), S.resolved(spark.createDataFrame(hops, "title string, to string"))


def test_chains_circles_and_dangling_ends(spark):
    _, _, ends = world(spark)
    found = {r.title: r.to for r in ends.collect()}
    assert all(found[f"h{k}"] == "Long End" for k in range(10)) and found["gone"] == "nowhere" and found["two"] == "Moon"
    assert [found[k] for k in ("r1", "r2", "r3", "in")] == [None] * 4 and set(found) == {*(f"h{k}" for k in range(10)), "gone", "two", "r1", "r2", "r3", "in"}
    assert S.resolved(spark.createDataFrame([], "title string, to string")).count() == 0
    assert S.resolved(spark.createDataFrame([("a", "a")], "title string, to string")).first().to is None


def test_series_of_a_query(spark):
    hits, found, ends = world(spark)
    queries = spark.createDataFrame([(q,) for q in ("Star Saga", "STAR SAGA", "h0", "moon q", "Sun Tale Zero", "r1", "gone", "unknown")], "query string")
    rows = {r.query: r for r in S.by_choice(queries, hits, found, ends).collect()}
    assert set(rows) == {"Star Saga", "STAR SAGA", "Sun Tale Zero", "moon q"}  # a page that only redirects lead to must fit, too
    assert (rows["Star Saga"].pageid, rows["Star Saga"].partial, rows["Star Saga"].exact, rows["Star Saga"].summary) == (1, False, True, "about")
    assert (rows["moon q"].title, rows["moon q"].partial, rows["moon q"].summary, rows["moon q"].exact) == ("Moon", True, "only described", False)
    assert rows["Sun Tale Zero"].page_title == "Sun Tale"  # the first of strength 3


def test_titles_addresses_and_first_hits(spark):
    hits, found, ends = world(spark)
    titles = spark.createDataFrame([("a", "h3"), ("b", "Moon"), ("c", "r2"), ("d", None)], "query string, title string")
    assert [(r.query, r.page_title) for r in S.by_title(titles, found, ends).collect()] == [("a", "Long End")]
    urls = spark.createDataFrame([("a", "https://zh.wikipedia.org/wiki/Star_Saga?x=1#y"), ("b", "https://zh.wikipedia.org/w/index.php?title=h0"), ("c", "no address"), ("d", None)], "query string, url string")
    assert {(r.query, r.pageid) for r in S.by_url(urls, found, ends).collect()} == {("a", 1), ("b", 5)}
    assert {(r.query, r.pageid) for r in S.by_first_hit(hits, found, ends).collect()} == {("Sun Tale Zero", 3), ("lone", 1)}


def test_choices(spark):
    hits, found, ends = world(spark)
    queries = spark.createDataFrame([("pick",), ("lone",), ("Star Saga",), ("moon q",)], "query string")
    choose = lambda *rows: {r.query: r.pageid for r in S.by_number(queries, hits, found, ends, spark.createDataFrame(rows, "query string, number int")).collect()}
    assert choose(("pick", 2), ("moon q", 0)) == {"pick": 1, "Star Saga": 1}
    assert choose(("pick", 3), ("Star Saga", 2)) == {"Star Saga": 1}


def test_sources_in_order(spark):
    row = lambda *x: spark.createDataFrame(list(x), "query string, pageid long")
    found = S.first_source({"lookup": row(("a", 1), ("b", 2), ("c", 3)), "cache": row(("a", 4), ("b", 5)), "url": row(("a", 6))})
    assert {(r.query, r.pageid, r.source) for r in found.collect()} == {("a", 6, "url"), ("b", 5, "cache"), ("c", 3, "lookup")}


def test_cached_records_come_back_with_defaults(spark):
    good = {"schema_version": 7, "series_name": "a", "metadata": {"page_title": "P", "pageid": 3, "main_manga": {"title": "W", "author": ["x"], "volume_count": 9, "raw_fields": {"k": "v"}}}}
    bare = {"schema_version": 7, "series_name": "b", "metadata": {"main_manga": {}}}
    others = [dict(good, schema_version=6), dict(good, series_name="z"), {"schema_version": 7, "series_name": "a", "metadata": {"main_manga": None}}]
    rows = [("a", json.dumps(good)), ("b", json.dumps(bare)), *[("a", json.dumps(x)) for x in others], ("a", "no json"), ("a", None)]
    found = {r.name: r.metadata for r in wiki.cached_series(spark.createDataFrame(rows, "name string, value string"), "name", 7).collect()}
    assert found["a"].main_manga.author == ["x"] and found["a"].main_manga.raw_fields == {"k": "v"} and found["a"].main_manga.genre == [] and found["a"].pageid == 3
    assert (found["b"].page_title, found["b"].pageid, found["b"].categories, found["b"].main_manga.raw_fields, found["b"].page_url) == ("", 0, [], {}, None) and len(found) == 2
    again = wiki.cache_records(spark.createDataFrame([("a", 1)], "name string, x int"), "name", 7).select(F.get_json_object("value", "$.schema_version").alias("v")).first()
    assert again.v == "7"
