"""Wiki pages from answers of its interface that were saved as JSON, and folders of saved answers. Nothing is fetched.

`answers` tables have one JSON text a row; fields are read from it by path, so no schema is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.dedupe import first_wins

# File names of a probe folder.
SUMMARY_FILE, PAGE_FILE, TEXT_FILE = "02_summary.json", "03_page_full.json", "05_wikitext.txt"

_SEARCH = "struct<query:struct<search:array<struct<title:string,pageid:bigint,snippet:string,size:bigint,wordcount:bigint>>>>"
_SUMMARY = "struct<title:string,extract:string,description:string,wikibase_item:string,content_urls:struct<desktop:struct<page:string>>,thumbnail:struct<source:string>>"
_PAGE = "pageid:bigint,title:string,fullurl:string,extract:string,missing:string,pageprops:struct<wikibase_item:string,defaultsort:string>,categories:array<struct<title:string>>"
_REVISIONS = "revisions:array<struct<`*`:string,slots:struct<main:struct<`*`:string,content:string>>>>"
_ANSWER = f"struct<query:struct<pages:map<string,struct<{_PAGE},{_REVISIONS}>>,converted:array<struct<`from`:string,`to`:string>>>>"


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(folder, value): the whole text of each file of this name below a folder (SC22, SC25)."""
    files = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return files.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"), "value")


def search_hits(answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """(key, rank, title, pageid, snippet, size, wordcount): hits with a title and a page, ranks from 1 (SC15)."""
    hits = F.from_json(answer, _SEARCH)["query"]["search"]
    usable = F.filter(hits, lambda h: (F.coalesce(h["title"], F.lit("")) != "") & (F.coalesce(h["pageid"], F.lit(0)) != 0))
    return answers.select(key, F.posexplode(usable).alias("rank", "hit")).select(key, (F.col("rank") + 1).alias("rank"), "hit.*")


def first_hits(hits: DataFrame, key: str) -> DataFrame:
    """The first hit of each query (SC18)."""
    return first_wins(hits, key, ["rank"])


def summaries(answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """(key, title, extract, description, page_url, thumbnail_url, wikibase_item) of page summaries (SC16, HP24)."""
    s = F.from_json(answer, _SUMMARY)
    return answers.select(key, s["title"].alias("title"), s["extract"].alias("extract"), s["description"].alias("description"), s["content_urls"]["desktop"]["page"].alias("page_url"), s["thumbnail"]["source"].alias("thumbnail_url"), s["wikibase_item"].alias("wikibase_item"))


def _text_or_null(value: Column) -> Column:
    return F.when(value != "", value)


def pages(answers: DataFrame, requested: str, answer: str = "answer") -> DataFrame:
    """The page of each answer that has one, with its text in either shape of revisions, and the title it was converted to (SR13, SR14).

    Columns: requested, title, pageid, page_url, extract, wikibase_item, defaultsort, categories, converted_title, wikitext.
    """
    query = F.from_json(answer, _ANSWER)["query"]
    page = F.get(F.filter(F.map_values(query["pages"]), lambda p: p["missing"].isNull()), F.lit(0))
    rows = answers.select(requested, page.alias("p"), query["converted"].alias("c")).where(F.col("p").isNotNull())
    revision = F.get(F.col("p.revisions"), F.lit(0))
    main = revision["slots"]["main"]
    wikitext = F.when(main.isNotNull(), F.coalesce(_text_or_null(main["*"]), main["content"])).otherwise(revision["*"])
    converted = F.get(F.filter("c", lambda x: (x["from"] == F.col(requested)) & (x["to"] != "")), F.lit(0))["to"]
    names = F.transform(F.filter(F.coalesce("p.categories", F.array().cast("array<struct<title:string>>")), lambda x: x["title"] != ""), lambda x: F.regexp_replace(x["title"], "^(.*?)Category:", "$1"))
    title = F.coalesce(_text_or_null(F.col("p.title")), F.col(requested))
    return rows.select(
        requested, title.alias("title"), F.coalesce("p.pageid", F.lit(0)).alias("pageid"), F.col("p.fullurl").alias("page_url"), F.col("p.extract").alias("extract"), F.col("p.pageprops.wikibase_item").alias("wikibase_item"),
        F.col("p.pageprops.defaultsort").alias("defaultsort"), names.alias("categories"), converted.alias("converted_title"), wikitext.alias("wikitext"),
    )


def page_data(found: DataFrame, summary: DataFrame, requested: str) -> DataFrame:
    """Pages with a text, with what their summaries add: the summary's extract and the page's address and item go first (SC17)."""
    s = summary.select("title", F.col("extract").alias("__extract"), "description", F.col("page_url").alias("__url"), "thumbnail_url", F.col("wikibase_item").alias("__item"))
    rows = found.where(_text_or_null(F.col("wikitext")).isNotNull()).join(first_wins(s, "title", ["__url"]), "title", "left")
    filled = {"extract": ("__extract", "extract"), "page_url": ("page_url", "__url"), "wikibase_item": ("wikibase_item", "__item")}
    return rows.withColumns({k: F.coalesce(_text_or_null(F.col(a)), F.col(b)) for k, (a, b) in filled.items()}).drop("__extract", "__url", "__item")


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each probe folder with a wikitext file: its text, and page_title, pageid, page_url, wikibase_item and summary
    from the page where it has them, else from the summary (SC23, SC24, HP17)."""
    wikitext = texts(spark, folder, TEXT_FILE).withColumnRenamed("value", "wikitext")
    summary = summaries(texts(spark, folder, SUMMARY_FILE), "folder", "value").select("folder", F.struct("title", "extract", "page_url", "wikibase_item").alias("s"))
    page = pages(texts(spark, folder, PAGE_FILE), "folder", "value").select("folder", F.struct(F.when(F.col("title") != F.col("folder"), F.col("title")).alias("title"), "pageid", "page_url", "extract", "wikibase_item").alias("p"))
    rows = wikitext.join(summary, "folder", "left").join(page, "folder", "left")
    first = lambda p, s: F.coalesce(_text_or_null(F.col(f"p.{p}")), F.col(f"s.{s}"))
    return rows.select("folder", "wikitext", first("title", "title").alias("page_title"), F.when(F.col("p.pageid") != 0, F.col("p.pageid")).alias("pageid"), first("page_url", "page_url").alias("page_url"), first("wikibase_item", "wikibase_item").alias("wikibase_item"), first("extract", "extract").alias("summary"))


def first_probe(found: DataFrame) -> DataFrame:
    """The probe of least folder, which is taken where none is named (HP16)."""
    row = F.struct(*[F.col(f"`{c}`") for c in found.columns])
    return found.agg(F.min_by(row, "folder").alias("r")).where("r IS NOT NULL").select("r.*")


_LISTS = ("author", "penciller", "publishers", "taiwan_publishers", "hongkong_publishers", "japan_publishers", "magazine", "genre", "tags")
_TEXTS = ("title", "original_title", "english_title", "label", "start", "end")
_WORK = ", ".join([*[f"`{c}` string" for c in _TEXTS], "volume_count bigint", "chapter_count bigint", *[f"{c} array<string>" for c in _LISTS], "raw_fields map<string,string>"])
_CACHED = "schema_version int, series_name string, metadata struct<page_title:string,pageid:bigint,page_url:string,wikibase_item:string,summary:string,series_sort:string,categories:array<string>,main_manga:string>"


def cached_series(records: DataFrame, name: str, version: int, value: str = "value") -> DataFrame:
    """(name, metadata): what cache_records() wrote, read back with defaults for what is missing (SR15).

    Records of another version, of another series than `name` says, without a work, or that aren't JSON give no row.  Missing lists are
    empty, a missing title of the page is empty and its id 0.
    """
    record = records.select(name, F.from_json(value, _CACHED).alias("r")).where((F.col("r.schema_version") == version) & (F.col("r.series_name") == F.col(name)))
    m, w = F.col("r.metadata"), F.col("w")
    rows = record.withColumn("w", F.when(m["main_manga"].startswith("{"), F.from_json(m["main_manga"], _WORK))).where(w.isNotNull())
    empty = F.array().cast("array<string>")
    work = F.struct(*[w[c].alias(c) for c in (*_TEXTS, "volume_count", "chapter_count")], *[F.coalesce(w[c], empty).alias(c) for c in _LISTS], F.coalesce(w["raw_fields"], F.create_map().cast("map<string,string>")).alias("raw_fields"))
    filled = {"page_title": F.coalesce(m["page_title"], F.lit("")), "pageid": F.coalesce(m["pageid"], F.lit(0)), "categories": F.coalesce(m["categories"], empty)}
    plain = {c: m[c] for c in ("page_url", "wikibase_item", "summary", "series_sort")}
    return rows.select(name, F.struct(*[c.alias(k) for k, c in (filled | plain).items()], work.alias("main_manga")).alias("metadata"))


def cache_records(series: DataFrame, name: str, version: int) -> DataFrame:
    """(name, value): a series' other columns as the JSON record of its cache, to be written as text (SK9)."""
    metadata = F.struct(*[c for c in series.columns if c != name]).alias("metadata")
    record = F.to_json(F.struct(F.lit(version).alias("schema_version"), F.col(name).alias("series_name"), metadata), {"ignoreNullFields": "false"})
    return series.select(name, record.alias("value"))
