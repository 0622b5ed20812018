"""The metadata record of an archive: 49 fields, normalised, as XML and back, and filled from wiki pages (SR3-SR8, SR10-SR12).

A record is a row whose columns are named as in FIELDS.  All of it is column expressions; XML is written by
concatenation, byte for byte in one layout, and read by from_xml.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import clean, text

# The fields in the order in which they are written, as (name, tag, kind).
FIELDS = (
    ("title", "Title", "text"), ("series", "Series", "text"), ("localized_series", "LocalizedSeries", "text"), ("series_sort", "SeriesSort", "text"), ("title_sort", "TitleSort", "text"),
    ("number", "Number", "text"), ("count", "Count", "int"), ("volume", "Volume", "int"), ("alternate_series", "AlternateSeries", "text"), ("alternate_number", "AlternateNumber", "text"),
    ("alternate_count", "AlternateCount", "int"), ("summary", "Summary", "text"), ("notes", "Notes", "text"), ("year", "Year", "int"), ("month", "Month", "int"), ("day", "Day", "int"),
    ("writer", "Writer", "list"), ("penciller", "Penciller", "list"), ("inker", "Inker", "list"), ("colorist", "Colorist", "list"), ("letterer", "Letterer", "list"),
    ("cover_artist", "CoverArtist", "list"), ("editor", "Editor", "list"), ("translator", "Translator", "list"), ("publisher", "Publisher", "text"), ("imprint", "Imprint", "text"),
    ("genre", "Genre", "list"), ("tags", "Tags", "list"), ("web", "Web", "text"), ("page_count", "PageCount", "int"), ("language_iso", "LanguageISO", "text"), ("format", "Format", "text"),
    ("black_and_white", "BlackAndWhite", "enum"), ("manga", "Manga", "enum"), ("characters", "Characters", "list"), ("teams", "Teams", "list"), ("locations", "Locations", "list"),
    ("scan_information", "ScanInformation", "text"), ("story_arc", "StoryArc", "text"), ("story_arc_number", "StoryArcNumber", "text"), ("series_group", "SeriesGroup", "list"),
    ("age_rating", "AgeRating", "enum"), ("pages", "Pages", "pages"), ("community_rating", "CommunityRating", "rating"), ("main_character_or_team", "MainCharacterOrTeam", "text"),
    ("review", "Review", "text"), ("gtin", "GTIN", "text"), ("isbn", "Isbn", "text"), ("user_rating", "UserRating", "rating"),
)
# Other tags that are read, vocabularies with what an unknown value becomes, page types, page attributes.
ALIASES = {"AlternativeSeries": "AlternateSeries", "AlternativeNumber": "AlternateNumber", "AlternativeCount": "AlternateCount"}
VOCABULARIES = {
    "black_and_white": (("Unknown", "No", "Yes"), "Unknown"),
    "manga": (("Unknown", "No", "Yes", "YesAndRightToLeft"), "Yes"),
    "age_rating": (("Unknown", "Rating Pending", "Early Childhood", "Everyone", "G", "Everyone 10+", "PG", "Kids to Adults", "Teen", "MA15+", "Mature 17+", "M", "R18+", "Adults Only 18+", "X18+"), "Unknown"),
}
PAGE_TYPES = ("FrontCover", "InnerCover", "Roundup", "Story", "Advertisement", "Editorial", "Letters", "Preview", "BackCover", "Other", "Deleted")
PAGE_ATTRIBUTES = (
    ("image", "Image", "int"), ("page_type", "Type", "types"), ("double_page", "DoublePage", "flag"), ("image_size", "ImageSize", "int"), ("key", "Key", "text"), ("bookmark", "Bookmark", "text"),
    ("image_width", "ImageWidth", "int"), ("image_height", "ImageHeight", "int"),
)
DISPLAY_NAMES = {"手代木史织": "手代木史織", "秋田书店": "秋田書店"}

_KINDS = {"text": "string", "enum": "string", "int": "bigint", "list": "array<string>", "rating": "decimal(2,1)", "types": "array<string>", "flag": "boolean"}
PAGE = "struct<" + ", ".join(f"{n}: {_KINDS[k]}" for n, _, k in PAGE_ATTRIBUTES) + ">"
_KINDS["pages"] = f"array<{PAGE}>"


def page_types(value: Column) -> Column:
    """The page types of a vocabulary that a string or an array names, each once, in order (SR8)."""
    known = F.filter(F.transform(value, lambda v: clean.one_of(clean.text(v), PAGE_TYPES, None)), lambda v: v.isNotNull())
    return F.coalesce(F.array_distinct(known), F.array().cast("array<string>"))


def _page(p: Column) -> Column:
    make = {"int": clean.integer, "types": page_types, "flag": clean.boolean, "text": clean.text}
    return F.struct(*[make[kind](p[name]).cast(_KINDS[kind]).alias(name) for name, _, kind in PAGE_ATTRIBUTES])


def _list_sql(name: str, kind: str) -> str:
    """A list as it is written: joined with commas, cut at all of them again, and cleaned."""
    joined = f"array_join(`{name}`, ',')" if kind.startswith("array") else f"`{name}`"
    return f"coalesce(filter(transform(split({joined}, ','), v -> {clean.text_sql('v')}), v -> v is not null), cast(array() as array<string>))"


def normalise(df: DataFrame) -> DataFrame:
    """All fields of a record, normalised (SR6); those that `df` lacks are empty, and its other columns are kept.

    Two projections: the first cleans texts and lists, the second turns them into what the fields are, so a cleaned value is worked out
    once.  Both are SQL texts, as thousands of Column calls take longer than the work itself.
    """
    have = dict(df.dtypes)
    others = [c for c in df.columns if c not in {n for n, _, _ in FIELDS}]
    first, second = [], []
    for name, _, kind in FIELDS:
        at, out = f"`__{name}`", f"`{name}`"
        if name not in have:
            empty = "cast(array() as {})" if kind in ("list", "pages") else "cast(null as {})"
            second.append(F.expr(empty.format(_KINDS[kind])).alias(name))
            continue
        if kind == "pages":
            second.append(F.coalesce(F.filter(F.transform(F.col(f"__{name}"), _page), lambda p: p["image"].isNotNull()), F.array().cast(_KINDS["pages"])).alias(name))
            first.append(F.col(out).alias(f"__{name}"))
            continue
        first.append(F.expr(_list_sql(name, have[name]) if kind == "list" else f"cast({out} as string)" if kind == "rating" else clean.text_sql(out)).alias(f"__{name}"))
        if kind == "list":
            value = f"filter({at}, (v, i) -> array_position(transform({at}, x -> lower(x)), lower(v)) = i + 1)"
        elif kind == "enum":
            allowed, default = VOCABULARIES[name]
            names = ", ".join(f"'{x}'" for x in allowed)
            value = f"case when {at} is not null then coalesce(get(filter(array({names}), a -> lower(a) = lower(trim({at}))), 0), '{default}') end"
        elif kind == "int":
            value = f"coalesce(try_cast({at} as bigint), try_cast(try_cast({at} as double) as bigint))"
        elif kind == "rating":
            value = f"case when round(try_cast({at} as decimal(20,6)), 1) between 0 and 5 then cast(round(try_cast({at} as decimal(20,6)), 1) as decimal(2,1)) end"
        else:
            value = at
        second.append(F.expr(f"cast({value} as {_KINDS[kind]})").alias(name))
    kept = [F.col(f"`{c}`") for c in others]
    return df.select(*kept, *first).select(*kept, *second)


def _escaped(value: Column, attribute: bool = False) -> Column:
    marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if attribute:
        marks += [('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")]
    for a, b in marks:
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _page_xml(p: Column) -> Column:
    parts = []
    for name, tag, kind in PAGE_ATTRIBUTES:
        value = F.nullif(F.array_join(p[name], " "), F.lit("")) if kind == "types" else p[name].cast("string")
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f' {tag}="'), _escaped(value, True), F.lit('"'))).otherwise(""))
    return F.concat(F.lit("\n    <Page"), *parts, F.lit("></Page>"))


def to_xml() -> Column:
    """The XML of a normalised record (SR3, HP19, HP21); empty fields are left out."""
    parts = []
    for name, tag, kind in FIELDS:
        value = F.col(name)
        if kind == "pages":
            parts.append(F.when(F.size(value) > 0, F.concat(F.lit("\n  <Pages>"), F.array_join(F.transform(value, _page_xml), ""), F.lit("\n  </Pages>"))).otherwise(""))
            continue
        said = f"nullif(array_join(`{name}`, ', '), '')" if kind == "list" else f"cast(`{name}` as string)"
        said = f"replace(replace(replace({said}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
        parts.append(F.expr(f"coalesce(concat('\\n  <{tag}>', {said}, '</{tag}>'), '')"))
    inner = F.concat(*parts)
    return F.concat(F.lit("<?xml version='1.0' encoding='utf-8'?>\n<ComicInfo>"), inner, F.when(inner != "", "\n").otherwise(""), F.lit("</ComicInfo>"))


def from_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Records from the XML in a column (SR4, SR5), beside the other columns.

    Unknown tags and pages without a number are passed over; what isn't such a record gives one without any field.
    """
    read = [(tag, f"{tag}: {'struct<Page: array<struct<' + ', '.join(f'_{t}: string' for _, t, _ in PAGE_ATTRIBUTES) + '>>>' if kind == 'pages' else 'string'}") for _, tag, kind in FIELDS]
    schema = ", ".join(x for _, x in read).replace(": ", " ", 0) + "".join(f", {a}: string" for a in ALIASES)
    body = F.regexp_replace(F.col(xml).cast("string"), r"^\s*<\?xml[^>]*\?>\s*", "")
    usable = F.when(body.rlike(r"^<ComicInfo[\s/>]"), body).otherwise("<ComicInfo></ComicInfo>")
    rows = df.withColumn("__r", F.from_xml(usable, f"struct<{schema}>"))
    fields = []
    for name, tag, kind in FIELDS:
        value = F.col(f"__r.{tag}")
        if kind == "pages":
            page = lambda p: F.struct(*[(F.split(F.trim(p[f"_{t}"]), r"\s+") if k == "types" else p[f"_{t}"]).alias(n) for n, t, k in PAGE_ATTRIBUTES])
            fields.append(F.transform(value["Page"], page).alias(name))
        else:
            other = [F.col(f"__r.{a}") for a, t in ALIASES.items() if t == tag]
            fields.append(F.coalesce(*other, value).alias(name))
    others = [c for c in df.columns if c != xml and c not in {n for n, _, _ in FIELDS}]
    return normalise(rows.select(*[F.col(f"`{c}`") for c in others], *fields))


def _body(xml: Column) -> Column:
    """The record without its declaration; what isn't a well-formed record is an empty one."""
    body = F.regexp_replace(xml.cast("string"), r"^\s*<\?xml[^>]*\?>\s*", "")
    # a reader of a schema forgives what a reader of variants fails on
    broken = F.from_xml(body, "__broken string", {"columnNameOfCorruptRecord": "__broken"})["__broken"].isNotNull()
    return F.when(body.rlike(r"^<ComicInfo[\s/>]") & ~broken, body).otherwise("<ComicInfo></ComicInfo>")


def held_tags(xml: Column) -> Column:
    """The names of all tags that a record holds, known or not: it is read as a VARIANT, which needs no schema."""
    tags = F.map_keys(F.from_json(F.to_json(F.from_xml(_body(xml), "variant")), "map<string,string>"))
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~t.startswith("_"))


def unknown_tags(df: DataFrame, xml: str = "xml") -> DataFrame:
    """df with `extra`: the tags of each record that the field table doesn't know, with what each of their elements holds, as it was written (SE4)."""
    known = F.array(*[F.lit(t) for _, t, _ in FIELDS], *[F.lit(a) for a in ALIASES])
    rows = df.withColumn("__body", _body(F.col(xml)))
    inner = lambda t: F.regexp_extract_all("__body", F.concat(F.lit("(?s)<"), t, F.lit(r"(?:\s[^>]*?)?(?:/>|>(.*?)</"), t, F.lit(r"\s*>)")), F.lit(1))
    names = F.array_except(held_tags(F.col(xml)), known)
    return rows.withColumn("extra", F.map_from_arrays(names, F.transform(names, inner))).drop("__body")


def with_unknown_tags(xml: Column, extra: Column) -> Column:
    """The XML of to_xml() with the elements of unknown_tags() after its own, in order of their names."""
    entries = F.array_sort(F.map_entries(F.coalesce(extra, F.create_map().cast("map<string,array<string>>"))))
    element = lambda e: F.array_join(F.transform(e["value"], lambda v: F.concat(F.lit("\n  <"), e["key"], F.lit(">"), v, F.lit("</"), e["key"], F.lit(">"))), "")
    added = F.array_join(F.transform(entries, element), "")
    bare = F.regexp_replace(F.regexp_replace(xml, "</ComicInfo>$", ""), r"\n$", "")
    return F.when(added == "", xml).otherwise(F.concat(bare, added, F.lit("\n</ComicInfo>")))


def tag_difference(held: DataFrame, key: str, emitted: list[str] | None = None) -> DataFrame:
    """(key, tag) of the tags that records hold and the field table doesn't write, each once (SE4).

    One pass, and an outer explode: for an inner one Spark infers a filter, for which the tags would be read two more times.

    held: key and `tags`, an array as held_tags() gives it.
    """
    written = emitted or [*[t for _, t, _ in FIELDS], *ALIASES]
    rows = held.select(key, F.explode_outer("tags").alias("tag"))
    return rows.where(F.col("tag").isNotNull() & ~F.col("tag").isin(written)).distinct()


# --- from wiki pages ------------------------------------------------------------------------------------


def display_name(value: Column) -> Column:
    """A person or publisher as shown, in the collection's script (ST45)."""
    out = value
    for a, b in DISPLAY_NAMES.items():
        out = F.when(value == a, b).otherwise(out)
    return F.nullif(out, F.lit(""))


def _display_list(values: Column) -> Column:
    return F.filter(F.transform(values, display_name), lambda v: v.isNotNull())


def tags_of(work: Column, categories: Column) -> Column:
    """Tags, genres, magazines and the categories that say something about the work, each once (ST44)."""
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(x, none) for x in (work["tags"], work["genre"], work["magazine"], text.content_categories(categories))])
    plain = F.filter(F.transform(every, lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")), lambda v: v != "")
    return text.ordered_distinct(plain)


def notes_of(wikibase_item: Column, page_url: Column) -> Column:
    """Where the data come from (ST46)."""
    given = lambda c, lead: F.when(c != "", F.concat(F.lit(lead), c))
    return F.nullif(F.concat_ws("\n", given(wikibase_item, "Wikidata: "), given(page_url, "Source: ")), F.lit(""))


def series_title(work: Column, page_title: Column) -> Column:
    """The work's title, else its original, its English one, or the page's (HP29)."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (work["title"], work["original_title"], work["english_title"], page_title)])


def from_wiki(df: DataFrame, write_number: bool = True, write_volume: bool = False, language: str = "zh-Hant-TW", manga: str = "Yes", age_rating: str | None = "Teen") -> DataFrame:
    """Records from rows of wiki series (page_title, page_url, wikibase_item, summary, series_sort, categories, main) with `volume_number` (SR10).

    `main` is the struct of the work's box.  Columns `title`, `series_title` and `sort_title`, where there are any, go before
    what the page says; other columns are left aside, but for `key`, which is kept.
    """
    given = lambda name: F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")
    work, number = F.col("main"), F.regexp_replace(F.col("volume_number").cast("string"), r"(?U)^\s+|\s+$", "")
    series = F.coalesce(given("series_title"), series_title(work, F.col("page_title")))
    has_tags = "tags" in df.schema["main"].dataType.names
    work = work if has_tags else work.withField("tags", F.array().cast("array<string>"))
    fields = {
        "title": F.coalesce(given("title"), F.concat(F.lit("第 "), number, F.lit(" 卷"))),
        "series": series,
        "localized_series": series,
        "series_sort": F.coalesce(given("sort_title"), F.nullif(F.col("series_sort"), F.lit("")), series),
        "number": number if write_number else F.lit(None).cast("string"),
        "count": work["volume_count"],
        "volume": text.first_count(number) if write_volume else F.lit(None).cast("bigint"),
        "summary": F.col("summary"),
        "year": text.year(work["start"]),
        "writer": _display_list(work["author"]),
        "penciller": _display_list(work["penciller"]),
        "publisher": text.preferred_publisher(F.transform(work["taiwan_publishers"], display_name), F.transform(work["hongkong_publishers"], display_name)),
        "imprint": work["label"],
        "genre": text.genres(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (work["genre"], F.col("categories"))])),
        "tags": tags_of(work, F.col("categories")),
        "web": F.col("page_url"),
        "page_count": F.col("page_count") if "page_count" in df.columns else F.lit(None).cast("bigint"),
        "language_iso": F.lit(language),
        "manga": F.lit(manga),
        "age_rating": F.lit(age_rating),
        "notes": notes_of(F.col("wikibase_item"), F.col("page_url")),
        **({"format": F.col("format")} if "format" in df.columns else {}),
    }
    keys = ["key"] if "key" in df.columns else []
    return normalise(df.select(*keys, *[v.alias(n) for n, v in fields.items()]))


def for_books(books: DataFrame) -> DataFrame:
    """Records of EPUB books (path, archive, page_count, books_in_folder, and the wiki series' columns) (SR11).

    The folder is the series; specials keep their own title, and a volume's number comes from the file's name, else from
    the archive's.  Books that are neither have no record.  The count falls back to the books in the folder.
    """
    parts = F.filter(F.split(F.translate("path", "\\", "/"), "/"), lambda p: p != "")
    name, series = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    lead = F.concat(series, F.lit(" - "))
    cleaned = text.clean_name(F.regexp_replace(name, r"\.[^.]*$", ""))
    own = F.when(F.startswith(F.lower(cleaned), F.lower(lead)), F.trim(F.substring(cleaned, F.length(lead) + 1, F.length(cleaned)))).otherwise(cleaned)
    rows = books.withColumns({"__own": own, "series_title": series, "sort_title": series})
    rows = rows.withColumns({"__special": text.special_label(F.col("__own")).isNotNull(), "__volume": F.coalesce(text.inferred_volume(name), text.inferred_volume(F.col("archive")))})
    rows = rows.where(F.col("__special") | F.col("__volume").isNotNull())
    rows = rows.withColumns({"title": F.when(F.col("__special"), F.col("__own")), "volume_number": F.coalesce("__volume", F.lit("0")), "format": F.when(F.col("__special"), "Special"), "key": F.struct("path", "archive", "__volume", "books_in_folder")})
    out = from_wiki(rows)
    unnumbered = F.col("key.__volume").isNull()
    fallback = F.when(F.col("key.books_in_folder") > 0, F.col("key.books_in_folder"))
    out = out.withColumns({"number": F.when(~unnumbered, F.col("number")), "count": F.coalesce("count", fallback.cast("bigint"))})
    return out.select(F.col("key.path").alias("path"), F.col("key.archive").alias("archive"), *[n for n, _, _ in FIELDS])
