"""Queries of page plans, covers, listings and wiki answers; they are registered with the others when the catalogue is imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import covers, filters, pdf_pages, series
from quire.plans.catalogue import query, table
from quire.sources import archives, wiki

# pages of an order as a PDF file: one or two equal pictures, which fill the page, stick out or are sheared
_PDF_PAGES = """p AS (SELECT l_orderkey AS pdf, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS page_no, CAST(500 + l_quantity AS DOUBLE) AS w, l_partkey % 3 AS n,
 (l_suppkey % 3) * 0.08 <= 0.1 AND l_linenumber % 2 = 0 AS fits, 300 + (l_partkey * 37) % 4000 AS sw, l_suppkey % 7 <> 0 AND l_suppkey % 11 <> 0 AND l_linenumber % 5 <> 0 AND l_partkey % 13 <> 0 AND l_partkey % 2 = 0 AS plain FROM lineitem),
q AS (SELECT *, w + 200 AS h, sw + 400 AS sh, coalesce(plain AND fits AND n = 1, FALSE) AS lossless, CASE WHEN fits THEN n ELSE 0 END AS scans FROM p)"""


def _pdf_pages(spark, d):
    item = table(spark, d, "lineitem")
    w = (500 + F.col("l_quantity")).cast("double")
    bbox = F.array(F.lit(0.0), F.lit(0.0), w + (F.col("l_suppkey") % 3) * 0.08, w + 200)
    transform = F.array(w, F.lit(0.0), (F.col("l_linenumber") % 2) * 0.2, w + 200, F.lit(0.0), F.lit(0.0))
    size = (300 + (F.col("l_partkey") * 37) % 4000).cast("int")
    image = F.struct(F.lit(1).alias("xref"), (F.col("l_partkey") % 13 == 0).alias("has_mask"), bbox.alias("bbox"), transform.alias("transform"), size.alias("width"), (size + 400).alias("height"), F.when(F.col("l_partkey") % 2 == 0, "JPG").otherwise("png").alias("ext"))
    shown = F.struct(F.when(F.col("l_linenumber") % 5 != 0, "fill-image").otherwise("fill-text").alias("kind"), F.array(F.lit(0.0), F.lit(0.0), w, w + 200).alias("bbox"))
    rows = item.select(
        F.col("l_orderkey").alias("pdf"), F.expr("cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int)").alias("page_no"), w.alias("width"), (w + 200).alias("height"), F.when(F.col("l_suppkey") % 7 == 0, 90).otherwise(0).alias("rotation"),
        (F.col("l_suppkey") % 11 == 0).alias("annotated"), F.array_repeat(image, (F.col("l_partkey") % 3).cast("int")).alias("images"), F.array(shown).alias("display"), "l_partkey",
    )
    return pdf_pages.planned(rows)


@query(
    "pdf_page_plan",
    f"""WITH {_PDF_PAGES},
e AS (SELECT pdf, CAST(least(round_even(median(greatest(sw, sh)), 0), 4000) AS INTEGER) AS edge FROM q, range(2) AS r(k) WHERE r.k < scans AND greatest(sw, sh) >= 1200 GROUP BY pdf),
f AS (SELECT q.*, coalesce(edge, 3500) AS long_edge FROM q LEFT JOIN e ON q.pdf = e.pdf),
g AS (SELECT *, greatest(36, least(300, round_even(long_edge * CAST(72 AS DOUBLE) / greatest(w, h), 0))) AS target, CASE WHEN scans > 0 THEN round_even(greatest(sw * CAST(72 AS DOUBLE) / w, sh * CAST(72 AS DOUBLE) / h), 0) END AS own FROM f)
SELECT pdf, page_no, lossless, CAST(scans AS INTEGER) AS scans, long_edge, CAST(CASE WHEN NOT lossless THEN CASE WHEN own BETWEEN 36 AND 300 THEN least(target, own) ELSE target END END AS INTEGER) AS dpi FROM g""",
)
def pdf_page_plan(spark, d):
    """Which pages of a file are taken as they are, and the resolution of the others (CO1, CO2, AG5, SR19, FI14, SC27)."""
    return _pdf_pages(spark, d).select("pdf", "page_no", "lossless", F.size("scans").alias("scans"), "long_edge", "dpi")


@query(
    "pdf_outcome",
    f"""WITH {_PDF_PAGES}, s AS (SELECT pdf, page_no, CASE WHEN lossless THEN 'lossless' WHEN page_no % 2 = 1 THEN 'first' WHEN page_no % 3 <> 0 AND sw % 2 = 0 THEN 'second' WHEN sw % 3 > 0 THEN 'third' ELSE 'failed' END AS strategy FROM q)
SELECT pdf, count(*) FILTER (strategy = 'lossless') AS lossless, count(*) FILTER (strategy = 'first') AS first, count(*) FILTER (strategy = 'second') AS second, count(*) FILTER (strategy = 'third') AS third,
 min(CASE WHEN strategy = 'failed' THEN page_no END) AS failed_page, min(CASE WHEN strategy = 'failed' THEN page_no END) IS NULL AS ok FROM s GROUP BY pdf""",
)
def pdf_outcome(spark, d):
    """Renderings that stand, and files that fail at a page (CO3-CO5, AG12)."""
    size = (300 + (F.col("l_partkey") * 37) % 4000).cast("int")
    rows = _pdf_pages(spark, d).withColumns({"blank": F.col("page_no") % 2 == 0, "second": (F.col("page_no") % 3 != 0) & (size % 2 == 0), "third": size % 3 > 0})
    return pdf_pages.outcomes(pdf_pages.recovered(rows))


@query(
    "page_ratio",
    """WITH r AS (SELECT p_brand, coalesce(median(CASE WHEN p_size % 7 > 0 THEN CAST(p_size % 7 AS DOUBLE) / (p_partkey % 5 + 1) END), 1.0) AS ratio FROM part GROUP BY p_brand)
SELECT p_partkey, round(ratio, 9) AS ratio, CAST(p_size % 7 AS DOUBLE) / (p_partkey % 5 + 1) >= 1.35 AS double_page FROM part JOIN r ON part.p_brand = r.p_brand""",
)
def page_ratio(spark, d):
    """The usual shape of a book's pages, and pages as wide as two (AG1, FI19)."""
    rows = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 7).cast("double").alias("w"), (F.col("p_partkey") % 5 + 1).alias("h"))
    ratio = series.page_ratio(rows, "p_brand", "w", "h")
    return rows.join(ratio, "p_brand").select("p_partkey", F.round("ratio", 9).alias("ratio"), filters.double_page(F.col("w"), F.col("h")).alias("double_page"))


_NAMES = ("cover", "p-end", "story_ads", "blend", "FrontCover_2", "Copyright", "a-b_adv")


@query(
    "page_names",
    f"""WITH n AS (SELECT p_partkey, concat('cover/', list_extract(['{"', '".join(_NAMES)}'], CAST(p_partkey % 7 + 1 AS INTEGER)), CASE WHEN p_partkey % 2 = 0 THEN '.XHTML' ELSE '.jpg' END) AS path FROM part)
SELECT p_partkey, path, p_partkey % 7 IN (0, 4) AS cover, p_partkey % 7 IN (1, 2, 5, 6) AS protected, p_partkey % 2 = 0 AS markup FROM n""",
)
def page_names(spark, d):
    """Names of covers, of pages that stay whole and of markup files (FI4, FI11)."""
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("p_partkey") % 7 + 1).cast("int"))
    path = F.concat(F.lit("cover/"), name, F.when(F.col("p_partkey") % 2 == 0, ".XHTML").otherwise(".jpg"))
    return table(spark, d, "part").select("p_partkey", path.alias("path"), filters.cover_name(path).alias("cover"), filters.protected_name(path).alias("protected"), filters.is_markup(path).alias("markup"))


@query(
    "cover_section",
    """WITH v AS (SELECT CAST((vec_id - vec_id % 12) / 12 AS BIGINT) AS book, CAST(vec_id % 12 AS INTEGER) AS place, vec_id % 5 = 3 AS safe, vec_id % 7 = 2 AS colour,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: x - list_avg(CAST(embedding AS DOUBLE[]))) AS e FROM embeddings),
c AS (SELECT book, place, colour, e, safe AND place > 0 AS safe FROM v WHERE place < 4),
near AS (SELECT a.book, a.place AS i, b.place AS j FROM c a JOIN c b ON a.book = b.book AND a.place < b.place AND NOT a.safe AND NOT b.safe AND list_cosine_similarity(a.e, b.e) >= 0.3),
k0 AS (SELECT book, place, safe, colour, place = 0 OR safe AS kept FROM c),
m AS (SELECT k0.*, bool_or(coalesce(i = 0, FALSE)) AS n0, bool_or(coalesce(i = 1, FALSE)) AS n1, bool_or(coalesce(i = 2, FALSE)) AS n2 FROM k0 LEFT JOIN near ON k0.book = near.book AND k0.place = near.j GROUP BY ALL),
one AS (SELECT book, NOT n0 AS led FROM m WHERE place = 1),
two AS (SELECT m.book, NOT (m.n0 OR (m.n1 AND one.led)) AS led FROM m JOIN one ON m.book = one.book WHERE m.place = 2),
kept AS (SELECT m.book, m.place, m.colour, CASE m.place WHEN 0 THEN TRUE WHEN 1 THEN m.safe OR NOT m.n0 WHEN 2 THEN m.safe OR NOT (m.n0 OR (m.n1 AND one.led)) ELSE m.safe OR NOT (m.n0 OR (m.n1 AND one.led) OR (m.n2 AND two.led)) END AS kept
 FROM m LEFT JOIN one ON m.book = one.book LEFT JOIN two ON m.book = two.book),
spare AS (SELECT book, max(place) + 1 AS place, min(CASE WHEN colour THEN place END) AS from_place FROM kept GROUP BY book HAVING NOT bool_or(kept AND colour) AND bool_or(colour))
SELECT book, concat('p', place) AS path, 0 AS section, place FROM kept WHERE kept UNION ALL SELECT book, concat('p', from_place), 0, CAST(place AS INTEGER) FROM spare UNION ALL SELECT book, concat('p', place), 1, place FROM v WHERE place >= 4""",
)
def cover_section(spark, d):
    """Covers without near-duplicates, one in colour, then the other pages (WI8, SE3, WI4), a dozen vectors being a book."""
    place = (F.col("vec_id") % 12).cast("int")
    pictures = table(spark, d, "embeddings").select(
        ((F.col("vec_id") - F.col("vec_id") % 12) / 12).cast("long").alias("book"), place.alias("spine"), place.alias("place"), F.concat(F.lit("p"), place).alias("path"), F.col("embedding").alias("histogram"),
        (F.col("vec_id") % 5 == 3).alias("protected"), (F.col("vec_id") % 7 == 2).alias("colour"),
    )
    return covers.cover_section(pictures, 0.3)


@query("smallest_files", """SELECT doc_id AS path, n_chars AS length FROM documents ORDER BY n_chars, doc_id LIMIT 10""")
def smallest_files(spark, d):
    """A report of the ten smallest files (SC28)."""
    return archives.smallest(table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("length")))


@query(
    "natural_entries",
    """SELECT page_id % 50 AS archive, concat('ch', page_id % 100, '/p', page_id, CASE WHEN page_id % 3 = 0 THEN '.html' ELSE '.JPG' END) AS name, CASE WHEN page_id % 3 = 0 THEN 'markup' ELSE 'image' END AS kind,
 CAST(row_number() OVER (PARTITION BY page_id % 50, page_id % 3 ORDER BY page_id % 100, page_id) AS INTEGER) AS place FROM pages WHERE page_id % 3 < 2""",
)
def natural_entries(spark, d):
    """Markup files and pictures of each archive in natural order (SC5, SC6, SO2)."""
    name = F.concat(F.lit("ch"), F.col("page_id") % 100, F.lit("/p"), "page_id", F.when(F.col("page_id") % 3 == 0, ".html").when(F.col("page_id") % 3 == 1, ".JPG").otherwise(".css"))
    entries = table(spark, d, "pages").select((F.col("page_id") % 50).alias("archive"), name.alias("name"))
    kinds = {"markup": filters.is_markup(F.col("name")), "image": filters.is_image(F.col("name"))}
    found = [archives.in_natural_order(entries, wanted).withColumn("kind", F.lit(kind)) for kind, wanted in kinds.items()]
    return found[0].unionByName(found[1])


@query(
    "repair_targets",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('/b/', p_size) WHEN p_partkey % 3 = 0 THEN concat('/d/', p_brand) ELSE '/base' END AS target_dir,
 CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 7 = 0 OR (p_partkey % 7 > 1 AND p_partkey % 2 = 1) THEN CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'base' END END AS series_title,
 CASE WHEN p_partkey % 2 = 0 THEN concat('/b/', p_size, '/v.1 ', p_partkey, '.cropped.cbz') END AS cropped FROM part""",
)
def repair_targets(spark, d):
    """Where archives are repaired, the title that is looked up, and names of cropped files (HP11, HP14, HP18)."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(key % 2 == 0, F.concat(F.lit("/b/"), "p_size", F.lit("/v.1 "), key, F.lit(".cbz"))).alias("cbz"), F.when(key % 3 == 0, F.concat(F.lit("/d/"), "p_brand")).alias("dir"), F.lit("/base").alias("base"),
        F.when(key % 5 == 0, F.col("p_name")).otherwise("").alias("title"), F.when(key % 7 == 0, True).when(key % 7 == 1, False).alias("title_from_dir"),
    )
    return archives.repair_targets(rows).select("p_partkey", "target_dir", "series_title", archives.cropped_path(F.col("cbz")).alias("cropped"))


@query(
    "wiki_search_hits",
    """SELECT l_orderkey AS query, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS rank, concat('T ', l_partkey) AS title, l_suppkey AS pageid, l_returnflag AS snippet FROM lineitem WHERE l_partkey % 4 > 0 AND l_suppkey % 3 > 0""",
)
def wiki_search_hits(spark, d):
    """Hits of saved searches, in their order, without those that name no page (SC15)."""
    hit = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit("T "), "l_partkey")).otherwise("").alias("title"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).otherwise(0).alias("pageid"), F.col("l_returnflag").alias("snippet"))
    hits = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query")).agg(F.array_sort(F.collect_list(hit)).alias("search"))
    answers = hits.select("query", F.to_json(F.struct(F.struct("search").alias("query"))).alias("answer"))
    return wiki.search_hits(answers, "query").select("query", "rank", "title", "pageid", "snippet")


@query(
    "wiki_page_data",
    """SELECT c_name AS requested, CASE WHEN c_custkey % 6 = 0 THEN c_name ELSE concat('P', c_custkey) END AS title, c_custkey AS pageid, coalesce(CASE WHEN c_custkey % 2 = 0 THEN concat('u/', c_custkey) END, 's/' || s_nationkey) AS page_url,
 coalesce(s_name, c_mktsegment) AS extract, CASE WHEN c_custkey % 5 > 0 THEN concat('to ', c_name) END AS converted_title, concat('text ', c_custkey) AS wikitext
FROM customer LEFT JOIN (SELECT concat('P', s_suppkey) AS t, s_name, s_nationkey FROM supplier) ON t = CASE WHEN c_custkey % 6 = 0 THEN c_name ELSE concat('P', c_custkey) END WHERE c_custkey % 7 > 0 AND c_custkey % 4 < 3""",
)
def wiki_page_data(spark, d):
    """Pages of saved answers in both shapes of their text, with what summaries add (SC16, SC17, SC19, SR13, SR14, HP24)."""
    key = F.col("c_custkey")
    text = F.concat(F.lit("text "), key)
    main = F.struct(F.when(key % 4 == 0, text).alias("*"), F.when(key % 4 == 1, text).alias("content"))
    revision = F.struct(F.when(key % 4 == 2, text).alias("*"), F.when(key % 4 < 2, F.struct(main.alias("main"))).alias("slots"))
    page = F.struct(key.alias("pageid"), F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("P"), key)).alias("title"), F.when(key % 2 == 0, F.concat(F.lit("u/"), key)).alias("fullurl"), F.col("c_mktsegment").alias("extract"), F.when(key % 7 == 0, "").alias("missing"), F.when(key % 4 < 3, F.array(revision)).alias("revisions"))
    converted = F.array(F.struct(F.when(key % 5 > 0, F.col("c_name")).otherwise("other").alias("from"), F.concat(F.lit("to "), "c_name").alias("to")))
    answers = table(spark, d, "customer").select(F.col("c_name").alias("requested"), F.to_json(F.struct(F.struct(F.create_map(key.cast("string"), page).alias("pages"), converted.alias("converted")).alias("query"))).alias("answer"))
    short = F.struct(F.concat(F.lit("P"), "s_suppkey").alias("title"), F.col("s_name").alias("extract"), F.struct(F.struct(F.concat(F.lit("s/"), "s_nationkey").alias("page")).alias("desktop")).alias("content_urls"))
    summary = wiki.summaries(table(spark, d, "supplier").select("s_suppkey", F.to_json(short).alias("answer")), "s_suppkey")
    return wiki.page_data(wiki.pages(answers, "requested"), summary, "requested").select("requested", "title", "pageid", "page_url", "extract", "converted_title", "wikitext")
