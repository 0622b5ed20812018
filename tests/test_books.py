"""Covers, PDF page decisions, listings and saved wiki answers on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.text import natural_key
from quire.operators import covers, filters, pdf_pages
from quire.sources import archives as A
from quire.sources import wiki as W

IMAGE = "struct<xref:int,has_mask:boolean,bbox:array<double>,transform:array<double>,width:int,height:int,ext:string>"
PAGES = f"pdf string, page_no int, width double, height double, rotation int, annotated boolean, images array<{IMAGE}>, display array<struct<kind:string,bbox:array<double>>>"


def pdf_page(pdf, n, size=(1200, 1600), **change):
    box, shown = [0.0, 0.0, 600.0, 800.0], change.pop("display", [("fill-image", [0.0, 0.0, 600.05, 800.0])])
    image = {"xref": 3, "has_mask": False, "bbox": box, "transform": [600.0, 0.0, 0.0, 800.0, 0.0, 0.0], "width": size[0], "height": size[1], "ext": "jpeg"}
    image |= {k: v for k, v in change.items() if k in image}
    return (pdf, n, 600.0, 800.0, change.get("rotation", 0), change.get("annotated", False), [tuple(image.values())] * change.get("copies", 1), shown)


def test_pdf_pages(spark):
    ways = [{}, {"rotation": 90}, {"annotated": True}, {"copies": 2}, {"copies": 0}, {"has_mask": True}, {"bbox": [0.0, 0.0, 600.2, 800.0]}, {"transform": [-600.0, 0.0, 0.0, 800.0, 0.0, 0.0]}, {"ext": "png"}, {"display": []}, {"xref": 0}, {"bbox": None}, {"size": (300, 400)}]
    rows = [pdf_page("a", k + 1, **w) for k, w in enumerate(ways)] + [pdf_page("b", 1, size=(30, 40), ext="png"), pdf_page("c", 1, copies=0)]
    got = {(r.pdf, r.page_no): r for r in pdf_pages.planned(spark.createDataFrame(rows, PAGES)).collect()}
    assert [k for k in range(13) if got["a", k + 1].lossless] == [0, 12]
    assert {len(got["a", k + 1].scans) for k in (4, 6, 7, 11)} == {0} and len(got["a", 4].scans) == 2
    assert {r.long_edge for k, r in got.items() if k[0] == "a"} == {1600} and got["b", 1].long_edge == 3500
    assert got["a", 1].dpi is None and got["a", 2].dpi == 144 and got["c", 1].dpi == 300  # 4 points a DPI beyond 36 are not used
    assert got["b", 1].dpi == 300  # a scan of fewer than 36 DPI doesn't count
    assert pdf_pages.planned(spark.createDataFrame([], PAGES)).count() == 0


def test_recovered_pages(spark):
    rows = spark.createDataFrame([("a", 1, True, None, None, None), ("a", 2, False, False, None, None), ("a", 3, False, True, True, None), ("b", 1, False, True, False, True), ("b", 2, False, True, None, False)], "pdf string, page_no int, lossless boolean, blank boolean, second boolean, third boolean")
    assert [r.strategy for r in pdf_pages.recovered(rows).orderBy("pdf", "page_no").collect()] == ["lossless", "first", "second", "third", "failed"]
    assert {r.pdf: (r.ok, r.failed_page) for r in pdf_pages.outcomes(pdf_pages.recovered(rows)).collect()} == {"a": (True, None), "b": (False, 2)}


def plain_section(pictures, alike):
    """Covers one by one, as a reader would go through them."""
    first = [p for p in pictures if p["spine"] < covers.COVER_PLACES]
    kept, seen = [], []
    for k, p in enumerate(first):
        safe = p["protected"] and k > 0
        if not safe and any(np.corrcoef(p["histogram"], h)[0, 1] >= alike for h in seen):
            continue
        kept.append(p)
        if not safe:
            seen.append(p["histogram"])
    if not any(p["colour"] for p in kept):
        kept += [p for p in first if p["colour"]][:1]
    return [(0, p["path"]) for p in kept] + [(1, p["path"]) for p in pictures if p["spine"] >= covers.COVER_PLACES]


@pytest.mark.parametrize("seed", range(4))
def test_cover_section(spark, seed):
    dice = np.random.default_rng(seed)
    shapes = dice.random((3, 16))
    rows, expected = [], {}
    for book in range(8):
        spine = sorted(dice.integers(0, 7, 9).tolist())
        pictures = [{"book": book, "spine": s, "place": k, "path": f"{k}.jpg", "histogram": (shapes[dice.integers(3)] + dice.random(16) * 0.01).tolist(), "protected": bool(dice.random() < 0.3), "colour": bool(dice.random() < 0.2)} for k, s in enumerate(spine)]
        rows += pictures
        expected[book] = plain_section(pictures, covers.ALIKE)
    schema = "book int, spine int, place int, path string, histogram array<double>, protected boolean, colour boolean"
    found = covers.cover_section(spark.createDataFrame(rows, schema)).orderBy("book", "section", "place").collect()
    assert {b: [(r.section, r.path) for r in found if r.book == b] for b in expected} == expected
    assert covers.cover_section(spark.createDataFrame([], schema)).count() == 0


def test_names_and_titles(spark):
    lines = spark.createDataFrame([("免責 聲明", [("x", 10.0), ("【免責聲明】", 550.0)], 1000), ("免責聲明", [("免責聲明", 560.0)], 1000), ("a", [], 10), (None, [("a", 1.0)], 10)], "title string, lines array<struct<text:string,y:double>>, height int")
    assert [r[0] for r in lines.select(filters.title_high(F.col("title"), F.col("lines"), F.col("height"))).collect()] == [True, False, False, False]
    names = ["a/封面1.html", "x/Cover.xhtml", "cover/page.html", "z/the_end.jpg", "legend.png", "end", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(filters.cover_name(F.col("n")), filters.protected_name(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(True, False), (True, False), (False, False), (False, True), (False, False), (False, True), (False, False)]


def test_listings(spark, tmp_path):
    for name in ("b/10.jpg", "b/9.PNG", "a/x.txt", "c.webp"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"0" * len(name) * (2 if name == "c.webp" else 1))
    found = A.list_images(spark, str(tmp_path))
    assert [r.relative for r in found.collect()] == ["b/10.jpg", "b/9.PNG", "c.webp"]
    assert [r.relative for r in A.smallest(found, 2).collect()] == ["b/9.PNG", "b/10.jpg"]
    entries = spark.createDataFrame([("a", "p10.htm"), ("a", "p9.HTML"), ("a", "2.xhtml"), ("a", "x.png"), ("b", "y.txt")], "archive string, name string")
    assert [r.name for r in A.in_natural_order(entries, filters.is_markup(F.col("name"))).orderBy("place").collect()] == ["2.xhtml", "p9.HTML", "p10.htm"]
    covers_of = A.cover_entries(entries.withColumn("data", F.lit(b"d")))
    assert {r.archive: (r.name, r.data) for r in covers_of.collect()} == {"a": ("x.png", b"d"), "b": (None, None)}
    books = spark.createDataFrame([("f/x/a.epub",), ("f/x/b.epub",), ("f/c.epub",)], "archive string")
    assert {r.folder: r.books for r in A.count_books(books, "folder").collect()} == {"f/x": 2, "f": 1}
    paths = spark.createDataFrame([("x/a.b.cbz",), ("x.y/a",), (None,)], "p string").select(A.cropped_path(F.col("p"))).collect()
    assert [r[0] for r in paths] == ["x/a.b.cropped.cbz", "x.y/a.cropped", None]
    assert spark.range(1).select(F.size(natural_key(F.lit("9" * 60 + "a")))).first()[0] == 2


def answer(**page):
    return {"query": {"pages": {"7": page}, "converted": [{"from": "甲", "to": "乙"}]}}


def test_wiki_answers(spark, tmp_path):
    rows = [("甲", answer(pageid=7, title="乙", revisions=[{"slots": {"main": {"*": "new"}}}], categories=[{"title": "Category:漫畫"}])), ("丙", answer(title="丙", missing="")), ("丁", answer(revisions=[{"*": "old"}])), ("戊", answer(title="戊")), ("己", {})]
    got = {r.asked: r for r in W.pages(spark.createDataFrame([(k, json.dumps(v)) for k, v in rows] + [("庚", None), ("辛", "no json")], "asked string, answer string"), "asked").collect()}
    assert set(got) == {"甲", "丁", "戊"}
    assert (got["甲"].wikitext, got["甲"].converted_title, got["甲"].categories, got["甲"].pageid) == ("new", "乙", ["漫畫"], 7)
    assert (got["丁"].wikitext, got["丁"].title, got["丁"].converted_title, got["丁"].pageid) == ("old", "丁", None, 0) and got["戊"].wikitext is None

    for name, files in {"one": {"05_wikitext.txt": "{{x}}\nline", "02_summary.json": json.dumps({"title": "s", "extract": "e", "content_urls": {"desktop": {"page": "u"}}, "wikibase_item": "Q1"}), "03_page_full.json": json.dumps(answer(title="p", pageid=5, extract=""), indent=1)}, "two": {"05_wikitext.txt": "t"}, "none": {"02_summary.json": "{}"}}.items():
        (tmp_path / name).mkdir()
        for file, value in files.items():
            (tmp_path / name / file).write_text(value)
    got = {r.folder.rsplit("/", 1)[1]: r for r in W.probes(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "two"} and got["one"].wikitext == "{{x}}\nline"
    assert tuple(got["one"])[2:] == ("p", 5, "u", "Q1", "e") and tuple(got["two"])[2:] == (None,) * 5
    record = W.cache_records(spark.createDataFrame([("n", "t", None)], "series string, title string, year int"), "series", 7).first().value
    assert json.loads(record) == {"schema_version": 7, "series_name": "n", "metadata": {"title": "t", "year": None}}
