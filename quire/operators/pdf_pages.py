"""What becomes of each page of a PDF file, from a table of page geometry that any PDF reader can write.

`pdf_pages` has, for each page: pdf, page_no, width, height (points), rotation (degrees), annotated (annotations or
form fields), images (array of structs: xref, has_mask, bbox and transform as arrays of doubles, width, height, ext)
and display (array of structs: kind, bbox).  Decisions are columns; a document's size is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.operators.filters import same_rectangle

# Least and greatest DPI of a rendered page.
LEAST_DPI, MOST_DPI = 36, 300


def _fills(bbox: Column, width: Column, height: Column) -> Column:
    return same_rectangle([bbox[i] for i in range(4)], [F.lit(0.0), F.lit(0.0), width, height])


def _upright(t: Column) -> Column:
    """Neither mirrored nor turned or sheared."""
    return F.coalesce((t[0] > 0) & (t[3] > 0) & (F.abs(t[1]) <= 0.1) & (F.abs(t[2]) <= 0.1), F.lit(False))


def lossless(p: DataFrame) -> Column:
    """The page is one JPEG that fills it and nothing else, so its bytes are the page (CO1)."""
    image, shown = F.get(p["images"], F.lit(0)), F.get(p["display"], F.lit(0))
    whole = _fills(image["bbox"], p["width"], p["height"]) & _upright(image["transform"]) & (image["xref"] > 0) & ~F.coalesce(image["has_mask"], F.lit(False))
    alone = (F.size("images") == 1) & (F.size("display") == 1) & (shown["kind"] == "fill-image") & _fills(shown["bbox"], p["width"], p["height"])
    plain = (p["rotation"] == 0) & ~p["annotated"]
    return F.coalesce(plain & alone & whole & F.lower(image["ext"]).isin("jpg", "jpeg"), F.lit(False))


def scan_sizes(p: DataFrame) -> Column:
    """Width and height of the upright pictures that fill the page (CO2)."""
    fits = lambda i: (i["width"] > 0) & (i["height"] > 0) & _fills(i["bbox"], p["width"], p["height"]) & _upright(i["transform"])
    return F.transform(F.filter(p["images"], fits), lambda i: F.struct(i["width"].alias("width"), i["height"].alias("height")))


def render_dpi(width: Column, height: Column, scans: Column, long_edge: Column, most: int = MOST_DPI) -> Column:
    """The resolution a page is rendered at: the document's long edge, but no more than its own scan has (SR19)."""
    whole = lambda x: F.bround(x).cast("int")
    target = F.greatest(F.lit(LEAST_DPI), F.least(F.lit(most), whole(long_edge * 72.0 / F.greatest(width, height, F.lit(1.0)))))
    own = F.transform(scans, lambda s: whole(F.greatest(s["width"] * 72.0 / F.greatest(width, F.lit(1.0)), s["height"] * 72.0 / F.greatest(height, F.lit(1.0)))))
    usable = F.get(F.filter(own, lambda d: d.between(LEAST_DPI, most)), F.lit(0))
    return F.least(target, usable)


def planned(pages: DataFrame) -> DataFrame:
    """pages with lossless, scans, long_edge and dpi; dpi is null where the page's own bytes are taken (CO1, CO2, AG5, SR19, SC27).

    One window over each document gives the number of its pages and the long edges of the sampled ones, which are a few
    dozen at most; pages count from 1 without gaps.
    """
    whole = Window.partitionBy("pdf")
    rows = pages.withColumns({"lossless": lossless(pages), "scans": scan_sizes(pages), "__n": F.max("page_no").over(whole)})
    edges = F.filter(F.transform("scans", lambda s: F.greatest(s["width"], s["height"])), lambda e: e >= K.RENDER_LOW)
    rows = rows.withColumn("__edges", F.sort_array(F.flatten(F.collect_list(F.when(_sampled(), edges)).over(whole))))
    n = F.size("__edges")
    middle = (F.get("__edges", F.floor((n - 1) / 2).cast("int")) + F.get("__edges", F.floor(n / 2).cast("int"))) / 2
    long_edge = F.when(n > 0, F.least(F.bround(middle).cast("int"), F.lit(int(K.RENDER_HIGH)))).otherwise(int(K.RENDER_DEFAULT))
    rows = rows.withColumn("long_edge", long_edge).drop("__n", "__edges")
    return rows.withColumn("dpi", F.when(~F.col("lossless"), render_dpi(F.col("width"), F.col("height"), F.col("scans"), F.col("long_edge"))))


def _sampled(most: int = K.RENDER_SAMPLE) -> Column:
    """Whether a page is one of `most` evenly spaced ones of its document."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (F.bround(i * (F.col("__n") - 1) / (most - 1)) + 1).cast("int"))
    return (F.col("__n") <= most) | F.array_contains(spaced, F.col("page_no").cast("int"))


def recovered(rows: DataFrame) -> DataFrame:
    """Which rendering of a page stands: the first that isn't blank, else the last renderer's, which is trusted if it gave a file (CO3-CO5).

    rows: planned pages with `blank` (the first renderer's picture is nearly white), `second` (the second renderer gave a
    picture that isn't) and `third` (the third gave one at all).  strategy is lossless, first, second, third or failed.
    """
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.withColumn("strategy", F.when(F.col("lossless"), "lossless").when(~ok("blank"), "first").when(ok("second"), "second").when(ok("third"), "third").otherwise("failed"))


def outcomes(rows: DataFrame) -> DataFrame:
    """For each document, pages by strategy and the first page that no renderer could recover, which fails the document (CO5, AG12)."""
    n = {s: F.count_if(F.col("strategy") == s).alias(s) for s in ("lossless", "first", "second", "third")}
    failed = F.min(F.when(F.col("strategy") == "failed", F.col("page_no"))).alias("failed_page")
    return rows.groupBy("pdf").agg(*n.values(), failed).withColumn("ok", F.col("failed_page").isNull())
