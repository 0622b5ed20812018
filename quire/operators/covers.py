"""The pictures of a book in reading order: near-duplicate covers go, one cover in colour stays, then the other pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.dedupe import greedy_leaders

COVER_PLACES, ALIKE = 4, 0.95


def cover_section(pictures: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(book, path, section, place): section 0 are the covers that stay, 1 the other pictures; order by section and place (WI8, SE3, WI4).

    pictures: book, spine (from 0, pages that were skipped count), place (unique in a book, in reading order), path,
    histogram, protected (text and catalogue pages) and colour.  Pictures of the first four places are covers: the first
    always stays, and so do protected ones, which are not compared.  If no cover that stays is in colour, the first one in
    colour is put after them.  A book without covers has its other pictures only.
    """
    covers = pictures.where(F.col("spine") < COVER_PLACES)
    first = covers.groupBy("book").agg(F.min("place").alias("__first"))
    # the first picture is compared with, whatever it shows
    marked = covers.join(first, "book").withColumn("__safe", F.coalesce("protected", F.lit(False)) & (F.col("place") != F.col("__first")))
    judged = greedy_leaders(marked.select("book", "place", "path", "histogram", "colour", "__safe"), "book", "place", "histogram", alike, "__safe")
    # a book's covers, which are those of four places, in one row: those that stay, and the spare one
    one = F.struct("place", "path", F.coalesce("kept", F.lit(False)).alias("kept"), F.coalesce("colour", F.lit(False)).alias("colour"))
    books = judged.groupBy("book").agg(F.array_sort(F.collect_list(one)).alias("all"))
    stay = F.transform(F.filter("all", lambda x: x["kept"]), lambda x: F.struct(x["place"].cast("int").alias("place"), x["path"].alias("path")))
    colours = F.filter("all", lambda x: x["colour"])
    spare = F.struct((F.element_at("all", -1)["place"] + 1).cast("int").alias("place"), F.get(colours, F.lit(0))["path"].alias("path"))
    shown = F.when(~F.exists("all", lambda x: x["kept"] & x["colour"]) & (F.size(colours) > 0), F.concat(stay, F.array(spare))).otherwise(stay)
    covers_left = books.select("book", F.explode(shown).alias("c")).select("book", "c.path", F.lit(0).alias("section"), "c.place")
    rest = pictures.where(F.col("spine") >= COVER_PLACES).select("book", "path", F.lit(1).alias("section"), "place")
    return covers_left.unionByName(rest)
