"""Book archives (zip) as tables, and tables written back as archives.

Reading goes through Spark's binaryFile source, so any store that Spark reads will do, and files are dealt
out to tasks.  Entries are read in tasks; without data, only the archives' directories are.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import records
from quire.functions.text import natural_key
from quire.operators.filters import entry_rank, is_image
from quire.session import checkpoint, gather, spread
from quire.sources import archive_job

COVER_IMAGES = (".jpg", ".jpeg", ".png", ".webp")
ENTRIES = "archive string, idx int, name string, size long, data binary"
PLAN_INPUT = "archive string, old_hash string, length long, idx int, name string, size long"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def list_books(spark: SparkSession, folder: str, pattern: str = "*.epub", natural: bool = False) -> DataFrame:
    """Paths of the books of a folder, in plain order of names (SC7, SC9), or in natural order, as PDF files are taken (SC8)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    found = files.select(F.col("path").alias("archive"), "length")
    return found.orderBy(natural_key(F.regexp_extract("archive", "([^/]*)$", 1)), "archive") if natural else found.orderBy("archive")


def chosen_books(spark: SparkSession, paths: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(path, status) of paths that were named one by one: ok, `missing`, or `kind` for a file of another kind; anything but ok is exit code 2 (SC8).

    paths: one path a row, few enough to be named by hand; a null path is missing.
    """
    conf = spark._jsc.hadoopConfiguration()

    def there(path: str | None) -> bool:
        if not path:
            return False
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = file.getFileSystem(conf)
        return files.exists(file) and files.getFileStatus(file).isFile()

    rows = [(r.path, there(r.path)) for r in paths.select("path").collect()]
    found = spark.createDataFrame(rows, "path string, there boolean")
    return found.select("path", F.when(~F.col("there"), "missing").when(~F.lower("path").endswith(suffix), "kind").otherwise("ok").alias("status"))


def count_books(books: DataFrame, folder: str) -> DataFrame:
    """(folder, books) for each folder of list_books() that has any; a folder without books has no row, so a left join gives null (SC14)."""
    return books.groupBy(F.regexp_replace("archive", "/[^/]*$", "").alias(folder)).agg(F.count("*").alias("books"))


def in_natural_order(entries: DataFrame, wanted, group: str = "archive", name: str = "name") -> DataFrame:
    """The wanted entries, with `place` (from 1) in natural order of their paths in each archive (SC5 by is_markup, SC6 by is_image).

    An archive's entries are ordered among themselves only, so no task sorts more than one archive.
    """
    order = Window.partitionBy(group).orderBy(natural_key(F.col(name), letters_first=False), F.col(name))
    return entries.where(wanted).withColumn("place", F.row_number().over(order))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, relative, length) of the picture files below a folder, in order of their relative paths (SC10)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    pictures = files.where(is_image(F.col("path")))
    return pictures.withColumn("relative", F.substring_index("path", root, -1)).orderBy("relative")


def smallest(images: DataFrame, most: int = 10, size: str = "length", path: str = "path") -> DataFrame:
    """The smallest files, a report of `most` rows (SC28)."""
    return images.orderBy(size, path).limit(most)


def read_entries(spark: SparkSession, path: str, pattern: str = "*", with_data: bool = True) -> DataFrame:
    """The entries of all archives below a path (SC1, SC11-SC13). A name that leaves the archive is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def rows(batch):
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield from _entries(archive, content, with_data)

    return gather(files).mapInArrow(lambda batches: _entry_batches((row for batch in batches for row in rows(batch)), ENTRIES), ENTRIES)


def read_plan_input(spark: SparkSession, root: str, pattern: str = "*.cbz") -> tuple[DataFrame, DataFrame]:
    """(archives, entries) that a plan of archive_job is made from, as its snapshot() and read_entries() without data give them.

    Each archive is listed and read once and both tables are stored, as a plan asks for them several times.  Archives go by
    their paths relative to the folder.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    files = files.select(archive_job.relative(spark, root, F.col("path")).alias("archive"), F.sha2("content", 256).alias("old_hash"), "length", "content").where(~archive_job.own_file(F.col("archive")))

    def rows(batch):
        for archive, old_hash, length, content in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
            yield archive, old_hash, length, None, None, None
            for _, idx, name, size, _ in _entries(archive, content, False):
                yield archive, None, None, idx, name, size

    found = gather(files).mapInArrow(lambda batches: _entry_batches((row for batch in batches for row in rows(batch)), PLAN_INPUT), PLAN_INPUT)
    found = checkpoint(spread(found, "archive"))
    return found.where("old_hash is not null").select("archive", "old_hash", "length"), found.where("idx is not null").select("archive", "idx", "name", "size")


def _entries(archive: str, content: pa.BinaryScalar, with_data: bool) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
        for idx, info in enumerate(z.infolist()):
            plain = posixpath.normpath(info.filename.replace("\\", "/"))
            if plain.startswith(("../", "/")) or plain == "..":
                raise ValueError(f"{archive}: entry outside of the archive: {info.filename}")
            if not info.is_dir():
                yield archive, idx, info.filename, info.file_size, z.read(info) if with_data else None


def _entry_batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of all archives of a task in batches of 4,096, or fewer where their data come to some MB."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= 4096 or size >= 4 << 20:
            yield _entry_batch(held, names, kinds)
            held, size = [], 0
    if held:
        yield _entry_batch(held, names, kinds)


def _entry_batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def count_images(entries: DataFrame) -> DataFrame:
    return entries.groupBy("archive").agg(F.count_if(is_image(F.col("name"))).alias("pages"))


def metadata_entry(entries: DataFrame) -> DataFrame:
    """The metadata entry of each archive that has one, by preference of its name (FI7, SC12)."""
    ranked = entries.withColumn("__rank", entry_rank(F.col("name"))).where(F.col("__rank").isNotNull())
    return ranked.groupBy("archive").agg(F.min_by(F.struct("name", "data"), F.struct("__rank", "idx")).alias("m")).select("archive", "m.name", "m.data")


def read_records(entries: DataFrame) -> DataFrame:
    """The record of each archive that has one, from the entry that readers prefer, beside its archive (SC11)."""
    return records.from_xml(metadata_entry(entries).select("archive", F.col("data").cast("string").alias("xml")))


def cover_entries(entries: DataFrame) -> DataFrame:
    """The first picture by name of each archive, null where it has none: what tells whether an existing file's cover is blank (FI13)."""
    picture = F.when(is_image(F.col("name"), COVER_IMAGES), F.struct("name", "data"))
    return entries.groupBy("archive").agg(F.min_by(picture, F.when(is_image(F.col("name"), COVER_IMAGES), F.col("name"))).alias("c")).select("archive", "c.name", "c.data")


def cropped_path(path: Column) -> Column:
    """The file that a cropped archive is written to (HP18)."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(".cropped"), F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)$", 1))


def repair_targets(archives: DataFrame) -> DataFrame:
    """archives (cbz, dir, base, title, title_from_dir) with the folder they are repaired in and the series title asked for (HP11, HP14)."""
    parent = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    folder = F.coalesce(parent(F.col("cbz")), F.col("dir"), F.col("base"))
    from_dir = F.coalesce("title_from_dir", F.col("cbz").isNull())
    title = F.when(F.col("title") != "", F.col("title")).when(from_dir, F.regexp_extract(folder, "([^/]*)$", 1))
    return archives.withColumns({"target_dir": folder, "series_title": title})


def write_archives(pages: DataFrame, folder: str, backup: str | None = None) -> DataFrame:
    """Write each book's pages (book, page_no, name, data, xml) as `folder`/book.cbz, and return (book, pages, bytes, path).

    Pages are stored as they are under %04d names, the first metadata record is deflated (SK1, SK2).  The files are written
    now, by the sink of archive_job: all books or, where one can't be written, none.  A book's name is a file name; one with a
    folder in it is an error.  backup: None, "keep" (an old backup stays) or "error" (SK6, SK7).
    """
    book = archive_job.safe_name(F.col("book"), nested=False)
    named = pages.withColumn("target", F.when(book.endswith(".cbz"), book).otherwise(F.concat(book, F.lit(".cbz"))))
    page = named.select("target", F.col("page_no").cast("int").alias("place"), F.lit("page").alias("op"), "name", "data", F.lit(True).alias("stored"))
    record = named.where(F.col("xml") != "").groupBy("target").agg(F.min_by("xml", "page_no").cast("binary").alias("data"))
    record = record.select("target", F.lit(archive_job.LAST).alias("place"), F.lit("put").alias("op"), F.lit(archive_job.RECORD).alias("name"), "data", F.lit(False).alias("stored"))
    rows = page.unionByName(record).withColumns({"source": F.lit(None).cast("string"), "old_hash": F.lit(None).cast("string")})
    done = archive_job.commit(rows, folder, backup, strict=True)
    return done.select(F.regexp_replace("target", r"\.cbz$", "").alias("book"), "pages", "bytes", F.concat(F.lit(f"{folder.rstrip('/')}/"), "target").alias("path"))


def replace_metadata(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries with their archive's root metadata record (archive, xml) replaced or added, the rest verbatim (SK2, SK5)."""
    others = entries.join(records.select("archive"), "archive", "left_semi").where(~(F.coalesce(entry_rank(F.col("name")), F.lit(9)) < 2))
    added = records.select("archive", F.lit(1 << 30).alias("idx"), F.lit("ComicInfo.xml").alias("name"), F.length("xml").cast("long").alias("size"), F.col("xml").cast("binary").alias("data"))
    untouched = entries.join(records.select("archive"), "archive", "left_anti")
    return others.unionByName(added).unionByName(untouched)


def planned_repairs(archives: DataFrame) -> DataFrame:
    """What a repair does to each archive (garbage_pages, rotated_pages, metadata_changed): rebuild, metadata_only or nothing (SK5)."""
    rebuild = (F.col("garbage_pages") > 0) | (F.col("rotated_pages") > 0)
    return archives.withColumn("action", F.when(rebuild, "rebuild").when(F.col("metadata_changed"), "metadata_only").otherwise("nothing"))


def unique_names(entries: DataFrame) -> DataFrame:
    """Archives whose entry names, but for case, aren't unique (SE5)."""
    return entries.groupBy("archive").agg(F.count("*").alias("n"), F.countDistinct(F.lower("name")).alias("names")).where("n <> names").select("archive")
