"""Archives written as one job: tasks stage whole archives beside the old ones, and the driver commits or aborts once for all.

Changes are rows, one for each entry that is put in or dropped; entries that no row names are copied from the source in
their order, with their dates, attributes, kind of compression and the archive's comment, so unchanged pages don't travel.
Rows are dealt out by archive, to a stated number of tasks, and sorted by place, and a task merges them with the source's
entries as both stream by: it holds one entry's row at a time, and an archive of a few MB, which is read at once.

Compare and swap: a change carries the content hash that its plan was made from.  The task that stages an archive hashes the
source again and leaves the archive alone if it differs; the driver, which must not read all archives, compares size and
time of the file with those the task saw, and hashes only files where they differ.  A stale archive is an outcome of its own
and keeps others from nothing.

Staged files lie in one folder of the job, which commit and abort remove, and have names of their own, so a task that runs
twice leaves one archive.  An archive is replaced by a rename.  If the driver is lost in between, some archives are
new and the others old, none is half written, and the job can be planned again: changes that are done are no changes any more.

Defined cases: a target that isn't below the root is an error before anything is written; a table without rows
writes nothing; entries of one place are taken in order of their names; an archive whose entry names aren't unique, or
that can't be read, has the outcome `failed` with a reason.
"""

from __future__ import annotations

import contextlib
import copy
import hashlib
import io
import json
import posixpath
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quire.functions.constants import PAGE_IMAGES
from quire.operators.filters import entry_rank, is_image
from quire.session import spread

RECORD = "ComicInfo.xml"
LAST = 1 << 30
CHANGES = "source string, target string, old_hash string, place int, op string, name string, data binary, stored boolean"
OUTCOMES = "source string, target string, outcome string, reason string, entries int, pages int, bytes long, new_hash string"
_CHUNK = 1 << 20
_WHOLE = 4 << 20  # archives up to this size are read at once
_SOME = 256  # archives that a thread of the driver takes at a time


def safe_name(name: Column, nested: bool = True) -> Column:
    """The name of a file below a folder, or an error: not empty, no absolute path, no step upwards and no backslash; without `nested` no folder either."""
    bad = name.isNull() | F.contains(name, F.lit("\\")) | name.rlike(r"(^|/)\.{0,2}(/|\z)") | (F.contains(name, F.lit("/")) if not nested else F.lit(False))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a name below the folder: "), F.coalesce(name, F.lit("null")))).cast("string")).otherwise(name)


# --- plans -------------------------------------------------------------------


def snapshot(spark: SparkSession, root: str, pattern: str = "*.cbz") -> DataFrame:
    """(archive, old_hash, length): the archives below a folder, by their paths relative to it, and what they hold just now."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(relative(spark, root, F.col("path")).alias("archive"), F.sha2("content", 256).alias("old_hash"), "length").where(~own_file(F.col("archive")))


def own_file(archive: Column) -> Column:
    """A file that a job keeps for itself below the root."""
    return archive.rlike(r"(^|/)\.quire-")


def relative(spark: SparkSession, root: str, path: Column) -> Column:
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    return F.substring_index(path, full, -1)


def record_edits(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Edits that give each archive of `records` (archive, xml) its root metadata record: in the place of the one it has, else at the end (SK2, SK8).

    entries: (archive, idx, name).  Of several root records the one that readers prefer is replaced, and the others go.
    """
    rank = entry_rank(F.col("name"))
    roots = entries.select("archive", "idx", "name", rank.alias("__rank")).where(F.col("__rank") < 2)
    best = roots.groupBy("archive").agg(F.min(F.struct("__rank", "idx")).alias("__best"))
    put = records.join(best, "archive", "left").select("archive", F.coalesce("__best.idx", F.lit(LAST)).alias("place"), F.lit("put").alias("op"), F.lit(RECORD).alias("name"), F.col("xml").cast("binary").alias("data"))
    spare = roots.join(records.select("archive"), "archive", "left_semi").join(best, "archive").where(F.col("idx") != F.col("__best.idx"))
    return put.unionByName(spare.select("archive", F.col("idx").alias("place"), F.lit("drop").alias("op"), "name", F.lit(None).cast("binary").alias("data")))


def page_edits(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Edits that put new bytes in the place of pages: pages (archive, name, data), a null `data` drops the page (SK3, SK5)."""
    found = pages.join(entries.select("archive", "name", F.col("idx").alias("place")), ["archive", "name"])
    return found.select("archive", "place", F.when(F.col("data").isNull(), "drop").otherwise("put").alias("op"), "name", "data")


def planned(archives: DataFrame, edits: DataFrame, target: Column | None = None) -> DataFrame:
    """Changes as the sink takes them: edits with the hash of their archive."""
    rows = edits.join(archives.select("archive", "old_hash"), "archive")
    return rows.select(F.col("archive").alias("source"), (F.col("archive") if target is None else target).alias("target"), "old_hash", F.col("place").cast("int").alias("place"), "op", "name", "data", is_image(F.col("name")).alias("stored"))


def summary(changes: DataFrame) -> DataFrame:
    """What a plan does to each archive: (source, target, old_hash, action, changed_pages, dropped) (SK5, AG7); a dry run ends here."""
    page = is_image(F.col("name"))
    counts = changes.groupBy("source", "target", "old_hash").agg(F.count_if((F.col("op") == "put") & page).alias("changed_pages"), F.count_if((F.col("op") == "drop") & page).alias("dropped"))
    return counts.withColumn("action", F.when(F.col("changed_pages") + F.col("dropped") > 0, "rebuild").otherwise("metadata_only"))


def effective_write(write: Column, dry_run: Column, explicit: Column) -> Column:
    """Whether a run writes: never on a dry run, when asked to, or when no target was named (HP12)."""
    return ~dry_run & (write | ~explicit)


# --- the sink ----------------------------------------------------------------


def commit(changes: DataFrame, root: str, backup: str | None = None, force: bool = False, strict: bool = False, sink: type | None = None) -> DataFrame:
    """Write the planned archives below `root` and return their outcomes: written, stale, exists, backed_up or failed.

    backup: None, "keep" (an old backup stays) or "error" (it keeps the archive from being written) (SK6, SK7).
    A target other than its source that is there already has the outcome `exists`, unless `force` is set (SK3).
    With `strict` one such outcome aborts the job, and nothing is written.
    """
    spark = changes.sparkSession
    sink = sink or ArchiveSink
    spark.dataSource.register(sink)
    job = uuid.uuid4().hex
    rows = changes.withColumn("target", safe_name(F.col("target"))).select(*[c.split()[0] for c in CHANGES.split(", ")])
    rows = spread(rows, "target").sortWithinPartitions("target", "place", "name")
    options = {"job": job, "backup": backup or "", "force": str(force), "strict": str(strict)}
    rows.write.format(sink.name()).mode("append").options(**options).save(root)
    return spark.read.schema(OUTCOMES).json(f"{root.rstrip('/')}/.quire-log/{job}.json")


@dataclass(slots=True)
class Staged:
    source: str | None
    target: str
    old_hash: str | None
    outcome: str = "staged"
    reason: str | None = None
    entries: int = 0
    pages: int = 0
    bytes: int = 0
    new_hash: str | None = None
    part: str | None = None
    seen: tuple | None = None  # size and time of the source when it was hashed


@dataclass
class StagedArchives(WriterCommitMessage):
    items: list[Staged] = field(default_factory=list)


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_archives"

    def writer(self, schema, overwrite: bool) -> "ArchiveWriter":
        return ArchiveWriter(dict(self.options))


class ArchiveWriter(DataSourceArrowWriter):
    """Runs in tasks (write) and on the driver (commit, abort); both reach the root through the same file system."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.stage = f".quire-{self.options['job']}"

    def _files(self):
        """The file system of the root, and the root's path on it."""
        from pyarrow import fs

        root = self.options["path"].rstrip("/")
        if not re.match(r"[a-z][a-z0-9+.-]*:", root):
            return fs.LocalFileSystem(), root
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))

    # tasks

    def write(self, iterator: Iterator[pa.RecordBatch]) -> StagedArchives:
        files, root = self._files()
        files.create_dir(f"{root}/{self.stage}", recursive=True)
        done = StagedArchives()
        rows = (row for batch in iterator for row in _rows(batch))
        for (source, target, old_hash), group in groupby(rows, lambda r: (r["source"], r["target"], r["old_hash"])):
            done.items.append(self._stage(files, root, Staged(source, target, old_hash), group))
            for _ in group:  # what an archive that is left alone didn't read
                pass
        return done

    def _stage(self, files, root: str, item: Staged, rows: Iterator[dict]) -> Staged:
        part = f"{root}/{self.stage}/{uuid.uuid4().hex}.part"
        try:
            if item.source is not None:
                item.seen = _seen(files, f"{root}/{item.source}")
                old, found = _opened(files, f"{root}/{item.source}", item.seen)
                if found != item.old_hash:
                    old.close()
                    item.outcome = "stale"
                    return item
            with _sink_file(files, part) as raw, zipfile.ZipFile(raw, "w") as out:
                if item.source is None:
                    item.entries, item.pages = _written(out, [], None, rows)
                else:
                    with old, zipfile.ZipFile(old) as archive:
                        names = archive.namelist()
                        if len(set(names)) < len(names):
                            raise zipfile.BadZipFile("entry names are not unique")
                        item.entries, item.pages = _written(out, archive.infolist(), archive, rows)
                        out.comment = archive.comment
            written = _seen(files, part)
            new, item.new_hash = _opened(files, part, written)
            with new, zipfile.ZipFile(new) as archive:
                if (bad := _damaged(archive)) is not None:
                    raise zipfile.BadZipFile(f"entry {bad} is damaged")
        except (zipfile.BadZipFile, FileNotFoundError, KeyError, NotImplementedError) as error:
            item.outcome, item.reason, item.new_hash = "failed", str(error), None
            return item
        item.part, item.bytes = part, written[0]
        return item

    # driver

    def commit(self, messages: list[StagedArchives | None]) -> None:
        files, root = self._files()
        items = [i for m in messages if m is not None for i in m.items]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda some: self._check(files, root, some), _parts(items)))
            refused = [i for i in items if i.outcome != "staged"]
            if refused and self.options["strict"] == "True":
                raise FileExistsError(f"nothing was written: {refused[0].target}: {refused[0].outcome} {refused[0].reason or ''}")
            list(pool.map(lambda some: self._replace(files, root, some), _parts([i for i in items if i.outcome == "staged"])))
        files.create_dir(f"{root}/.quire-log", recursive=True)
        kept = [c.split()[0] for c in OUTCOMES.split(", ")]
        with files.open_output_stream(f"{root}/.quire-log/{self.options['job']}.json") as log:
            for item in items:
                log.write((json.dumps({k: getattr(item, k) for k in kept}, ensure_ascii=False) + "\n").encode())
        self._clear(files, root)

    def _check(self, files, root: str, some: list[Staged]) -> None:
        """Whether staged archives may take their targets' places."""
        some = [i for i in some if i.outcome == "staged"]
        paths = list({f"{root}/{name}" for i in some for name in (i.source, i.target) if name is not None})
        seen = dict(zip(paths, map(_of_file, files.get_file_info(paths)), strict=True))
        for item in some:
            target = f"{root}/{item.target}"
            there = seen[target] is not None
            if item.source is not None:
                now = seen[f"{root}/{item.source}"]
                if now is None or now != item.seen and _hash(files, f"{root}/{item.source}") != item.old_hash:
                    item.outcome = "stale"
                    continue
            if item.source is not None and item.source != item.target and there and self.options["force"] != "True":
                item.outcome = "exists"
            elif there and self.options["backup"] == "error" and _seen(files, f"{target}.bak") is not None:
                item.outcome, item.reason = "backed_up", f"there is a backup already: {item.target}.bak"

    def _replace(self, files, root: str, some: list[Staged]) -> None:
        for item in some:
            target = f"{root}/{item.target}"
            if "/" in item.target:
                files.create_dir(posixpath.dirname(target), recursive=True)
            if self.options["backup"] and _seen(files, target) is not None and _seen(files, f"{target}.bak") is None:
                files.copy_file(target, f"{target}.bak")
            files.move(item.part, target)
            item.outcome = "written"

    def abort(self, messages: list[StagedArchives | None]) -> None:
        self._clear(*self._files())

    def _clear(self, files, root: str) -> None:
        if _seen(files, f"{root}/{self.stage}") is not None:
            files.delete_dir(f"{root}/{self.stage}")


@contextlib.contextmanager
def _sink_file(files, path: str):
    """A file that zipfile writes; only a local one can go back to an entry's head, elsewhere sizes follow the data."""
    from pyarrow import fs

    if isinstance(files, fs.LocalFileSystem):
        file = _Held(path)
        try:
            yield file
        finally:
            file.close()
    else:
        with files.open_output_stream(path) as raw:
            yield _Forward(raw)


class _Held:
    """A local file that is written at once when it's closed, as going back to each entry's head would write entry by entry; a large one lies on disk."""

    def __init__(self, path: str):
        self.path, self.file = path, io.BytesIO()

    def write(self, data) -> int:
        if isinstance(self.file, io.BytesIO) and self.file.tell() + len(data) > _WHOLE:
            self.file = self._stored()
        return self.file.write(data)

    def seek(self, *where) -> int:
        return self.file.seek(*where)

    def tell(self) -> int:
        return self.file.tell()

    def flush(self) -> None:
        self.file.flush()

    def _stored(self):
        file, at = open(self.path, "wb"), self.file.tell()
        file.write(self.file.getbuffer())
        file.seek(at)
        return file

    def close(self) -> None:
        if isinstance(self.file, io.BytesIO):
            self.file = self._stored()
        self.file.close()


class _Forward:
    """A stream that is written from front to end."""

    def __init__(self, raw):
        self.raw = raw

    def write(self, data) -> int:
        self.raw.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        self.raw.flush()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, so that only its own data become a Python object."""
    names = batch.schema.names
    columns = [(value.as_py() for value in column) if name == "data" else column.to_pylist() for name, column in zip(names, batch.columns, strict=True)]
    for row in zip(*columns, strict=True):
        yield dict(zip(names, row, strict=True))


def _written(out: zipfile.ZipFile, old: list[zipfile.ZipInfo], archive: zipfile.ZipFile | None, rows: Iterator[dict]) -> tuple[int, int]:
    """Merge the old entries and the rows by place; returns how many entries and how many pages are written."""
    pages = 0
    row = next(rows, None)

    def put(r: dict, like: zipfile.ZipInfo | None) -> None:
        nonlocal pages
        name = r["name"]
        if r["op"] == "page":
            pages += 1
            name = f"{pages:04d}{posixpath.splitext(name)[1].lower()}"
        if like is None or like.filename != name:
            info = zipfile.ZipInfo(name) if like is None else zipfile.ZipInfo(name, like.date_time)
        else:
            info = copy.copy(like)
        out.writestr(info, r["data"] if r["data"] is not None else b"", zipfile.ZIP_STORED if r["stored"] else zipfile.ZIP_DEFLATED)

    for place, info in enumerate(old):
        replaced = False
        while row is not None and row["place"] <= place:
            if row["place"] == place:
                replaced = True
                if row["op"] == "put":
                    put(row, info)
            row = next(rows, None)
        if not replaced:
            with archive.open(info) as source, out.open(copy.copy(info), "w") as target:
                shutil.copyfileobj(source, target, _CHUNK)
    while row is not None:
        if row["op"] in ("put", "page"):
            put(row, None)
        row = next(rows, None)
    names = out.namelist()
    return len(names), pages or sum(n.lower().endswith(PAGE_IMAGES) for n in names)


def _damaged(archive: zipfile.ZipFile) -> str | None:
    """The first entry that can't be read back, as testzip() has it; a small one is read in one go."""
    for info in archive.infolist():
        try:
            if info.file_size <= _CHUNK:
                archive.read(info)
            else:
                with archive.open(info) as entry:
                    while entry.read(_CHUNK):
                        pass
        except zipfile.BadZipFile:
            return info.filename
    return None


def _parts(items: list[Staged]) -> list[list[Staged]]:
    return [items[k : k + _SOME] for k in range(0, len(items), _SOME)]


def _of_file(info) -> tuple | None:
    return None if info.type.name == "NotFound" else (info.size, info.mtime_ns)


def _seen(files, path: str) -> tuple | None:
    return _of_file(files.get_file_info(path))


def _opened(files, path: str, seen: tuple | None):
    """A file to read from, and its hash: a small one is read once for both, a large one is hashed as a stream before."""
    if seen is None or seen[0] is None or seen[0] > _WHOLE:
        digest = _hash(files, path)
        return files.open_input_file(path), digest
    with files.open_input_file(path) as file:
        data = file.read()
    return io.BytesIO(data), hashlib.sha256(data).hexdigest()


def _hash(files, path: str) -> str:
    digest = hashlib.sha256()
    with files.open_input_stream(path) as stream:
        while data := stream.read(_CHUNK):
            digest.update(data)
    return digest.hexdigest()
