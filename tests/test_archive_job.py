"""The archive job: plans, staging, compare-and-swap, commit and abort."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import archive_job as J
from quire.sources import archives as A


def _book(path, extra=(), comment=b"a comment"):
    with zipfile.ZipFile(path, "w") as z:
        z.comment = comment
        for name, data, kind in [("b/1.jpg", b"one", zipfile.ZIP_STORED), ("notes.txt", b"text " * 500, zipfile.ZIP_DEFLATED), ("a/2.PNG", b"two", zipfile.ZIP_DEFLATED), *extra]:
            info = zipfile.ZipInfo(name, (1999, 1, 2, 3, 4, 6))
            info.external_attr = 0o640 << 16
            z.writestr(info, data, kind)


def _entries(path):
    with zipfile.ZipFile(path) as z:
        return [(i.filename, z.read(i)) for i in z.infolist()]


def _world(spark, root):
    return J.snapshot(spark, str(root)), A.read_entries(spark, str(root), "*.cbz", with_data=False).withColumn("archive", J.relative(spark, str(root), F.col("archive")))


def test_pages_and_record_change_and_all_else_stays(spark, tmp_path):
    _book(tmp_path / "x.cbz", [("comicinfo.xml", b"<old/>", zipfile.ZIP_DEFLATED), ("ComicInfo.xml", b"<root/>", zipfile.ZIP_DEFLATED)])
    _book(tmp_path / "y.cbz")
    _book(tmp_path / "z.cbz")
    before = {n: (tmp_path / n).read_bytes() for n in ("y.cbz", "z.cbz")}
    archives, entries = _world(spark, tmp_path)
    pages = spark.createDataFrame([("x.cbz", "b/1.jpg", bytearray(b"cropped")), ("x.cbz", "none.jpg", bytearray(b"-"))], "archive string, name string, data binary")
    records = spark.createDataFrame([("x.cbz", "<new/>"), ("y.cbz", "<new/>")], "archive string, xml string")
    edits = J.page_edits(entries, pages).unionByName(J.record_edits(entries, records))
    plan = J.planned(archives, edits)
    assert {(r.source, r.action, r.changed_pages, r.dropped) for r in J.summary(plan).collect()} == {("x.cbz", "rebuild", 1, 0), ("y.cbz", "metadata_only", 0, 0)}
    assert {n: (tmp_path / n).read_bytes() for n in before} == before  # a plan writes nothing
    done = {r.target: r for r in J.commit(plan, str(tmp_path), backup="keep").collect()}
    assert {k: (r.outcome, r.entries, r.pages) for k, r in done.items()} == {"x.cbz": ("written", 4, 2), "y.cbz": ("written", 4, 2)}
    assert _entries(tmp_path / "x.cbz") == [("b/1.jpg", b"cropped"), ("notes.txt", b"text " * 500), ("a/2.PNG", b"two"), ("ComicInfo.xml", b"<new/>")]
    assert _entries(tmp_path / "y.cbz")[-1] == ("ComicInfo.xml", b"<new/>")
    with zipfile.ZipFile(tmp_path / "x.cbz") as z:
        assert z.comment == b"a comment"
        info = z.getinfo("notes.txt")
        assert (info.date_time, info.external_attr >> 16, info.compress_type) == ((1999, 1, 2, 3, 4, 6), 0o640, zipfile.ZIP_DEFLATED)
    assert (tmp_path / "z.cbz").read_bytes() == before["z.cbz"] and (tmp_path / "y.cbz.bak").read_bytes() == before["y.cbz"]
    assert sorted(p for p in os.listdir(tmp_path) if p.startswith(".quire")) == [".quire-log"]
    assert J.snapshot(spark, str(tmp_path)).where("archive = 'x.cbz'").first().old_hash == done["x.cbz"].new_hash


def test_dropped_pages_and_new_targets(spark, tmp_path):
    _book(tmp_path / "x.cbz")
    archives, entries = _world(spark, tmp_path)
    pages = spark.createDataFrame([("x.cbz", "a/2.PNG", None)], "archive string, name string, data binary")
    plan = J.planned(archives, J.page_edits(entries, pages), A.cropped_path(F.col("archive")))
    old = (tmp_path / "x.cbz").read_bytes()
    assert J.commit(plan, str(tmp_path)).first().outcome == "written"
    assert [n for n, _ in _entries(tmp_path / "x.cropped.cbz")] == ["b/1.jpg", "notes.txt"] and (tmp_path / "x.cbz").read_bytes() == old
    assert J.commit(plan, str(tmp_path)).first().outcome == "exists"
    assert J.commit(plan, str(tmp_path), force=True).first().outcome == "written"


def test_a_stale_or_broken_archive_fails_alone(spark, tmp_path):
    for name in ("a.cbz", "b.cbz", "c.cbz", "d.cbz"):
        _book(tmp_path / name)
    archives, entries = _world(spark, tmp_path)
    records = spark.createDataFrame([(f"{n}.cbz", "<new/>") for n in "abcd"], "archive string, xml string")
    plan = spark.createDataFrame(J.planned(archives, J.record_edits(entries, records)).collect(), J.CHANGES)
    _book(tmp_path / "b.cbz", comment=b"changed meanwhile")
    (tmp_path / "c.cbz").unlink()
    _book(tmp_path / "d.cbz", [("b/1.jpg", b"twin", zipfile.ZIP_STORED)])
    import hashlib

    broken = hashlib.sha256((tmp_path / "d.cbz").read_bytes()).hexdigest()
    plan = plan.withColumn("old_hash", F.when(F.col("source") == "d.cbz", broken).otherwise(F.col("old_hash")))
    kept = (tmp_path / "b.cbz").read_bytes()
    found = {r.target: (r.outcome, r.reason) for r in J.commit(plan, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in found.items()} == {"a.cbz": "written", "b.cbz": "stale", "c.cbz": "failed", "d.cbz": "failed"}
    assert "unique" in found["d.cbz"][1] and (tmp_path / "b.cbz").read_bytes() == kept
    with pytest.raises(Exception, match="nothing was written"):
        J.commit(plan, str(tmp_path), strict=True)


def _staged(root, **options):
    writer = J.ArchiveWriter({"path": str(root), "job": "j", "backup": "", "force": "False", "strict": "False", **options})
    return writer, J.Staged


def test_a_change_between_stage_and_commit_is_seen(spark, tmp_path):
    import pyarrow as pa

    _book(tmp_path / "a.cbz")
    archives, entries = _world(spark, tmp_path)
    records = spark.createDataFrame([("a.cbz", "<new/>")], "archive string, xml string")
    rows = [r.asDict() for r in J.planned(archives, J.record_edits(entries, records)).orderBy("place").collect()]
    batch = pa.RecordBatch.from_pylist([{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.items()} for r in rows])
    writer, _ = _staged(tmp_path)
    message = writer.write(iter([batch]))
    again = writer.write(iter([batch]))  # the task runs twice, one of its messages counts
    assert message.items[0].part != again.items[0].part
    _book(tmp_path / "a.cbz", comment=b"another program wrote it")
    writer.commit([again, None])
    assert again.items[0].outcome == "stale" and _entries(tmp_path / "a.cbz")[-1][0] == "a/2.PNG"
    assert not (tmp_path / ".quire-j").exists()
    archives, _ = _world(spark, tmp_path)
    batch = batch.set_column(batch.schema.get_field_index("old_hash"), "old_hash", pa.array([archives.first().old_hash] * len(rows)))
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    os.utime(tmp_path / "a.cbz")  # another time, but the same content
    writer.commit([second])
    assert first.items[0].outcome == "staged" and second.items[0].outcome == "written"
    assert [n for n, _ in _entries(tmp_path / "a.cbz")].count("ComicInfo.xml") == 1 and sorted(os.listdir(tmp_path)) == [".quire-log", "a.cbz"]


def test_a_task_that_dies_after_staging_changes_nothing(spark, tmp_path):
    class Dying(J.ArchiveWriter):
        def write(self, iterator):
            super().write(iterator)
            os._exit(1)

    class Sink(J.ArchiveSink):
        @classmethod
        def name(cls):
            return "quire_dying"

        def writer(self, schema, overwrite):
            return Dying(dict(self.options))

    _book(tmp_path / "a.cbz")
    old = (tmp_path / "a.cbz").read_bytes()
    archives, entries = _world(spark, tmp_path)
    plan = J.planned(archives, J.record_edits(entries, spark.createDataFrame([("a.cbz", "<new/>")], "archive string, xml string")))
    with pytest.raises(Exception):  # noqa: B017
        J.commit(plan, str(tmp_path), sink=Sink)
    assert (tmp_path / "a.cbz").read_bytes() == old and os.listdir(tmp_path) == ["a.cbz"]
    assert J.commit(plan, str(tmp_path)).first().outcome == "written"


@pytest.mark.parametrize("name", ["../out", "a/b", "", "..", "/etc/x", "a\\b", None])
def test_names_stay_below_the_folder(spark, tmp_path, name):
    pages = spark.createDataFrame([(name, 1, "1.jpg", bytearray(b"x"), None)], "book string, page_no int, name string, data binary, xml string")
    with pytest.raises(Exception, match="not a name below the folder"):
        A.write_archives(pages, str(tmp_path / "root"))
    assert not (tmp_path / "out.cbz").exists()


def test_empty_plan(spark, tmp_path):
    assert J.commit(spark.createDataFrame([], J.CHANGES), str(tmp_path)).count() == 0


def test_write_flag(spark):
    rows = spark.createDataFrame([(w, d, e) for w in (True, False) for d in (True, False) for e in (True, False)], "w boolean, d boolean, e boolean")
    found = {(r.w, r.d, r.e): r.x for r in rows.withColumn("x", J.effective_write(F.col("w"), F.col("d"), F.col("e"))).collect()}
    assert {k for k, v in found.items() if v} == {(True, False, True), (True, False, False), (False, False, False)}


def test_names_are_told_by_their_parts(spark):
    names = ["a..b", "...", ".x", "..x/y", "..\n", "x/\n"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(J.safe_name(F.col("n"))).collect()] == names
    for bad in ("x/..", "./x", "x//y", "x/", "/"):
        with pytest.raises(Exception, match="not a name below the folder"):
            spark.createDataFrame([(bad,)], "n string").select(J.safe_name(F.col("n"))).collect()


def test_small_archives_are_staged_by_all_tasks(spark, tmp_path):
    class Counting(J.ArchiveWriter):
        def commit(self, messages):
            with open(self.options["path"] + "/tasks", "w") as f:
                f.write(str(sum(bool(m.items) for m in messages if m is not None)))
            super().commit(messages)

    class Sink(J.ArchiveSink):
        @classmethod
        def name(cls):
            return "quire_counting"

        def writer(self, schema, overwrite):
            return Counting(dict(self.options))

    rows = spark.range(40).selectExpr("CAST(NULL AS string) AS source", "concat('b', id, '.cbz') AS target", "CAST(NULL AS string) AS old_hash", "1 AS place", "'page' AS op", "'x.jpg' AS name", "CAST('x' AS binary) AS data", "true AS stored")
    done = J.commit(rows, str(tmp_path), sink=Sink)
    assert {r.outcome for r in done.collect()} == {"written"} and len(list(tmp_path.glob("*.cbz"))) == done.count() == 40
    assert int((tmp_path / "tasks").read_text()) >= 8  # two tasks for each core at least, though all rows are a few kB


def test_a_plan_reads_archives_and_makes_edits_once(spark, tmp_path):
    _book(tmp_path / "x.cbz", [("ComicInfo.xml", b"<old/>", zipfile.ZIP_DEFLATED), ("d/", b"", zipfile.ZIP_STORED)])
    (tmp_path / "d").mkdir()
    _book(tmp_path / "d" / "y.cbz")
    zipfile.ZipFile(tmp_path / "none.cbz", "w").close()
    plain = [sorted(map(tuple, df.select(*columns).collect())) for df, columns in zip(_world(spark, tmp_path), (["archive", "old_hash", "length"], ["archive", "idx", "name", "size"]), strict=True)]
    archives, entries = A.read_plan_input(spark, str(tmp_path))
    for path in ("x.cbz", "none.cbz", "d/y.cbz"):
        (tmp_path / path).unlink()
    assert [sorted(map(tuple, df.collect())) for df in (archives, entries)] == plain and len(plain[0]) == 3
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    records = spark.createDataFrame([("x.cbz", "<new/>"), ("d/y.cbz", "<new/>")], "archive string, xml string")
    edits = J.record_edits(entries, records)
    plan = J.planned(archives, edits.mapInArrow(counted, edits.schema)).collect()
    assert {(r.source, r.place, r.op, r.name) for r in plan} == {("x.cbz", 3, "put", J.RECORD), ("d/y.cbz", J.LAST, "put", J.RECORD)}
    assert made.value == 2


@pytest.mark.parametrize("whole", [0, 150, 4 << 20])
def test_archives_of_all_sizes_are_written_alike(tmp_path, monkeypatch, whole):
    import pyarrow as pa

    monkeypatch.setattr(J, "_WHOLE", whole)
    monkeypatch.setattr(J, "_SOME", 2)
    monkeypatch.setattr(J, "_CHUNK", 100)
    rows = []
    for n in range(5):
        _book(tmp_path / f"{n}.cbz")
        old_hash = J._hash(_staged(tmp_path)[0]._files()[0], f"{tmp_path}/{n}.cbz")
        rows.append({"source": f"{n}.cbz", "target": f"{n}.cbz", "old_hash": "another" if n == 2 else old_hash, "place": 2, "op": "put", "name": "a/2.PNG", "data": b"new" * 99, "stored": True})
    writer, _ = _staged(tmp_path)
    message = writer.write(iter([pa.RecordBatch.from_pylist(rows[:3]), pa.RecordBatch.from_pylist(rows[3:])]))
    writer.commit([message])
    assert [i.outcome for i in message.items] == ["written", "written", "stale", "written", "written"]
    for n, item in enumerate(message.items):
        path = tmp_path / f"{n}.cbz"
        assert _entries(path) == [("b/1.jpg", b"one"), ("notes.txt", b"text " * 500), ("a/2.PNG", b"two" if n == 2 else b"new" * 99)]
        if n != 2:
            assert (item.bytes, item.new_hash) == (path.stat().st_size, J._hash(writer._files()[0], str(path)))
    data = (tmp_path / "0.cbz").read_bytes().replace(b"new", b"nEw", 1)
    (tmp_path / "0.cbz").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "0.cbz") as z:
        assert J._damaged(z) == z.testzip() == "a/2.PNG"
