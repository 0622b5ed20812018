"""As-of and interval joins by plain loops, the audit's single pass, sketches within their error, unknown tags."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import records as R
from quire.operators import asof, audit, series, sketches


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_asof_join(spark, parts):
    r = random.Random(1)
    key = lambda: r.choice([1, 1, 1, 2, 3, None])
    left = [(i, key(), r.choice([None, *range(40)])) for i in range(200)]
    right = [(key(), r.choice([None, *range(40)]), i) for i in range(60)]
    found = asof.asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", ["v"], parts, tie="v")
    want = {}
    for i, k, t in left:
        before = [(s, v) for q, s, v in right if k is not None and t is not None and q == k and s is not None and s <= t]
        want[i] = max(before)[1] if before else None
    assert {x.id: x.v for x in found.collect()} == want
    assert asof.asof_join(spark.createDataFrame(left[:2], "id int, k int, t int"), spark.createDataFrame([], "k int, t int, v int"), "k", "t", ["v"]).count() == 2


@pytest.mark.parametrize("parts", [1, 9, 200])
def test_overlaps(spark, parts):
    r = random.Random(2)
    some = lambda n: [(i, a, a + r.choice([0, -1, 1, 2, 3, 90])) for i, a in enumerate(r.choice([5, r.randrange(100)]) for _ in range(n))] + [(n, None, 5), (n + 1, 5, None), (n + 2, -1000, 1000)]
    left, right = some(80), some(60)
    found = asof.overlaps(spark.createDataFrame(left, "id int, a int, b int"), spark.createDataFrame(right, "id int, a int, b int"), "a", "b", parts)
    pairs = [(x.l.id, x.r.id) for x in found.collect()]
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] < x[2]
    want = {(x[0], y[0]) for x in left for y in right if ok(x) and ok(y) and x[1] < y[2] and y[1] < x[2]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("parts", [1, 9])
def test_overlap_sums_are_those_of_the_pairs_and_make_none(spark, parts):
    r = random.Random(3)
    some = lambda n: [(i, a, a + r.choice([0, -1, 1, 2, 3, 90])) for i, a in enumerate(r.choice([5, r.randrange(100)]) for _ in range(n))] + [(n, None, 5), (n + 1, 5, None), (n + 2, -1000, 1000)]
    left, right = some(80), [(None if i % 9 == 0 else i, a, b) for i, a, b in some(60)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, a int, b int")
    found = asof.overlap_sums(frame(left), frame(right).withColumnRenamed("id", "v"), "a", "b", ["v"], parts)
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] < x[2]
    want = {}
    for x in filter(ok, left):
        near = [y for y in right if ok(y) and x[1] < y[2] and y[1] < x[2]]
        if near:
            want[x[0]] = len(near), sum(y[0] or 0 for y in near), sum(min(x[2], y[2]) - max(x[1], y[1]) for y in near)
    assert {x.id: (x.n, int(x.v), int(x.shared)) for x in found.collect()} == want and len(want) > 40
    # two crowds that all overlap: four hundred million pairs, and sums beyond a double's whole numbers
    crowd = spark.range(20_000).select((F.col("id") + 2**50).alias("v"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("a"), F.timestamp_seconds(1_700_000_001 + F.col("id") % 2).alias("b"))
    one = asof.overlap_sums(crowd.select("a", "b"), crowd, "a", "b", ["v"], parts).agg(F.sum("n").alias("n"), F.max("v").alias("v"), F.sum("shared").alias("s")).first()
    assert (one.n, int(one.v)) == (20_000**2, 20_000 * 2**50 + 19_999 * 10_000) and int(one.s) == 10_000**2 * 5 * 1_000_000


def test_band_pairs_are_counted_and_not_made(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(90)]), r.choice([900 + r.randrange(400) / 10, r.random() * 20, None, float("nan"), float("inf")]), r.choice([None, *range(12)])) for _ in range(400)]
    rows += [("c", 1, 5.0, 1), ("c", 2, -1e-20, 1), ("d", 1, 1.0, 1), ("d", 1, 1.0, 1), ("d", None, 1.0, 1)]
    found = series.band_pairs(spark.createDataFrame(rows, "g string, i int, x double, y int"), "g", "i", "x", "y", 5.0, 4)
    want = {}
    for g, i, x, y in rows:
        for h, j, u, v in rows:
            if None not in (g, i, x, y, h, j, u, v) and g == h and i < j and abs(x - u) <= 5.0 and abs(y - v) <= 4:
                want[g] = want.get(g, 0) + 1
    assert {x.g: x.pairs for x in found.collect()} == want and want["c"] == 1 and "d" not in want
    # a crowd at one point and around it: more than a hundred million pairs
    crowd = spark.range(30_000).select(F.lit("a").alias("g"), F.col("id").alias("i"), (F.col("id") % 2 * 5).cast("double").alias("x"), (F.col("id") % 3).alias("y"))
    assert series.band_pairs(crowd, "g", "i", "x", "y", 5.0, 4).first().pairs == 30_000 * 29_999 // 2


def test_an_audit_is_one_pass(spark, tmp_path):
    rows = [(k, f"d//p{k % 7}.JPG" if k % 2 else f"d/./p{k % 7}.jpg", k % 5 == 0) for k in range(40)] + [(40, None, False)]
    spark.createDataFrame(rows, "place int, path string, white boolean").repartition(3).write.parquet(str(tmp_path / "in"))
    pages = spark.read.parquet(str(tmp_path / "in"))
    touched = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            touched.add(b.num_rows)
            yield b

    once = pages.mapInArrow(count, pages.schema)
    done = audit.audited(once, {"white": F.col("white"), "null": F.col("path").isNull(), "unknown": F.lit(None).cast("boolean")}, {"big": F.col("place") > 38})
    assert touched.value == 41  # counts and split together scan once
    assert done.counts == {"kept": 31, "failed:big": 2, "white": 8, "null": 0, "unknown": 0} and done.exit_code() == 1
    assert {o: done.rows(o).count() for o in ("kept", "skipped", "failed")} == {"kept": 31, "skipped": 8, "failed": 2} and touched.value == 41
    assert done.rows("kept").columns == pages.columns

    files = audit.page_files(pages, F.when(F.col("white"), "blank"))
    first, kept = set(), []
    for place, path, white in rows:
        key = None if path is None else path.lower().replace("/./", "/").replace("//", "/")
        if not white and (key is None or key not in first):
            first.add(key)
            kept.append(place)
    assert sorted(r.place for r in files.rows("kept").collect()) == kept and files.exit_code() == 0
    assert files.counts["garbage-image"] == 8 and files.counts["kept"] + files.counts["duplicate"] == 33
    line = files.rows("skipped").where("place = 0").select(audit.skip_line(F.col("reason"), F.col("path"))).first()[0]
    assert line == "  - skip [garbage-image] p0.jpg"
    with pytest.raises(ValueError, match="outcome or reason"):
        audit.with_reasons(pages.withColumn("reason", F.lit(1)), {})
    assert audit.audited(pages.limit(0), {"white": F.col("white")}).counts == {"kept": 0, "white": 0}


def test_archives_with_a_poor_cover_are_built_again(spark):
    targets = spark.createDataFrame([("new", False), ("good", True), ("white", True), ("undecoded", True), ("empty", True), ("unread", True)], "archive string, there boolean")
    covers = spark.createDataFrame([("good", "1.jpg"), ("white", "1.jpg"), ("undecoded", "1.jpg"), ("empty", None)], "archive string, name string")
    blank = spark.createDataFrame([("good", False), ("white", True)], "archive string, blank boolean")
    found = {r.archive: r.action for r in audit.rebuilds(targets, covers, blank).collect()}
    assert found == {"new": "build", "good": "skip", "white": "rebuild", "undecoded": "rebuild", "empty": "rebuild", "unread": "rebuild"}


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("day"), F.when(F.col("id") % 11 > 0, F.col("id") * 37 % 20000).alias("v"))
    parts = sketches.sketch_table(rows, ["k", "day"], "v")
    assert parts.count() == 21
    whole = {r.k: r.distinct for r in sketches.estimated(parts, ["k"]).collect()}
    exact = {r.k: r.n for r in rows.groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    assert all(abs(whole[k] - n) <= sketches.relative_error() * n for k, n in exact.items())


def test_unknown_tags_survive(spark):
    xml = "<?xml version='1.0'?>\n<ComicInfo a='1'><Series>x</Series><Odd>y &amp; &lt;z</Odd><Shelf>007</Shelf><Shelf/><Deep><a>1.50</a></Deep><AlternativeSeries>s</AlternativeSeries></ComicInfo>"
    df = spark.createDataFrame([(1, xml), (2, "<ComicInfo><bad"), (3, None), (4, "<Other><Odd>1</Odd></Other>"), (5, "<ComicInfo></ComicInfo>")], "id int, xml string")
    found = {r.id: r.extra for r in R.unknown_tags(df).collect()}
    assert found == {1: {"Odd": ["y &amp; &lt;z"], "Shelf": ["007", ""], "Deep": ["<a>1.50</a>"]}, 2: {}, 3: {}, 4: {}, 5: {}}
    written = {r.id: r.xml for r in R.from_xml(df).join(R.unknown_tags(df).select("id", "extra"), "id").select("id", R.with_unknown_tags(R.to_xml(), F.col("extra")).alias("xml")).collect()}
    assert written[1].endswith("  <AlternateSeries>s</AlternateSeries>\n  <Deep><a>1.50</a></Deep>\n  <Odd>y &amp; &lt;z</Odd>\n  <Shelf>007</Shelf>\n  <Shelf></Shelf>\n</ComicInfo>") and written[5].endswith("<ComicInfo></ComicInfo>")
    held = df.select("id", R.held_tags(F.col("xml")).alias("tags"))
    assert {(r.id, r.tag) for r in R.tag_difference(held, "id").collect()} == {(1, "Odd"), (1, "Shelf"), (1, "Deep")}
