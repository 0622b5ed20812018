"""Golden rows of periodical names, records and their XML, and the choice of pages."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.functions import periodicals as P
from quire.functions import records as R
from quire.operators import pages as G


def values(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_periodical_names(spark):
    golden = {
        "/b/电子游戏软件/电子游戏软件.01年第08期.总第85期.pdf": "电子游戏软件 v085.cbz",
        "/b/电子游戏软件/电子游戏软件.01年第12期.总第89期.pdf": "电子游戏软件 v089.cbz",
        "/b/电子游戏软件/电子游戏软件第54期 1999.01.pdf": "电子游戏软件 v054.cbz",
        "/b/UCG-PS3专辑/PS3专辑 Vol.01.pdf": "UCG-PS3专辑 v001.cbz",
        "/b/电子游戏软件/GAME集中营试刊VOL.1.pdf": "电子游戏软件 SP001 GAME集中营试刊VOL.1.cbz",
        "/b/烏龍派出所（日版）/Vol.01.pdf": "烏龍派出所 v001.cbz",
        "/b/刊/刊 12-13 合刊 春.pdf": "刊 v012-013 合刊 春.cbz",
        "/b/刊/【刊】 7 增刊 图集.pdf": "刊 SP007 增刊 图集.cbz",
        "/b/刊/创刊号补完.pdf": "刊 v001.cbz",
        "/b/刊/珍藏 大全.pdf": "刊 SP000 珍藏 大全.cbz",
        "/b/刊/011 1999.10.pdf": "刊 v011.cbz",
        "/b/刊/2600.pdf": "2600.cbz",
        "/b/刊/Some Title 10x20+30x40=5.pdf": "Some Title.cbz",
        "x.pdf": "x.cbz",
    }
    df = spark.createDataFrame([(g,) for g in golden], "path string")
    assert {r.path: r.archive for r in P.archive_names(df).collect()} == golden


def test_periodical_records(spark):
    df = spark.createDataFrame([("/b/刊/a.pdf", "刊 v012-013 合刊.cbz"), ("/b/刊/b.pdf", "刊 SP000 珍藏.cbz"), ("/b/刊/c.pdf", "c.cbz")], "path string, archive string")
    rows = df.select(*[v.alias(n) for n, v in P.record_of(F.col("path"), F.col("archive")).items()]).collect()
    assert [(r.title, r.series, r.format, r.tags) for r in rows] == [("第012-013期 合刊", "刊", "Magazine", ["合刊"]), ("珍藏", "刊", "Special", ["珍藏"]), ("c", "刊", "Magazine", [])]


def test_record_there_and_back(spark):
    page = (0, ["frontcover", "x", "FrontCover"], True, 10, "k\"<", None, 800, 1000)
    df = spark.createDataFrame(
        [(1, " A & <B> ", ["x", "X", "y, z"], "7.50", "4.25", "sometimes", "teen", [page, (None, None, None, None, None, None, None, None)]), (2, None, None, None, "9", None, None, None)],
        f"id int, title string, genre array<string>, count string, community_rating string, manga string, age_rating string, pages array<{R.PAGE}>",
    )
    records = R.normalise(df)
    a, b = records.orderBy("id").collect()
    assert (a.title, a.genre, a["count"], str(a.community_rating), a.manga, a.age_rating) == ("A & <B>", ["x", "y", "z"], 7, "4.3", "Yes", "Teen")
    assert len(a.pages) == 1 and a.pages[0].page_type == ["FrontCover"] and b.community_rating is None and b.manga is None and b.pages == []
    written = records.select("id", R.to_xml().alias("xml"))
    xml = {r.id: r.xml for r in written.collect()}
    assert xml[2] == "<?xml version='1.0' encoding='utf-8'?>\n<ComicInfo></ComicInfo>"
    root = ET.fromstring(xml[1].encode())
    assert [c.tag for c in root] == ["Title", "Count", "Genre", "Manga", "AgeRating", "Pages", "CommunityRating"]
    assert root.find("Title").text == "A & <B>" and root.find("Genre").text == "x, y, z" and root.find("Pages")[0].get("Key") == 'k"<'
    back = {r.id: r for r in R.from_xml(written).collect()}
    assert back[1] == a or back[1].asDict(True) == {k: v for k, v in a.asDict(True).items()}
    assert back[2].asDict(True) == b.asDict(True)


def test_records_read_other_tags_and_skip_bad_pages(spark):
    xml = "<ComicInfo><AlternativeSeries>S</AlternativeSeries><Unknown>u</Unknown><Year>1981.0</Year><Tags>a, A ,b</Tags><Pages><Page Image='x'/><Page Image='2' Type='Story Deleted'/></Pages></ComicInfo>"
    df = spark.createDataFrame([(1, xml), (2, "<Other/>"), (3, None)], "id int, xml string")
    rows = {r.id: r for r in R.from_xml(df).collect()}
    assert (rows[1].alternate_series, rows[1].year, rows[1].tags) == ("S", 1981, ["a", "b"])
    assert [(p.image, p.page_type) for p in rows[1].pages] == [(2, ["Story", "Deleted"])]
    assert rows[2].title is None and rows[3].tags == []


WORK = M.WORK.replace(", raw_fields", ", tags array<string>, raw_fields")


def wiki(spark, categories=(), volume="1", **work):
    names = [f.split()[0] for f in WORK.split(", ")]
    base = {"title": "測試漫畫", "genre": ["奇幻"], "magazine": ["週刊少年Jump"], **work}
    main = tuple(base.get(n, [] if "array" in k else None) for n, k in zip(names, (f.split(" ", 1)[1] for f in WORK.split(", "))))
    kinds = ", ".join(f.replace(" ", ": ", 1) for f in WORK.split(", "))
    row = ("測試漫畫", None, None, None, None, list(categories), main, volume)
    return spark.createDataFrame([row], f"page_title string, page_url string, wikibase_item string, summary string, series_sort string, categories array<string>, main struct<{kinds}>, volume_number string")


def test_wiki_pages_fill_records(spark):
    rubbish = ["CS1含有日語文本 (ja)", "CS1日语来源 (ja)", "引文格式1錯誤：日期", "引用格式1错误：日期", "模板调用错误：参数无效", "含有連結內容需訂閱查看的頁面", "含有韓語的條目", "使用ISBN魔术链接的页面", "與維基數據不同的Twitter用戶名"]
    useful = ["2016年日本漫畫作品", "2020年完結漫畫", "Crunchyroll動畫獎得主", "手塚治虫文化獎獲獎作品", "週刊少年Jump連載作品", "日本漫畫作品"]
    r = R.from_wiki(wiki(spark, rubbish + useful, author=["坂井音太"], penciller=["恩田千路", "内藤らぶ"], start="1981年", volume_count=21, taiwan_publishers=["臺灣： 青文出版社"])).first()
    assert r.tags == ["奇幻", "週刊少年Jump", *useful] and r.writer == ["坂井音太"] and r.penciller == ["恩田千路", "内藤らぶ"]
    assert (r.title, r.series, r.number, r["count"], r.year, r.publisher, r.manga, r.age_rating, r.volume, r.notes) == ("第 1 卷", "測試漫畫", "1", 21, 1981, "青文出版社", "Yes", "Teen", None, None)
    r = R.from_wiki(wiki(spark, ["冒險漫畫", "黑暗奇幻", "獵奇", "大正時代背景漫畫", "引文格式1錯誤：日期"], genre=["動作", "科幻", "戀愛喜劇"])).first()
    assert r.genre == ["Action", "Science fiction", "Romance", "Comedy", "Adventure", "Fantasy", "Horror", "Historical"]
    assert R.from_wiki(wiki(spark, taiwan_publishers=["時報文化：漫畫部"])).first().publisher == "時報文化：漫畫部"
    assert R.from_wiki(wiki(spark, japan_publishers=["日本：集英社"])).first().publisher is None
    assert R.from_wiki(wiki(spark, taiwan_publishers=["臺灣：大然文化→東立出版社"])).first().publisher == "東立出版社"


def test_books_have_numbers_or_are_special(spark):
    books = wiki(spark).drop("volume_number").crossJoin(spark.createDataFrame([("/b/甲/卷003.epub", "甲 - 第003卷.cbz", 9), ("/b/甲/甲 - 番外 第2卷.epub", "x.cbz", 9), ("/b/甲/20周年紀念短篇.epub", "y.cbz", 0), ("/b/甲/none.epub", "z.cbz", 9)], "path string, archive string, books_in_folder int"))
    rows = {r.archive: r for r in R.for_books(books).collect()}
    assert set(rows) == {"甲 - 第003卷.cbz", "x.cbz", "y.cbz"}
    a, x, y = rows["甲 - 第003卷.cbz"], rows["x.cbz"], rows["y.cbz"]
    assert (a.title, a.number, a["count"], a.format, a.series) == ("第 3 卷", "3", 9, None, "甲")
    assert (x.title, x.number, x.format) == ("番外 第2卷", "2", "Special") and (y.title, y.number, y["count"], y.format) == ("20周年紀念短篇", None, None, "Special")


def test_page_choice(spark):
    assert values(spark, ["刃牙道 II 外傳：漫畫", "The the X ab"], G.query_tokens) == [["刃牙道", "II"], ["The", "ab"]]
    assert values(spark, ["刃牙道II 外傳", "獵人", "殺手寓言 The second contact", "ABC2"], G.parent_titles) == [["刃牙道II", "刃牙道", "刃牙", "牙道"], [], ["殺手寓言", "殺手", "寓言"], ["ABC"]]
    rows = [("a", 0, 0, "direct", 2), ("a", 1, 0, "hit", 0), ("a", 1, 1, "best", 3), ("b", 0, 0, "direct", 1), ("b", 1, 0, "hit", 2), ("b", 1, 1, "later", 2), ("b", 2, 0, "parent", 2), ("c", 1, 0, "hit", 1), ("c", 2, 0, "parent", 3), ("d", 0, 0, "none", 0)]
    chosen = G.choose(spark.createDataFrame(rows, "query string, phase int, rank int, title string, strength int")).collect()
    assert {r.query: r.title for r in chosen} == {"a": "best", "b": "hit", "c": "parent"}
    assert values(spark, ["死神", "海賊王"], G.lookup_title) == ["BLEACH", "海賊王"]


def test_heavy_rows_of_one_small_file_are_many_tasks(spark, tmp_path):
    """A file of one row group is one partition; its records are read and written in as many tasks as there are cores."""
    from quire.plans import catalogue, jobs

    part = spark.range(200).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "cast(id % 50 AS int) AS p_size", "1.0D AS p_retailprice")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert catalogue.record_roundtrip(spark, str(tmp_path)).rdd.getNumPartitions() >= 4
    plan = jobs.unknown_record_tags(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(4)" in plan and "REPARTITION_BY_NUM" in plan
    assert plan.count("variant") <= 2 and plan.count("Scan parquet") == 1  # a record's tags are read once
    assert jobs.unknown_record_tags(spark, str(tmp_path)).count() == 67 + 2 * 67
