"""Parsers on literals, and archives there and back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.sources import archives as A


def test_wikitext_scanning():
    assert M.top_level_templates("a {{b|{{c}}}} d {{e}} {{open") == ["{{b|{{c}}}}", "{{e}}"]
    assert M.split_outside("a|{{b|c}}|[[d|e]]", "|") == ["a", "{{b|c}}", "[[d|e]]"]
    name, fields = M.template_fields("{{Infobox_Animanga/Manga|x=1|y=[[a|b]]|x=2|z={{t|u=v}}}}")
    assert name == "infobox animanga/manga" and fields == {"x": "2", "y": "[[a|b]]", "z": "{{t|u=v}}"}
    assert M.clean_wikitext("'''[[海賊王|ONE PIECE]]'''<ref>x</ref> {{lang|ja|ワン}}<!--c-->") == "ONE PIECE ワン"
    assert M.people_list("[[甲]]→[[乙]]") == ["甲", "乙"]
    assert M.edition_count("全37卷<br>全21卷（文庫版）", "刃牙 愛藏版") == 21 and M.count_of("全３７卷") == 37
    assert M.edition_count("普通版：37卷／文庫版：全21卷", "某某 文庫版") == 21
    assert M.categories("[[Category:日本漫畫]] [[Category:冒險|x]] [[category:日本漫畫]]") == ["日本漫畫", "冒險"]
    assert M.match_key("刃牙道Ⅱ") == M.match_key("刃牙道II")
    assert M.lead_summary("{{box|a}}\n'''甲'''是漫畫。\n\n第二段\n== 標題 ==\nx") == "甲是漫畫。"


def test_fields_of_wiki_pages():
    assert M.clean_wikitext("{{start date|1981}} {{tsl|ja|X|Y}} [https://x.org text] {{flag|Japan}}[[a|b]],") == "1981 Y text b"
    assert M.people_list("原作：[[坂井音太]]", "甲⇒乙／丙\n角色原案: 丁") == ["坂井音太", "甲", "乙／丙", "丁"]
    assert M.image_sources('<img data-lazy-src="a.jpg"><img href="h" data-src="d"><image srcset="s.webp 1x, t"><img src="data:x" data-src="y">') == ["a.jpg", "d", "s.webp"]
    box = lambda **f: "{{Infobox animanga/Manga" + "".join(f"\n|{k} = {v}" for k, v in f.items()) + "\n}}"
    football = box(標題="足球小將", 作者="[[高橋陽一]]", 冊數="全37卷<br>全21卷（文庫版）")
    assert M.main_work(football, "足球小將翼 (愛藏版)")["volume_count"] == 21 and M.main_work(football, "足球小將翼")["volume_count"] == 37
    assert M.edition_count("全37卷；全21卷（文库版）", "足球小将翼 (爱藏版)") == 21
    (w,) = M.works(box(標題="膽大黨", 開始日="2021年4月6日", 結束日="2026年7月1日"))
    assert (w["start"], w["end"]) == ("2021年4月6日", "2026年7月1日")
    assert [M.works(box(**f))[0]["start"] for f in ({"開始": "2020年", "發售日": "2019年12月"}, {"發售日": "2019年12月"})] == ["2020年", "2019年12月"]
    (w,) = M.works(box(出版社="{{flagicon|Japan}} [[集英社]]", 其他出版社="{{flagicon|Taiwan}} [[東立出版社]]<br>{{flagicon|Hong Kong}} [[文化傳信]]"))
    assert (w["japan_publishers"], w["taiwan_publishers"], w["hongkong_publishers"]) == (["集英社"], ["東立出版社"], ["文化傳信"])
    (w,) = M.works(box(原作="原作：[[坂井音太]]", 作畫="[[恩田千路]]→[[内藤らぶ]]", 冊數="全4冊"))
    assert (w["author"], w["penciller"]) == (["坂井音太"], ["恩田千路", "内藤らぶ"])


def test_choice_of_boxes_and_strength_of_pages():
    text = "{{Infobox animanga/Manga\n|作者 = 南勝久\n|冊數 = 全22冊\n}}\n{{Infobox animanga/Manga\n|標題 = 殺手寓言 The second contact\n|冊數 = 全9冊\n}}"
    assert M.main_work(text, "殺手寓言", "殺手寓言")["volume_count"] == 22
    assert M.main_work(text, "殺手寓言 The second contact", "殺手寓言")["volume_count"] == 9
    assert M.page_strength(text, "殺手寓言 The second contact", "殺手寓言") == 3 and M.page_strength(text, "別的", "x") == 0
    one = "{{Infobox animanga/Manga|標題=刃牙道外傳記|冊數=1}}"
    assert M.page_strength(one, "新刃牙道外傳記二", "x") == 2 and M.page_strength("no box", "abcde fgh", "The Abcde") == 1 and M.page_strength("", "abcde", None) == 0


def test_works_follow_their_header(spark):
    text = "{{Infobox animanga/headerofja|japanese=ジャンプ|genre=[[少年漫畫]]、冒險}}{{infobox animanga/manga|標題=甲|作者=[[某]]|出版社={{flagicon|Japan}} 集英社<br>{{flagicon|Taiwan}} 東立出版社|冊數=全42卷|開始=1981年}}{{infobox animanga/manga|title=乙|冊數=22}}"
    rows = spark.createDataFrame([(text, None)], "text string, query string").select(M.works_udf("text").alias("w")).first().w
    assert [w.title for w in rows] == ["甲", "乙"] and [w.volume_count for w in rows] == [42, 22]
    assert rows[0].taiwan_publishers == ["東立出版社"] and rows[0].japan_publishers == ["集英社"] and rows[0].genre == ["少年漫畫", "冒險"]
    assert rows[1].original_title == "ジャンプ" and rows[0].start == "1981年" and rows[1].raw_fields["冊數"] == "22"


OPF = b"""<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="p%201.html" media-type="t"/><item id="b" href="p2.html"/><item id="b" href="../p3.html"/></manifest>
<spine><itemref idref="b"/><itemref idref="a"/><itemref idref="none"/></spine></package>"""


def archive(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in entries:
            z.writestr(name, data)


def test_books_there_and_back(spark, tmp_path):
    books = tmp_path / "books"
    books.mkdir()
    html = '<p><img src="../img/1.jpg"/><img data-src="../img/2.png"><img src="data:x"><image xlink:href="../img/none.gif"/>'
    archive(books / "a.epub", [("OPS/vol.opf", OPF), ("OPS/p 1.html", html), ("p3.html", '<img src="img/1.jpg">'), ("img/1.jpg", b"one"), ("img/2.png", b"two")])
    entries = A.read_entries(spark, str(books), "*.epub")
    assert A.list_books(spark, str(books)).count() == 1 and A.count_images(entries).first().pages == 2
    assert A.read_entries(spark, str(books), "*.epub", with_data=False).where("data IS NOT NULL").count() == 0
    packages = entries.where(F.col("name").endswith(".opf"))
    pages = M.spine_pages(packages, entries).collect()
    assert [(p.pos, p.name) for p in pages] == [(0, "p3.html"), (1, "OPS/p 1.html")]
    html_pages = entries.where(F.col("name").endswith(".html")).select("archive", "name", F.col("data").cast("string").alias("html"))
    shown = M.page_images(html_pages, entries).orderBy("page", "ord").collect()
    assert [(s.page, s.name) for s in shown] == [("OPS/p 1.html", "img/1.jpg"), ("OPS/p 1.html", "img/2.png"), ("p3.html", "img/1.jpg")]
    images = entries.where("name LIKE 'img/%'").select(F.lit("Series - 第001卷").alias("book"), F.col("idx").alias("page_no"), "name", "data", F.lit("<ComicInfo/>").alias("xml"))
    out = A.write_archives(images, str(tmp_path / "out")).first()
    assert out.pages == 2
    with zipfile.ZipFile(out.path) as z:
        assert z.namelist() == ["0001.jpg", "0002.png", "ComicInfo.xml"] and z.read("0001.jpg") == b"one" and z.getinfo("0001.jpg").compress_type == zipfile.ZIP_STORED
    again = A.read_entries(spark, str(tmp_path / "out"), "*.cbz")
    assert bytes(A.metadata_entry(again).first().data) == b"<ComicInfo/>"
    records = again.select("archive").distinct().withColumn("xml", F.lit("<ComicInfo>2</ComicInfo>"))
    new = {r["name"]: bytes(r["data"]) for r in A.replace_metadata(again, records).collect()}
    assert new == {"0001.jpg": b"one", "0002.png": b"two", "ComicInfo.xml": b"<ComicInfo>2</ComicInfo>"}
    A.write_archives(images, str(tmp_path / "out"), backup="keep").collect()
    with pytest.raises(Exception, match="FileExistsError|bak"):
        A.write_archives(images, str(tmp_path / "out"), backup="error").collect()


def test_listings_records_and_required_numbers(spark, tmp_path):
    for name in ("b10.pdf", "b9.pdf", "2.pdf"):
        (tmp_path / name).write_bytes(b"x")
    listed = [r.archive.rsplit("/", 1)[1] for r in A.list_books(spark, str(tmp_path), "*.pdf", natural=True).collect()]
    assert listed == ["b9.pdf", "b10.pdf", "2.pdf"]
    paths = spark.createDataFrame([(str(tmp_path / "2.pdf"),), (str(tmp_path / "no.pdf"),), (str(tmp_path),), (None,)], "path string")
    assert [r.status for r in A.chosen_books(spark, paths).collect()] == ["ok", "missing", "missing", "missing"]
    archive(tmp_path / "a.cbz", [("x/ComicInfo.xml", "<ComicInfo><Series>far</Series></ComicInfo>"), ("ComicInfo.xml", "<ComicInfo><Series>near</Series></ComicInfo>")])
    archive(tmp_path / "b.cbz", [("1.jpg", b"x")])
    assert [r.series for r in A.read_records(A.read_entries(spark, str(tmp_path), "*.cbz")).collect()] == ["near"]
    from quire.functions import text

    df = spark.createDataFrame([("a", "7"), ("b", None)], "name string, n string")
    assert df.where("n IS NOT NULL").select(text.required(F.col("n"), F.col("name"))).first()[0] == "7"
    with pytest.raises(Exception, match="no volume number in b"):
        df.select(text.required(F.col("n"), F.col("name"))).collect()
    from quire.sources import wiki

    probes = spark.createDataFrame([("p/b", 1), ("p/a", 2)], "folder string, x int")
    assert wiki.first_probe(probes).first().x == 2 and wiki.first_probe(probes.limit(0)).count() == 0


def test_entries_stay_inside(spark, tmp_path):
    archive(tmp_path / "bad.epub", [("../evil", b"x")])
    with pytest.raises(Exception, match="outside of the archive"):
        A.read_entries(spark, str(tmp_path), "*.epub").collect()
    assert io.BytesIO is not None
