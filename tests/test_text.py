"""Golden rows of names, numbers, keys and coercions."""

from pyspark.sql import functions as F

from quire.functions import clean as C
from quire.functions import text as T


def values(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    assert values(spark, ["/b/烏龍派出所（台版）/卷001.epub", "/b/甲（愛藏版）/卷2.epub", "[Kmoe][海賊王]卷111.epub", "甲/番外 第2卷.epub", "甲/卷10.5外傳.epub", "甲/20周年紀念短篇.epub", "甲/其他.epub"], T.archive_name) == [
        "烏龍派出所 - 第001卷.cbz", "甲（愛藏版） - 第002卷.cbz", "海賊王 - 第111卷.cbz", "甲 - 番外 第002册.cbz", "甲 - 外傳 第010.5册.cbz", "甲 - 20周年紀念短篇.cbz", "甲 - 其他.cbz",
    ]
    assert values(spark, ["刊/T05特.epub", "刊/2019年3月.epub", "刊/第1、2期.epub", "刊/12三月上.epub"], lambda c: T.archive_name(c, periodical=True)) == ["刊 - T05特.cbz", "刊 - 2019-03.cbz", "刊 - 第001-002期.cbz", "刊 - 第012期 3月上.cbz"]
    assert values(spark, ["a.KEPUB", "[x][y] 名", "甲(乙)丙"], T.clean_name) == ["a", "名", "丙"]


def test_numbers(spark):
    assert values(spark, ["００７", "10.50", "0", "3.00", "1234"], T.canonical_number) == ["7", "10.5", "0", "3", "1234"]
    assert values(spark, ["7", "10.5", "1234"], T.padded_number) == ["007", "010.5", "1234"]
    assert values(spark, ["The JOJO Lands - 012.cbz", "第０３卷", "20周年紀念短篇", "vol. 4.5", "x"], T.inferred_volume) == ["12", "3", None, "4.5", None]
    assert values(spark, ["約１９81年", "1981年", "x"], T.year)[1:] == [1981, None] and values(spark, ["十二", "一", "x"], T.chinese_month) == [12, 1, None]


def test_keys_and_paths(spark):
    names = ["10.bmp", "2.jpg", "1.png", "a2", "a10", "第2卷", "第１０卷"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["a2", "a10", "第2卷", "第１０卷", "1.png", "2.jpg", "10.bmp"]
    assert [r.n for r in df.orderBy(T.natural_key(F.col("n"), letters_first=False)).collect()][:3] == ["1.png", "2.jpg", "10.bmp"]
    assert [r.n for r in df.where("n LIKE '%.%'").orderBy(T.digit_run_key(F.col("n"))).collect()] == ["1.png", "2.jpg", "10.bmp"]
    assert values(spark, ["a%20b+c/./d/../e.html#x", "..\\x\\y", "/p//q/", "%zz"], T.normal_path) == ["a b+c/e.html", "../x/y", "/p/q", "%zz"]
    assert values(spark, ["https://zh.wikipedia.org/wiki/%E6%B5%B7_x", "https://zh.wikipedia.org/w/index.php?title=A_B&c=1", "https://zh.wikipedia.org/zh-tw/C"], T.wiki_title) == ["海 x", "A B", "C"]
    assert values(spark, ["a%23b#c", "%2", "#", "/../x", "a/.."], T.normal_path) == ["a", "%2", ".", "/x", "."]
    long = ["a" + "9" * 50, "a" + "9" * 49 + "8", "a1"]
    assert [r.n for r in spark.createDataFrame([(n,) for n in long], "n string").orderBy(T.natural_key(F.col("n"))).collect()] == long[::-1]
    assert values(spark, ["全99999999999卷"], T.first_count) == [99999999999]
    assert values(spark, [["動作漫畫", "科幻作品", "x"], ["科幻", "動作"], ["歷史錯誤"]], T.genres, "array<string>") == [["Action", "Science fiction"], ["Science fiction", "Action"], []]
    assert values(spark, [["冒險漫畫", "CS1错误", "含有日語的條目", "1981年漫畫"]], T.content_categories, "array<string>") == [["冒險漫畫", "1981年漫畫"]]
    assert values(spark, [["A", "b", "a", "B", "c"]], T.ordered_distinct, "array<string>") == [["A", "b", "c"]]
    assert values(spark, ["臺灣：大然文化→東立出版社", "日本：臺灣： 甲", "角川：少年部", "甲 --> 乙⟶丙"], T.display_publisher) == ["東立出版社", "甲", "角川：少年部", "丙"]
    assert values(spark, ["<b>a</b> &amp;  b" + "x" * 200], T.snippet) == ["a & b" + "x" * 115]


def test_coercions(spark):
    assert values(spark, [" a\x00b ", "", "  "], C.text) == ["ab", None, None]
    assert values(spark, ["3.9", "x", "-2", " 7 "], C.integer) == [3, None, -2, 7] and values(spark, ["9007199254740993"], C.integer) == [9007199254740993]
    assert values(spark, ["Yes", "0", "maybe"], C.boolean) == [True, False, None]
    assert [str(x) for x in values(spark, ["4.25", "4.24", "5.01", "6", "x"], C.rating)] == ["4.3", "4.2", "5.0", "None", "None"]
    assert values(spark, ["a, b ,A,,c"], C.value_list) == [["a", "b", "c"]]
    assert values(spark, ["yes", "zzz", None], lambda c: C.one_of(c, ("Yes", "No"), "Unknown")) == ["Yes", "Unknown", "Unknown"]
