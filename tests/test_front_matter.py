"""Front pages: decisions from recognised lines, and the batch fold beside the stream and a plain loop."""

import random

from pyspark.sql import functions as F

from quire.operators import front_matter as M
from quire.streaming import known_pages as K

LINES = "collection string, book long, page int, line int, text string, confidence double, ys array<double>"
HEIGHTS = "collection string, book long, page int, height int"


def decide(spark, pages, height=1000):
    rows = [("c", 1, p, i, *line) for p, lines in pages.items() for i, line in enumerate(lines)]
    heights = spark.createDataFrame([("c", 1, p, height) for p in pages], HEIGHTS)
    found = M.page_decisions(spark.createDataFrame(rows, LINES), heights).collect()
    return {r.page: (r.confirmed, r.score, list(r.hits)) for r in found}


def test_decisions(spark):
    top, low = [10.0, 20.0], [800.0, 900.0]
    found = decide(
        spark,
        {
            0: [("免责 声明！", 0.9, top), ("版权归原作者", 0.9, low)],
            1: [("免责声明", 0.9, low), ("版权归原作者", 0.9, top)],  # a title at the foot doesn't count
            2: [("免责声明", 0.5, top), ("版权归原作者", 0.9, top)],  # read with too little confidence
            3: [("免责声明", 0.5, top), ("版权归原作者", None, top)],  # no confidence for all lines: all are kept
            4: [("WARNING", 0.9, top), ("persons under the age of 18!", 0.9, low)],
            5: [("Warning", 0.9, None), ("under 18", 0.9, low)],  # without a box no title is in the upper part
            6: [("版权归", 0.9, low), ("非盈利", 0.9, low), ("盗版", 0.9, low), ("侵权", 0.9, low)],
            7: [(None, 0.9, top), ("cover", 0.9, top)],
            8: [("免责", 0.9, top), ("声明 学习之用", 0.9, top)],  # a title over two lines is read, but no line holds it
        },
    )
    assert found[0] == (True, 5, ["title:免责声明@upper", "copyright"])
    assert found[1] == (False, 5, ["title:免责声明@footer", "copyright"])
    assert found[2] == (False, 1, ["copyright"]) and found[3][0]
    assert found[4] == (True, 6, ["adult-warning:WARNING@upper", "adult-restriction:UNDER THE AGE OF 18"])
    assert found[5] == (False, 0, ["adult-warning:WARNING@footer", "adult-restriction:UNDER 18"])
    assert found[6] == (True, 4, ["copyright", "noncommercial", "piracy", "infringement"])
    assert found[7] == (False, 0, []) and found[8] == (False, 5, ["title:免责声明@footer", "learning"])


def test_the_fold_agrees_with_the_stream_and_a_plain_loop(spark, tmp_path):
    rng = random.Random(2)
    prints = [(700 + 3 * k, rng.randbytes(32), rng.randbytes(32)) for k in range(90)]
    books = []
    for c in ("a", "b"):
        for b in range(60):
            chosen = rng.choices(prints, k=rng.randrange(0, 5))
            pages = [{"aspect": a + rng.randrange(3), "dhash": None if rng.random() < 0.1 else d, "ahash": h, "confirmed": rng.random() < 0.8} for a, d, h in chosen]
            books.append((c, b, pages or None))
    want = set()
    for c in ("a", "b"):
        known: list = []
        for _, b, pages in (x for x in books if x[0] == c):
            removed = K.leading_pages(pages or [], known)
            want.add((c, b, removed, len(known)))
    assert max(w[3] for w in want) == K.FINGERPRINTS
    table = spark.createDataFrame(rng.sample(books, len(books)), K.BOOK).repartition(5)
    assert {tuple(r) for r in M.without_known_pages(table).collect()} == want
    folder = str(tmp_path / "in")
    for part in (books[:30] + books[60:80], books[30:60] + books[80:]):
        spark.createDataFrame(part, K.BOOK).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(K.BOOK).option("maxFilesPerTrigger", 1).parquet(folder)
    out = K.without_known_pages(stream).writeStream.format("memory").queryName("fold_and_stream").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    assert {tuple(r) for r in spark.table("fold_and_stream").collect()} == want


def test_first_pages_and_what_is_kept(spark):
    prints = spark.createDataFrame([("c", 1, p, 700, [1, 2, 3, -4] if p else None, [1, 2, 3, 4]) for p in range(5)], "collection string, book long, page int, aspect int, difference array<long>, average array<long>")
    decisions = spark.createDataFrame([("c", 1, 0, True), ("c", 1, 1, True)], "collection string, book long, page int, confirmed boolean")
    books = M.first_pages(prints, decisions)
    pages = books.first().pages
    assert [p.confirmed for p in pages] == [True, True, False] and pages[0].dhash is None
    assert bytes(pages[1].dhash) == b"".join(x.to_bytes(8, "big", signed=True) for x in (1, 2, 3, -4))
    removed = M.without_known_pages(books)
    assert tuple(removed.first())[2:] == (3, 1)  # the third page is known from the second
    assert sorted(r.page for r in M.kept_pages(prints, removed).collect()) == [3, 4]
    assert M.without_known_pages(books.limit(0)).count() == 0
    assert M.page_decisions(spark.createDataFrame([], LINES), spark.createDataFrame([], HEIGHTS)).where(F.col("confirmed")).count() == 0
