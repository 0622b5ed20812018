"""Page filters: junk words, tails, leading runs, thresholds. Predicates are columns, so Catalyst pushes and fuses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import constants as K
from quire.functions.text import letters_key


def holds_any(value: Column, words) -> Column:
    """True if the value, but for case, contains one of the words; null is false (FI1, FI2)."""
    low = F.lower(value)
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(False))


def junk_page(name: Column, content: Column, name_words=K.JUNK_NAMES, content_words=K.JUNK_CONTENTS) -> Column:
    return holds_any(name, name_words) | holds_any(content, content_words)


def tail_junk(df: DataFrame, book: str, pos: str, content: str, words=K.JUNK_TAIL, out: str = "tail_junk") -> DataFrame:
    """Flags the last page of each book if it holds a tail word (FI3); the last place is one aggregate a book, joined back."""
    last = df.groupBy(book).agg(F.max(pos).alias("__last"))
    return df.join(last, book).withColumn(out, (F.col(pos) == F.col("__last")) & holds_any(F.col(content), words)).drop("__last")


def is_image(name: Column, extensions=K.PAGE_IMAGES) -> Column:
    """By the extension, but for case (FI5)."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1)).isin(*extensions)


def is_markup(name: Column) -> Column:
    return is_image(name, (".html", ".htm", ".xhtml"))


def drop_leading_run(df: DataFrame, book: str, pos: str, hit: Column, most: int = 3) -> DataFrame:
    """Drops the pages before the first one that isn't a hit, `most` at most; places count from 1 (FI18)."""
    first = Window.partitionBy(book)
    miss = F.min(F.when(hit, None).otherwise(F.col(pos))).over(first)
    return df.withColumn("__stop", F.least(F.coalesce(miss, F.lit(most + 1)), F.lit(most + 1))).where(F.col(pos) >= F.col("__stop")).drop("__stop")


def garbage_reason(size: Column, s: Column) -> Column:
    """Why a page image is garbage, or null: `s` is the statistics struct of functions.images.page_stats (FI6)."""
    blank = (s["white_ratio"] > 0.995) & (size < K.GARBAGE_BYTES_SMALL) & (s["edge_ratio"] < 0.002)
    faint = (s["white_ratio"] >= 0.985) & (s["edge_ratio"] < 0.007) & (s["value_mean"] > 252) & (s["gray_std"] < 22) & (s["black_ratio"] < 0.003) & (1 - s["white_ratio"] <= 0.018)
    return F.when(size < K.GARBAGE_BYTES, F.when(blank, "blank").when(faint, "faint"))


def colour_page(s: Column, least: float = 5.0) -> Column:
    """A page in colour, by its mean saturation (FI10)."""
    return F.coalesce(s["saturation_mean"] >= least, F.lit(False))


def protected_page(s: Column) -> Column:
    """Text or catalogue pages, which cover dedup leaves alone (FI9)."""
    return (s["white_ratio"] < 0.96) | (s["black_ratio"] >= 0.008) | (s["edge_ratio"] >= 0.012) | (s["gray_std"] >= 28)


def category_hits(text: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    """The names of the categories of which the text holds a word, in the given order (AG10)."""
    table = F.array(*[F.when(holds_any(text, words), F.lit(name)) for name, words in categories.items()])
    return F.filter(table, lambda c: c.isNotNull())


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1)), r"(?<=.)\.[^.]*$", "")


def cover_name(path: Column) -> Column:
    """A markup file that is named like a cover (FI4)."""
    return holds_any(F.regexp_extract(path, r"([^/\\]*)$", 1), K.COVER_NAMES)


def protected_name(path: Column) -> Column:
    """Names of pages that aren't split: one of the list, alone or after _ or - (FI11)."""
    return F.coalesce(_stem(path).rlike("(^|[_-])(" + "|".join(K.PROTECTED_NAMES) + ")$"), F.lit(False))


def same_rectangle(a: list[Column], b: list[Column], tolerance: float = 0.1) -> Column:
    """Rectangles whose four numbers differ by `tolerance` at most (FI14)."""
    near = F.lit(True)
    for x, y in zip(a, b, strict=True):
        near = near & (F.abs(x - y) <= tolerance)
    return F.coalesce(near, F.lit(False))


def double_page(width: Column, height: Column, least: float = 1.35) -> Column:
    """A picture as wide as two pages (FI19)."""
    return F.coalesce((height > 0) & (width / height >= least), F.lit(False))


def title_high(title: Column, lines: Column, height: Column, most: float = 0.55) -> Column:
    """Whether a line (text, and the mean height `y` of its box's corners) that holds the title is in the page's upper part (FI17)."""
    key = letters_key(title)
    return F.coalesce(F.exists(lines, lambda x: F.contains(letters_key(x["text"]), key) & (x["y"] / F.greatest(height, F.lit(1)) <= most)), F.lit(False))


def entry_rank(name: Column) -> Column:
    """Preference among metadata entries: exact root, root but for case, nested; null for others (FI7, FI8)."""
    plain = F.translate(name, "\\", "/")
    return F.when(plain == "ComicInfo.xml", 0).when(F.lower(plain) == "comicinfo.xml", 1).when(F.lower(plain).rlike(r"(^|/)comicinfo\.xml$"), 2)
