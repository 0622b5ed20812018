"""Memory of known front pages across a stream or a table of books (ST-1, ST-2, HP37).

Books of a collection arrive in order, each with its first pages' fingerprints and what text recognition says of them.
The fold keeps at most `FINGERPRINTS` fingerprints of confirmed pages for each collection, so the state is bounded;
collections are keys of the stream and run side by side.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

# How many fingerprints are remembered, how far a page may be from one, how many pages of a book are looked at.
FINGERPRINTS = 32
ASPECT, DIFFERENCE_BITS, AVERAGE_BITS = 8, 16, 20
MOST_PAGES = 3

PAGE = "struct<aspect: int, dhash: binary, ahash: binary, confirmed: boolean>"
BOOK = f"collection string, book long, pages array<{PAGE}>"
STATE = "aspects array<int>, dhashes array<binary>, ahashes array<binary>"
REMOVED = "collection string, book long, removed int, remembered int"


def _apart(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def is_known(page: tuple, known: list[tuple]) -> bool:
    """Whether a page (aspect, dhash, ahash) is within the limits of a remembered one; a page without a fingerprint isn't."""
    if page[1] is None:
        return False
    return any(abs(page[0] - k[0]) <= ASPECT and _apart(page[1], k[1]) <= DIFFERENCE_BITS and _apart(page[2], k[2]) <= AVERAGE_BITS for k in known)


def leading_pages(pages: list[dict], known: list[tuple]) -> int:
    """How many leading pages of a book go; confirmed ones that are new are added to `known`.

    A page goes if it is known or, else, confirmed; the first other one ends it.  After a run of known pages alone, an unknown
    page ends it without a look at what text recognition says.
    """
    removed, only_known = 0, True
    for p in list(pages)[:MOST_PAGES]:
        page = (p["aspect"], p["dhash"], p["ahash"])
        if not is_known(page, known):
            if removed and only_known or not p["confirmed"]:
                break
            only_known = False
            if page[1] is not None and len(known) < FINGERPRINTS:
                known.append(page)
        removed += 1
    return removed


@udtf(returnType=REMOVED)
class Fold:
    """The fold over a table of books: PARTITION BY collection ORDER BY book. Books stream by, the memory is all it holds."""

    def __init__(self):
        self.known: list[tuple] = []

    def eval(self, row):
        pages = [p.asDict() for p in row["pages"] or []]
        for p in pages:
            p["dhash"], p["ahash"] = (None if p[k] is None else bytes(p[k]) for k in ("dhash", "ahash"))
        removed = leading_pages(pages, self.known)
        yield row["collection"], row["book"], removed, len(self.known)


def without_known_pages(books: DataFrame) -> DataFrame:
    """(collection, book, removed, remembered) for a stream of books as in BOOK; books of a batch are taken by their number."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterable[pd.DataFrame]:
        known = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("book", kind="stable")
        removed, remembered = [], []
        for pages in rows["pages"]:
            removed.append(leading_pages([] if pages is None else pages, known))
            remembered.append(len(known))
        state.update(tuple(list(x) for x in zip(*known, strict=True)) if known else ([], [], []))
        yield pd.DataFrame({"collection": rows["collection"], "book": rows["book"], "removed": pd.Series(removed, index=rows.index, dtype="int32"), "remembered": pd.Series(remembered, index=rows.index, dtype="int32")})

    return books.groupBy("collection").applyInPandasWithState(fold, REMOVED, STATE, "append", "NoTimeout")
