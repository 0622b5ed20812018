"""Collocations against a plain count over all phrases, with exact integers."""

import random
from collections import Counter

import pytest

from quire.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, most=2000):
    import re

    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= 10}
    out = []
    for p, a in candidates.items():
        inside = (q for q in candidates if q[0] == p[0] and len(q) > len(p) and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q))))
        if any(100 * candidates[q] >= 50 * a for q in inside):
            continue
        cuts = []
        for k in range(2, len(p)):
            left, right = f[p[:k]], f[(p[0], *p[k:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, left, right, n[p[0]], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own[:most], 1)]
    return sorted(ranked)


def _rows():
    r = random.Random(3)
    words = ["ab", "Ab", "cd", "ef", "gh", "ij", "é", "日本", "x y", "q\x1cq"]
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("New York City! " * 30, "en"), ("new  york\tCITY, new york state", "en"), ("a b " * 5000, "fr"), ("loner", "xx"), ("in und drin " * 9, "und"), ("In Und drin", None)]
    rows += [(" ".join(r.choices(words, [9, 3, 5, 4, 3, 2, 2, 1, 1, 1], k=60)) + r.choice(".,;:!?\n\r\x0b\x0c") + "tail", r.choice(["en", "fr", None, ""])) for _ in range(60)]
    return rows + rows[:12]


@pytest.mark.parametrize(("memory", "gathered"), [("256MB", 1 << 23), ("16MB", 50)])
def test_equals_a_plain_count(spark, monkeypatch, memory, gathered):
    monkeypatch.setattr(collocations, "MEMORY", memory)
    monkeypatch.setattr(collocations, "GATHERED", gathered)
    rows = _rows()
    docs = spark.createDataFrame([(t, lang, "clash", 1) for t, lang in rows], "text string, lang string, piece string, n int").repartition(3)
    found = collocations.top(docs)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_ties_are_cut_by_phrase(spark):
    rows = [(f"{w} z{w}.", "en") for w in ("b", "a", "c") for _ in range(10)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert [tuple(x)[:3] for x in collocations.top(docs, 2).orderBy("rank").collect()] == [("en", 1, "a za"), ("en", 2, "b zb")]
    assert brute(rows, 2) == sorted(map(tuple, collocations.top(docs, 2).collect()))


def test_products_beyond_64_bits_are_exact(spark):
    a, left, right = 3_000_000_007, 3_000_000_019, 3_000_000_037
    candidates = spark.createDataFrame([("en", "x y", a, 2)], "lang string, phrase string, a long, size int")
    words = spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, phrase string, n long")
    assert collocations._scored(candidates, [words, words.limit(0), words.limit(0)]).collect()[0].score == 10**6 * a * a // (left * right)


def test_empty_table(spark):
    assert collocations.top(spark.createDataFrame([], "text string, lang string")).count() == 0
