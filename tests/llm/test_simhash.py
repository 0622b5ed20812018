"""SimHash groups against a brute force over all pairs."""

import random
import re

import numpy as np
import xxhash

from quire.llm import simhash
from quire.llm._xxh64 import xxh64

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(text, width=4):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(rows, radius=4):
    fps = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows) if d is not None)


def sample(n=150):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
        if i % 3 == 0 and words:
            words[rng.randrange(len(words))] = "Changed"
            rows.append((1000 + i, " ".join(words).upper()))
    return rows + [(2000, None), (2001, ""), (2002, "  \n"), (2003, "One two"), (2004, "one TWO"), (7, rows[3][1]), (7, rows[3][1]), (2005, "x" * 40_000 + " y")]


def test_hash_matches_the_library():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    starts = np.array([rng.randrange(4000) for _ in range(400)])
    ends = starts + np.array([rng.randrange(0, 120) for _ in range(400)])
    assert [int(x) for x in xxh64(np.frombuffer(data, np.uint8), starts, ends, 42)] == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends)]


def test_groups_match_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    found = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == groups(rows)


def test_index_links_like_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = base[rng.integers(0, 40, 3000)]
    for _ in range(3):
        fp ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    fp = np.unique(np.concatenate([fp, base, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    roots = simhash.GrayIndex(np.zeros(len(fp), np.int64), fp, 4).links()
    label = np.arange(len(fp))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    while True:
        new = np.where(near, label[None, :], len(fp)).min(1)
        if (new == label).all():
            break
        label = new
    assert len(set(zip(label.tolist(), roots.tolist()))) == len(set(label.tolist())) == len(set(roots.tolist()))


def test_hot_buckets_are_dealt_again(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) >> 1 for _ in range(100)}
    for x in list(fps)[:60]:
        y = x
        for _ in range(4):
            y ^= 1 << rng.randrange(63)
        fps.add(y)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    linked = {tuple(r) for r in simhash.components(simhash.near_links(frame, bucket=2)).collect()}
    whole = {tuple(r) for r in simhash.components(simhash.near_links(frame)).collect()}
    assert linked == whole and whole


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "c"), (3, "a b"), (3, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str) == sorted([("3", 3), ("3", 3), ("4", 3), ("None", None), ("None", 3)], key=str)
    kept = simhash.keep_one(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "None"] and kept.columns == ["doc_id", "text"]


def test_keep_one_keeps_other_texts_of_a_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in ("a", "b", "c"))
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, a, "x"), (3, c, "x"), (4, c, "x"), (None, c, "x")], "doc_id long, text string, __note string")
    kept = simhash.keep_one(docs)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("1", b), ("3", c)])
    assert kept.columns == ["doc_id", "text", "__note"] and simhash.keep_one(docs.limit(0)).collect() == []


def test_hot_roots_are_named_like_others(spark, monkeypatch):
    rows = [(f, f % 7, 0 if f < 1500 else f) for f in range(2000)]
    placed = spark.createDataFrame(rows, "fp long, least long, root long")
    names = {r.fp: r.name for r in simhash._with_least(placed).collect()}
    assert names == {f: 0 if f < 1500 else f % 7 for f in range(2000)}
