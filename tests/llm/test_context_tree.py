"""The tree and the scores against a plain recursion, the base against plain counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm import context_tree as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def decisions(symbol):
    """(place, bit) of the end decision, then of the bits of a byte."""
    out = [(0, int(symbol is None))]
    if symbol is not None:
        out += [(1 << k | symbol >> (8 - k), symbol >> (7 - k) & 1) for k in range(8)]
    return out


def events(text):
    """(context, symbol) of each byte and the end."""
    b = bytes(T.DEPTH) + (text or "").encode()
    return [(b[i - T.DEPTH : i], b[i] if i < len(b) else None) for i in range(T.DEPTH, len(b) + 1)]


def plain_model(texts):
    """(depth, context bytes, place) -> (zeros, ones, weight), from the definition."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        for context, symbol in events(t):
            for place, bit in decisions(symbol):
                for d in range(T.DEPTH + 1):
                    counts[d, context[T.DEPTH - d :], place][bit] += 1
    log_kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
    below, own = defaultdict(float), {}
    for d in range(T.DEPTH, -1, -1):
        for (depth, context, place), (z, o) in list(counts.items()):
            if depth == d:
                e = log_kt(z, o)
                w = e if d == T.DEPTH else math.log(0.5) + np.logaddexp(e, below[d, context, place])
                own[d, context, place] = 1.0 if d == T.DEPTH else math.exp(math.log(0.5) + e - w)
                if d:
                    below[d - 1, context[1:], place] += w
    return {k: (z, o, own[k]) for k, (z, o) in counts.items()}


def plain_chance(model, context, symbol):
    out = 1.0
    for place, bit in decisions(symbol):
        chance = None
        for d in range(T.DEPTH, -1, -1):
            if (found := model.get((d, context[T.DEPTH - d :], place))) is not None:
                z, o, own = found
                p = ((o if bit else z) + 0.5) / (z + o + 1)
                chance = p if chance is None else own * p + (1 - own) * chance
        out *= 0.5 if chance is None else chance
    return out


def plain_score(model, text):
    return sum(math.log10(plain_chance(model, c, x)) for c, x in events(text))


def corpus():
    rng = random.Random(2)
    words = ["the", "The", "of", "naïve", "漢字", "x1", "<a>"] + ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(30)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (None, "the of"), (5, rows[5][1]), (102, "the " * 9000)]


def test_scores_match_plain_recursion(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 4000)
    rows = corpus()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [t or "" for d, t in rows if not held(d)]
    model = plain_model(train)
    c = Counter()
    for t in train:
        c.update([*WORD.findall(t.translate(LOWER)), None])
    n, v = sum(c.values()), len(c)
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, block string, train int")
    found = T.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in rows)
    text = dict(rows)
    for r in found:
        w = [*WORD.findall((text[r.doc_id] or "").translate(LOWER)), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, plain_score(model, text[r.doc_id]), rel_tol=1e-6), r.doc_id


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab c")], "doc_id long, text string")
    (r,) = T.score(docs, F.lit(True)).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and math.isclose(r.score, -37 * math.log10(2), rel_tol=1e-6)
    assert T.score(docs.limit(0), F.lit(False)).collect() == []


def test_chances_of_all_symbols_add_up_to_one():
    texts = ["aba", "abab", "", "ba", "naïve"]
    model = plain_model(texts)
    for context in (bytes(T.DEPTH), b"\0\0\0ab"[-T.DEPTH :].rjust(T.DEPTH, b"\0"), b"zzzzz"[: T.DEPTH].rjust(T.DEPTH, b"z")):
        assert math.isclose(sum(plain_chance(model, context, x) for x in [None, *range(256)]), 1.0, rel_tol=1e-9)
    # of texts over an alphabet that leaves nothing else to the model, by length: ends and longer ones share what the shorter ones leave
    chance = {(): 1.0}
    ended, alive = 0.0, [(b"", 1.0)]
    for _ in range(3):
        following = []
        for b, p in alive:
            context = (bytes(T.DEPTH) + b)[-T.DEPTH :]
            ended += p * plain_chance(model, context, None)
            following += [(b + bytes([x]), p * plain_chance(model, context, x)) for x in b"ab"]
            ended += sum(p * plain_chance(model, context, x) for x in range(256) if x not in b"ab")  # the tail
        alive = following
    assert chance and math.isclose(ended + sum(p for _, p in alive), 1.0, rel_tol=1e-9)


def test_large_counts_leave_the_rare_bit_its_chance(spark):
    n = 20_000_000
    node = (ord("a") << 8 | ord("a")) << 8 | 1  # any place with a context of two bytes
    parts = spark.createDataFrame([(0, node, n, 0, float(T.log_estimate(float(n), 0.0)))], "bucket long, node long, zeros long, ones long, children double")
    (r,) = T.descend([x.read() for x in T.tree(parts)]).collect()
    assert math.isclose(r.ends_1, 0.5 / (n + 1), rel_tol=1e-6) and r.ends_0 < 1 and math.isclose(r.ends_0 + r.ends_1, 1.0)
    assert math.isclose(T.log_estimate(np.array([n]), np.array([3]))[0], math.lgamma(n + 0.5) + math.lgamma(3.5) - math.log(math.pi) - math.lgamma(n + 4), abs_tol=1e-5)  # of terms about 3e8


def test_counter_and_sequences_are_exact():
    rng = np.random.default_rng(4)
    counter, seen = T.Counter(4), Counter()
    for _ in range(5):
        keys = rng.integers(0, 60, 500).astype(np.uint64)
        amounts = rng.integers(0, 2, 500)
        counter.add(keys, amounts)
        seen.update({k: 0 for k in keys.tolist()})
        for k, a in zip(keys.tolist(), amounts.tolist()):
            seen[k] += a
    keys, counts = counter.items()
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(seen)
    assert T.unpack(T.pack(keys)).tolist() == keys.tolist() and T.Lookup(keys, counts)(keys[::-1]).tolist() == counts[::-1].tolist()
    texts = ["", "ab", "cdefgh", "x"]
    for window in (3, 100):
        got = [x for keys, _ in T.sequences(*B.buffers(pa.array(texts)), window=window) for x in keys.tolist()]
        want = [int.from_bytes(c, "big") << 9 | (256 if x is None else x) for t in texts for c, x in events(t)]
        assert got == want
