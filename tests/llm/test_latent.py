"""Latent search against brute force: the subsequence, the candidates' recall, and planted leaks."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quire.llm import _bytes as B
from quire.llm import latent as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 90))]
        b = [rng.randrange(8) for _ in range(rng.randint(0, 120))]
        assert L.common_subsequence(L._masks(np.array(a)), len(a), b) == lcs(a, b)


def material(seed=5, n=240):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    rare = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]

    def prose(k):
        return [rng.choice(common) if rng.random() < 0.35 else rng.choice(rare) for _ in range(k)]

    items = [prose(rng.randint(8, 60)) for _ in range(60)]
    docs, truth = [], set()
    for i in range(n):
        words = prose(rng.randint(0, 400))
        if i % 3 == 0:
            j = rng.randrange(len(items))
            copy = list(items[j])
            if i % 2:  # a paraphrase: a fifth of the words before the answer replaced
                for k in range(0, len(copy) - 5, 5):
                    copy[k] = rng.choice(rare)
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if i % 4 == 0 else w + rng.choice(["", ",", "."]) for w in copy]
            truth.add((i, j))
        docs.append((i, " ".join(words)))
    return docs, [(j, " ".join(x)) for j, x in enumerate(items)], truth


def test_leaks_and_defined_cases(spark):
    docs, items, truth = material()
    extra = [(1000, None), (1001, ""), (None, items[3][1]), (7, docs[7][1]), (0, docs[0][1]), (1002, "word " * 60_000 + items[5][1])]
    frame = spark.createDataFrame([(d, t, "c") for d, t in docs + extra], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items + [(900, None), (901, "the of"), (None, items[4][1])], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in L.leaks(frame, bench).collect()]
    pairs = {(d, i) for d, i in found if i is not None}
    assert pairs == truth | {(None, 3), (1002, 5)}
    assert sum(p == next(x for x in truth if x[0] == 0) for p in found) == 2
    assert {d for d, i in found if i is None} == {d for d, i in truth if i == 4}
    kept = L.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(d) for d, _ in docs + extra if d is not None and d != 1002 and d not in {x for x, _ in truth}])
    assert L.leaks(frame.limit(0), bench).collect() == [] and L.leaks(frame, bench.limit(0)).collect() == []
    assert L.decontaminate(frame, bench.limit(0)).count() == frame.count()


def test_candidate_recall_against_brute_force(spark):
    """Cosines of the TF-IDF rows themselves, for the same windows, give the candidates that a space of half the rank must find."""
    docs, items, _ = material(9, 120)
    data, offsets = B.buffers(pa.array([t for _, t in docs]))
    h, ptr = L._words(data, offsets)
    rng = np.random.default_rng(0)
    idf = rng.uniform(0.1, 5, 1 << L.FEATURE_BITS)
    space = L.latent_space(spark.createDataFrame(items, "item_id long, text string").repartition(3), idf)
    assert space[1].shape[1] == len(items) // 2
    block = L.Block([i for i, _ in items], [t for _, t in items], idf, space)
    search = L.Search([block], idf, 0.3, 0.7, 0.5, 5)
    search._sharing = lambda *_: np.zeros(0, np.int64)  # the latent candidates alone
    got = {(int(a), int(i)) for _, begin, _, item, _, _ in search.candidates(h, ptr) for a, i in zip(begin, item)}
    f = L._feature(h)
    want = set()
    queries = []
    for words in block.words:
        q = np.zeros(1 << L.FEATURE_BITS)
        np.add.at(q, L._feature(words), idf[L._feature(words)])
        queries.append(q / np.linalg.norm(q))
    for t in range(len(ptr) - 1):
        for a in range(ptr[t], ptr[t + 1], L.RUN):
            for i, q in enumerate(queries):
                window = f[a : min(a + int(block.runs[i]) * L.RUN, ptr[t + 1])]
                if (idf[window] * q[window]).sum() / np.sqrt((idf[window] ** 2).sum()) >= 0.3:
                    want.add((int(a), i))
    assert len(want) > 50 and len(want & got) >= 0.9 * len(want), (len(want), len(got), len(want & got))


def skewed(seed=21):
    """Prose of very frequent words and of names that are nowhere else, with items kept by a part of their words."""
    rng = random.Random(seed)
    frequent = [f"w{k}" for k in range(40)]
    name = lambda: "".join(rng.choice("bcdfghklm") for _ in range(9))
    common = lambda: frequent[min(39, int(rng.paretovariate(0.7)) - 1)]
    items = [[common() if rng.random() < share else name() for _ in range(size)] for size in (8, 17, 17, 30, 48, 70) for share in (0.2, 0.6, 1.0)]
    docs = []
    for i in range(150):
        words = [name() if rng.random() < (i % 3) / 2 else common() for _ in range(rng.randint(0, 300))]
        if i % 2:
            item = rng.choice(items)
            body = [w if rng.random() < 0.6 else name() for w in item[:-5]]
            at = rng.randint(0, len(words))
            words[at:at] = body + item[-5:]
        docs.append((i, " ".join(words)))
    return docs, [(j, " ".join(x)) for j, x in enumerate(items)]


def test_leaks_are_those_of_all_windows(spark):
    """leaks() against the checks of every window and item; many leaks are far below the least cosine."""
    docs, items = skewed()
    held = Counter(w for _, text in docs for w in set(text.split()))
    weighs = [Counter(w for w in item.split() if held[w] <= L.too_common(len(docs))) for _, item in items]
    plain = [sum(w.values()) < L.LEAST_INFORMATIVE for w in weighs]
    want, unfiltered = set(), set()
    for d, text in docs:
        words = text.split()
        for j, item in items:
            own, runs = item.split(), -(-len(item.split()) // L.RUN) + 1
            for a in range(0, len(words), L.RUN):
                window = words[max(0, a - L.RUN) : a + (runs + 1) * L.RUN]
                common = lcs(own, window)
                core = Counter(words[a : a + runs * L.RUN])
                leaked = common >= 0.7 * len(own) or (common >= 0.5 * len(own) and lcs(own[-5:], window) >= 4)
                if leaked:
                    unfiltered.add((d, j))
                span = int(L.COMPACT * len(own))
                compact = common >= 0.7 * len(own) and any(lcs(own, window[k : k + span]) >= 0.7 * len(own) for k in range(max(1, len(window) - span + 1)))
                if not compact and not plain[j] and sum((core & weighs[j]).values()) < max(L.FEWEST_WEIGHING, L.LEAST_WEIGHING * sum(weighs[j].values())):
                    continue
                if common >= 0.7 * len(own) or (common >= 0.5 * len(own) and lcs(own[-5:], window) >= 4):
                    want.add((d, j))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = L.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want) > 60
    assert sum(r.cosine < 0.3 for r in found) > 5
    # items of these docs that were put in are found; what the rule of weighing words leaves out is chance
    assert want <= unfiltered


def test_a_copy_without_its_rare_words_is_a_leak(spark):
    """24 of 31 words in order, the seven others being the item's rare ones; the same words strewn over a text are none."""
    rng = random.Random(12)
    common = [f"w{k}" for k in range(30)]
    item = [rng.choice(common) for _ in range(31)]
    rare = sorted(rng.sample(range(31), 7))
    body = [w for k, w in enumerate(item) if k not in rare]
    for k in rare:
        item[k] = f"rare{k}"
    prose = lambda n: [rng.choice(common) for _ in range(n)]
    docs = [(k, " ".join(prose(120))) for k in range(120)]
    docs.append((500, " ".join([*prose(40), *body, *prose(40)])))
    strewn = [x for w in body for x in (w, f"other{rng.random()}")]
    docs.append((501, " ".join([*prose(10), *strewn, *prose(10)])))
    found = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.common_words) for r in found] == [(500, 24)]


def test_distributed_svd_spans_the_leading_singular_vectors(spark):
    """Against a dense SVD of the same matrix, whose spectrum falls after ten topics."""
    rng = random.Random(3)
    topics = [["".join(rng.choice("abcdefghijklm") for _ in range(8)) for _ in range(12)] for _ in range(10)]
    texts = [" ".join(rng.choices(rng.choice(topics), k=30)) for _ in range(80)]
    idf = np.ones(1 << L.FEATURE_BITS)
    places, basis = L.latent_space(spark.createDataFrame(enumerate(texts), "item_id long, text string").repartition(4), idf, most=10)
    dense = np.zeros((len(texts), 1 << L.FEATURE_BITS))
    row, feature, value = L._matrix(pa.array(texts), idf)
    np.add.at(dense, (row, feature), value)
    _, size, right = np.linalg.svd(dense[:, places], full_matrices=False)
    assert basis.shape == (len(places), 10) and np.allclose(basis.T @ basis, np.eye(10), atol=1e-8)
    kept = np.linalg.norm(dense[:, places] @ basis) ** 2
    assert kept >= 0.999 * (size[:10] ** 2).sum()


def test_short_items_are_found_word_for_word(spark):
    docs, _, _ = material(4, 60)
    question = "who wrote zanzibar quixote novel yesterday evening"
    rows = docs + [(500, docs[1][1] + " " + question + " " + docs[2][1]), (501, "who wrote the zanzibar quixote novel of yesterday evening"), (502, question.upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, question), (2, "the of and"), (3, "quixote"), (4, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(frame, bench).collect()) == [(500, 1), (502, 1)]
