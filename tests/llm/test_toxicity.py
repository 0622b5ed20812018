"""The chain against enumeration of all taggings, and the scores on held-out rows."""

import itertools
import random

import numpy as np

from quire.llm import toxicity as T


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 2, 5, 7, 3]
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    e, moves = rng.normal(size=len(first)) * 2, rng.normal(size=(2, 2))
    logit, pairs = T.forward_backward(e, first, moves)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, mass, moved = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[at + i] * t for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            mass += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                moved[a, b] += w
        want += list(mass / total)
        want_pairs += moved / total
        at += n
    assert np.allclose(1 / (1 + np.exp(-logit)), want) and np.allclose(pairs, want_pairs)


def corpus(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad = ["vilez", "scumz", "idiotz"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(text) + "\nend of text", int(toxic)))
    return rows


def test_held_out_scores_spans_and_defined_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels, T.not_in_fold)
    truth = {i: y for i, _, y in rows}
    import zlib

    found = T.score(docs, model).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)
    text = dict((i, t) for i, t, _ in rows)
    for r in held:
        for s in r.spans:
            assert text[r.doc_id].encode()[s.start : s.end].decode() in {"vilez", "scumz", "idiotz"}
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, ""), (5, "vilez " * 20_000), (6, "VILEZ idiotz")], "doc_id long, text string")
    got = [(r.doc_id, r.score) for r in T.score(odd, model).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[1] == by[2] < 0.5 < by[5] and by[6] > 0.5
    kept = T.reject(docs.withColumn("n_chars", docs.doc_id), model)
    assert kept.columns == ["doc_id", "text", "score", "n_chars"] and kept.count() == 300


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.score(docs, T.fit(docs, none, T.not_in_fold)).collect()] == [0.0]
    assert T.score(docs.limit(0), T.fit(docs.limit(0), none, T.not_in_fold)).collect() == []


def test_scores_are_the_logistic_of_enumerated_taggings(spark):
    """A fitted model's scores and spans against all taggings of each line, weighed by the model's own numbers."""
    rows = corpus(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), T.not_in_fold)
    texts = ["vilez ab", "ab cd ef\nscumz idiotz", "", "abc", "Vilez, gh-ab scumz"]
    found = {r.doc_id: r for r in T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _, own, first = T.tokens(data, np.array([0, len(data)]))
        marginals = np.zeros(len(starts))
        if len(starts):
            e = model.emissions(T.features(own, first)).astype(float)
            for a, b in zip(np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(first))):
                total = 0.0
                for tags in itertools.product((0, 1), repeat=int(b - a)):
                    w = np.exp(sum(e[a + k] * t for k, t in enumerate(tags)) + sum(model.moves[p, q] for p, q in zip(tags, tags[1:])))
                    total += w
                    marginals[a:b] += w * np.array(tags)
                marginals[a:b] /= total
        x = np.array([1.0, np.log1p(marginals.sum()), marginals.max(initial=0.0)])
        assert np.isclose(found[i].score, 1 / (1 + np.exp(-(x @ model.doc))), atol=1e-5)
        assert [(s.start, s.end) for s in found[i].spans] == [(a, b) for a, b, m in zip(starts, ends, marginals) if m > 0.5]


def test_ties_at_the_threshold_are_rejected(spark):
    model = T.Model(np.zeros(1 << T.BITS, np.float32), -20.0, np.zeros((2, 2)), np.zeros(3), 0.5)
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [r.score for r in T.score(docs, model).collect()] == [0.5, 0.5] and T.reject(docs, model).count() == 0


def test_the_chain_holds_little_beside_its_tokens():
    """Fitting runs on the driver: what a step holds for its lines at once is bounded, whatever the number of tokens."""
    import tracemalloc

    n = 1 << 20
    e, first, moves = np.linspace(-2, 2, n), np.arange(n) % 8 == 0, np.zeros((2, 2))
    tracemalloc.start()
    logit, pairs = T.forward_backward(e, first, moves)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20, peak
    assert np.allclose(logit, e) and np.isclose(pairs.sum(), n * 7 / 8)  # without weights of changes each token is on its own
