"""The label model recovers known accuracies, and the scorer separates planted junk."""

import random

import numpy as np
import pyarrow as pa

from quire.llm import _bytes as B
from quire.llm import weak as W


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    n, k = 40_000, W.N_LABELLERS
    good = rng.random(n) < 0.8
    right = rng.uniform(0.8, 0.97, k)
    digits = np.zeros((n, k), int)
    for j in range(k):
        hit = rng.random(n) < right[j]
        digits[:, j] = np.where(rng.random(n) < 0.2, 0, np.where(hit == good, 1, 2))
    codes, counts = np.unique((digits * 3 ** np.arange(k)).sum(1), return_counts=True)
    model = W.expectation_maximisation(codes, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02 and np.abs(model.accuracies() - right).max() < 0.02
    assert ((model.posterior((digits * 3 ** np.arange(k)).sum(1)) > 0.5) == good).mean() > 0.99


def test_measurements_match_plain_python():
    texts = ["", "a a a a b", "One two!\nOne two!\nthree, FOUR.", "x# | y% é\n\n  \n", "Der Der Der Der Der Der zwei."]
    m = W.measurements(*B.buffers(pa.array(texts)))
    assert m["words"].tolist() == [0, 5, 6, 4, 7] and m["repeats"].tolist() == [0, 3, 0, 0, 5] and m["run_words"].tolist() == [0, 1, 0, 0, 3]
    assert m["symbols"].tolist() == [0, 0, 0, 3, 0] and m["old_lines"].tolist() == [0, 0, 1, 0, 0] and m["lines"].tolist() == [0, 1, 3, 1, 1]
    assert m["distinct"].tolist() == [0, 2, 4, 4, 2] and m["word_characters"].tolist() == [len("".join(t.split())) for t in texts]
    assert m["odd_ends"].tolist() == [0, 0, 2, 3, 0] and m["lone_marks"].tolist() == [0, 0, 0, 1, 0] and m["pauses"].tolist() == [0, 0, 2, 0, 1]


def corpus(n=600):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(30, 90))]
        kind = i % 10
        if kind == 0:
            text = [w + "##" for w in text]
        elif kind == 1:
            text = [w for w in text[:6] for _ in range(12)]
        elif kind == 2:
            text = [w.strip(",.").upper() + "!!" for w in text]
        rows.append((i, " ".join(text), kind < 3))
    return rows


def test_scores_and_defined_cases(spark):
    rows = corpus()
    extra = [(1000, None), (1001, ""), (None, rows[5][1]), (3, rows[3][1]), (1002, "word, and more. " * 20_000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(*r, "c") for r in extra], "doc_id long, text string, score string")
    found = W.classify(docs, W.fit(docs, 300)).collect()
    assert len(found) == len(rows) + len(extra)
    junk = {i: j for i, _, j in rows}
    wrong = [r for r in found if r.doc_id in junk and r.kept == junk[r.doc_id]]
    assert len(wrong) <= 6, wrong[:5]
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in found)
    empty = docs.limit(0)
    assert W.classify(empty, W.fit(empty)).collect() == []


def test_em_and_posterior_match_plain_bayes():
    """One round of expectation-maximisation, and the posterior, against loops over texts and labellers."""
    rng = np.random.default_rng(8)
    k = W.N_LABELLERS
    digits = rng.integers(0, 3, (60, k))
    codes = (digits * 3 ** np.arange(k)).sum(1)
    names, counts = np.unique(codes, return_counts=True)
    model = W.expectation_maximisation(names, counts.astype(float), rounds=1)
    lead = [1 / (1 + np.exp(-(3.0 - 4.0 * sum(v == 2 for v in row)))) for row in digits]
    for j in range(k):
        for v in range(3):
            good = 1 + sum(w for w, row in zip(lead, digits) if row[j] == v)
            bad = 1 + sum(1 - w for w, row in zip(lead, digits) if row[j] == v)
            assert np.isclose(model.good[j, v], good / (3 + sum(lead))) and np.isclose(model.bad[j, v], bad / (3 + sum(1 - w for w in lead)))
    assert np.isclose(model.prior, (sum(lead) + 1) / (len(lead) + 2))
    for code, row in zip(codes[:20], digits[:20]):
        a, b = model.prior, 1 - model.prior
        for j in range(k):
            a, b = a * model.good[j, row[j]], b * model.bad[j, row[j]]
        assert np.isclose(model.posterior(np.array([code]))[0], a / (a + b))


def test_scorer_is_a_mean_of_weights_and_ties_are_kept(spark):
    scorer = W.Scorer(np.random.default_rng(1).normal(size=1 << W.BITS).astype(np.float32), 0.25)
    data, offsets = B.buffers(pa.array(["a b c", "", "Ab! 1"]))
    places, ptr = W.features(data, offsets)
    for i in range(3):
        own = [sum(float(scorer.table[p]) for p in places[:, j]) for j in range(ptr[i], ptr[i + 1])]
        assert np.isclose(scorer.logits(places, ptr)[i], 0.25 + (sum(own) / len(own) if own else 0), atol=1e-5)
    k = W.N_LABELLERS
    even = (W.LabelModel(0.5, np.full((k, 3), 1 / 3), np.full((k, 3), 1 / 3)), W.Scorer(np.zeros(1 << W.BITS, np.float32), 0.0))
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [(r.score, r.kept) for r in W.classify(docs, even).collect()] == [(0.5, True), (0.5, True)]


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    alone = W.features(*B.buffers(pa.array(["a b c"])))[0]
    places, ptr = W.features(*B.buffers(pa.array(["x y", "a b c", "c"])))
    assert (places[:, ptr[1] : ptr[2]] == alone).all()
