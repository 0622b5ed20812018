"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on a text.  Expectation-maximisation over
the counts of vote patterns (3^labellers at most, whatever the corpus) estimates how each labeller votes on
good and on bad texts, and so each pattern's posterior.  The posteriors of a bounded sample of texts train
a linear scorer over hashed words and word shapes, which then scores every text.

Votes and pattern counts cover all rows; only the scorer's fit uses a sample, of the `sample_rows` rows of least
hash of doc_id and text, and of these in that order as many as have `most_words` words together.  What is broadcast is a table of 2^BITS floats.

Defined cases: a null text counts as an empty one, and a text without words gets posterior and score like
any other (its only feature is the bias); repeated rows get equal results; null doc_ids are rows; an empty
table gives an empty table; other columns are left aside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import map_batches

BITS = 18
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(characters)] = 1
    return out


_ODD, _PAUSE = _flags(SYMBOLS + b"!"), _flags(b".,;:?")
_IS = {"symbols": _flags(SYMBOLS), "bangs": _flags(b"!"), "upper": _flags(bytes(range(0x41, 0x5B))), "lower": _flags(bytes(range(0x61, 0x7B))), "characters": np.r_[np.ones(128, np.int64), np.zeros(64, np.int64), np.ones(64, np.int64)]}


def measurements(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, for each text of a slice."""
    starts, ends, ptr = B.words(data, offsets)
    h = B.hashes(data, starts, ends, B.IDENTITY)
    out = {"words": np.diff(ptr).astype(float)}

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[at]).astype(float)

    for name, table in _IS.items():
        out[name] = per_text(table[data], offsets)
    blank = per_text(B.SPACE[data], offsets)
    out["word_characters"] = out["characters"] - blank
    last = data[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    out["odd_ends"] = per_text(_ODD[last], ptr)
    out["lone_marks"] = per_text(_ODD[last] * (ends - starts == 1), ptr)
    out["pauses"] = per_text(_PAUSE[last], ptr)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    begins = ptr[:-1][np.diff(ptr) > 0]
    same[begins] = 0
    out["repeats"] = per_text(same, ptr)
    runs = same.copy()
    runs[2:] &= same[1:-1] & same[:-2]
    runs[:2] = 0
    out["run_words"] = per_text(runs, ptr)
    of = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)).astype(np.uint64)
    fresh = np.zeros(len(h), np.int64)
    fresh[np.unique(B.mix(h + of * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]] = 1
    out["distinct"] = per_text(fresh, ptr)
    # lines with a word, and those that a text has had before
    l_starts, l_ends, l_ptr = B.spans(data != 0x0A, offsets)
    worded = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(l_ptr))
    lines = B.mix(B.hashes(data, l_starts, l_ends, B.IDENTITY) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.zeros(len(lines), bool)
    first[np.unique(lines, return_index=True)[1]] = True
    out["lines"] = per_text(worded, l_ptr)
    out["old_lines"] = per_text(worded & ~first, l_ptr)
    return out


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def labellers(m: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(votes good, votes bad) of each labeller."""
    n = m["words"]
    symbols, bangs, repeats = _share(m["symbols"], n), _share(m["bangs"], n), _share(m["repeats"], n)
    upper, length = _share(m["upper"], m["upper"] + m["lower"]), _share(m["word_characters"], n)
    odd, pauses = _share(m["odd_ends"], n), _share(m["pauses"], n)
    some = n >= 20
    return {
        "length": (n >= 30, n < 1),
        "symbols": (symbols < 0.02, symbols > 0.1),
        "odd_ends": (odd < 0.02, some & (odd > 0.1)),
        "lone_marks": (m["lone_marks"] == 0, some & (_share(m["lone_marks"], n) > 0.1)),
        "repeated_words": (repeats < 0.03, some & (repeats > 0.1)),
        "word_runs": (m["run_words"] == 0, some & (_share(m["run_words"], n) > 0.05)),
        "variety": (_share(m["distinct"], n) > 0.25, some & (_share(m["distinct"], n) < 0.12)),
        "repeated_lines": (m["old_lines"] == 0, _share(m["old_lines"], m["lines"]) > 0.3),
        "capitals": (upper < 0.2, some & (upper > 0.5)),
        "exclamation": (bangs < 0.05, bangs > 0.3),
        "pauses": ((pauses > 0.03) & (pauses < 0.5), some & ((pauses < 0.005) | (pauses > 0.8))),
        "word_length": ((length > 2.5) & (length < 12), (length < 1.5) | (length > 20)),
    }


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The vote pattern of each text, in base 3: 0 no vote, 1 good, 2 bad."""
    code = np.zeros(len(offsets) - 1, np.int64)
    for k, (good, bad) in enumerate(labellers(measurements(data, offsets)).values()):
        code += 3**k * np.where(bad, 2, np.where(good, 1, 0))
    return code


N_LABELLERS = len(labellers({k: np.zeros(1) for k in (*_IS, "words", "word_characters", "repeats", "lines", "old_lines", "odd_ends", "lone_marks", "pauses", "run_words", "distinct")}))


@dataclass
class LabelModel:
    prior: float  # share of good texts
    good: np.ndarray  # labellers x 3: probabilities of no vote, good, bad on good texts
    bad: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        digits = codes[:, None] // 3 ** np.arange(N_LABELLERS) % 3
        k = np.arange(N_LABELLERS)
        odds = np.log(self.prior / (1 - self.prior)) + (np.log(self.good[k, digits]) - np.log(self.bad[k, digits])).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller, where it votes: the share of right votes."""
        right = self.prior * self.good[:, 1] + (1 - self.prior) * self.bad[:, 2]
        return right / (right + self.prior * self.good[:, 2] + (1 - self.prior) * self.bad[:, 1])


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Fit to pattern counts. The start trusts bad votes, which heuristics seldom give by chance, more than good ones."""
    digits = codes[:, None] // 3 ** np.arange(N_LABELLERS) % 3
    lead = 3.0 - 4.0 * (digits == 2).sum(1)
    weight = 1 / (1 + np.exp(-lead))
    model = None
    for _ in range(rounds):
        shares = []
        for w in (weight, 1 - weight):
            table = np.stack([((digits == v) * (w * counts)[:, None]).sum(0) for v in range(3)], axis=1) + 1.0
            shares.append(table / table.sum(1, keepdims=True))
        prior = ((weight * counts).sum() + 1) / (counts.sum() + 2)
        model = LabelModel(float(prior), *shares)
        new = model.posterior(codes)
        if np.abs(new - weight).max(initial=0) < 1e-9:
            break
        weight = new
    return model


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places (3 x words) of word, word shape and shape pair, and pointers by text."""
    starts, ends, ptr = B.words(data, offsets)
    word = B.hashes(data, starts, ends)
    shape = B.hashes(data, starts, ends, _SHAPE)
    pair = np.zeros_like(shape)
    pair[1:] = np.where(word[1:] == word[:-1], np.uint64(1), shape[1:] * np.uint64(3) + shape[:-1])
    begins = ptr[:-1][np.diff(ptr) > 0]
    pair[begins] = shape[begins] * np.uint64(3)  # a text's features depend on nothing but the text
    salts = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
    return np.stack([(B.mix(h * s) >> np.uint64(64 - BITS)).astype(np.int32) for h, s in zip((word, shape, pair), salts, strict=True)]), ptr


@dataclass
class Scorer:
    table: np.ndarray
    bias: float

    def logits(self, places: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        per_word = sum(self.table[row] for row in places) if places.shape[1] else np.zeros(0)
        sums = np.concatenate([[0.0], np.cumsum(per_word, dtype=np.float64)])
        return self.bias + np.diff(sums[ptr]) / np.maximum(np.diff(ptr), 1)


def train_scorer(places: np.ndarray, ptr: np.ndarray, target: np.ndarray, rounds: int = 60, rate: float = 2.0) -> Scorer:
    """Logistic regression of soft targets on mean feature weights, by full-batch steps with running moments."""
    size = np.diff(ptr)
    text = np.repeat(np.arange(len(size)), size)
    scorer = Scorer(np.zeros(1 << BITS), 0.0)
    m, v = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for t in range(1, rounds + 1):
        miss = target - 1 / (1 + np.exp(-np.clip(scorer.logits(places, ptr), -40, 40)))
        per_word = (miss / np.maximum(size, 1))[text]
        g = np.zeros((1 << BITS) + 1)
        for row in places:
            g[:-1] += np.bincount(row, per_word, 1 << BITS)
        g[-1] = miss.sum()
        g = g / max(1, len(target)) - 1e-6 * np.append(scorer.table, 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        scorer.table += step[:-1]
        scorer.bias += 0.1 * step[-1]
    scorer.table = scorer.table.astype(np.float32)
    return scorer


def vote_table(docs: DataFrame) -> DataFrame:
    """(doc_id, votes) of each row."""

    def run(batches):
        for batch, data, offsets in B.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes(data, offsets))], ["doc_id", "votes"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, votes long")


def fit(docs: DataFrame, sample_rows: int = 5000, most_words: int = 3_000_000) -> tuple[LabelModel, Scorer]:
    """The label model from all rows, and the scorer from the sample_rows of least hash, as far as they have most_words words together."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    patterns = vote_table(rows).groupBy("votes").agg(F.count("*").alias("n")).toPandas()
    codes, counts = patterns["votes"].to_numpy(np.int64), patterns["n"].to_numpy(float)
    model = expectation_maximisation(codes, counts)
    # the sample_rows-th least hash is the bound, whatever the number of rows (rows of an equal hash come along)
    ranked = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    bound = ranked.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    chosen = ranked.where(F.col("h") <= F.lit(bound).cast("long")).orderBy("h", "doc_id", "text").select("doc_id", "text")

    def run(batches):
        for _, data, offsets in B.slices(batches, "text"):
            places, ptr = features(data, offsets)
            good = model.posterior(votes(data, offsets))
            cut = [places[:, a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array(good)], ["places", "good"])

    got, held = [], 0
    for row in map_batches(chosen, run, "places binary, good double").toLocalIterator():
        places = np.frombuffer(row.places, np.int32).reshape(3, -1)
        held += places.shape[1]
        if held > most_words and got:  # long texts aren't passed over in favour of short ones
            break
        got.append((places, row.good))
    if not got:
        return model, Scorer(np.zeros(1 << BITS, np.float32), float(np.log(model.prior / (1 - model.prior))))
    ptr = B.runs_of(np.array([x[0].shape[1] for x in got]))
    return model, train_scorer(np.concatenate([x[0] for x in got], axis=1), ptr, np.array([x[1] for x in got]))


def classify(docs: DataFrame, fitted: tuple[LabelModel, Scorer], threshold: float = 0.5) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of each row's whole text; a row is kept if its score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    names = ["doc_id", "votes", "posterior", "score", "kept"]

    def run(batches):
        model, scorer = shared.value
        for batch, data, offsets in B.slices(batches, "text"):
            code = votes(data, offsets)
            score = 1 / (1 + np.exp(-np.clip(scorer.logits(*features(data, offsets)), -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code), pa.array(model.posterior(code)), pa.array(score), pa.array(score >= threshold)], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, votes long, posterior double, score double, kept boolean")
