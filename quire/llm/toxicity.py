"""Toxic spans from a linear-chain conditional random field, summed up to document scores.

Labels are given for documents, so token labels are derived first: in toxic documents of the training
sample, a token is toxic if its word or a leading piece of it is found in toxic documents far more often
than chance allows (log-likelihood ratio of document counts).  A two-state chain is fitted to the tokens
of each line by forward-backward gradients.  A document's score is a logistic function of what the
marginals of its tokens add up to, fitted on the same sample with the true class shares.

The sample is bounded by parameters: the token labels come from `toxic_rows` (6,000) and `clean_rows` (12,000)
labelled rows of least hash of their doc_id, and `most_pieces` (20,000) words and pieces of these at most; the chain
and the logistic function are fitted to `chain_rows` (1,500) of these texts of each class, of least hash, as far as
they have `most_tokens` (1,500,000) tokens together.  The model is a weight table of a fixed size
(2^BITS floats), so broadcasting it doesn't grow with the data.  Scoring reads whole texts, and a text's
score depends on nothing but the text.

Defined cases: a null, empty or word-less text scores what the logistic function gives no tokens; repeated
rows get equal scores; labels that are null or whose doc_id is null are not used; several labels of one
doc_id count as toxic if one does; with no usable labels of both classes every score is the share of toxic
labels (0 if there are none); an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import checkpoint, give_back, map_batches

BITS = 22
PIECES = (6, 8)
#: A token ends at anything but ASCII letters and digits and bytes of other characters.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and text pointers of the tokens, the hashes of word and leading pieces, and whether a token begins a line."""
    starts, ends, ptr = B.spans(INSIDE[data], offsets)
    hasher = B.Hasher(data)
    own = [hasher.of(starts, ends), *(hasher.of(starts, np.minimum(starts + k, ends)) for k in PIECES)]
    first = np.zeros(len(starts), bool)
    if len(starts):
        breaks = np.flatnonzero(data == 0x0A)
        line = np.searchsorted(breaks, starts)
        first[1:] = line[1:] != line[:-1]
        first[ptr[:-1][np.diff(ptr) > 0]] = True
    return starts, ends, ptr, own, first


def features(own: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Table places of each token's features: word, leading pieces, and the words before and after in the line."""
    word = own[0]
    before, after = np.ones_like(word), np.ones_like(word)
    before[1:] = np.where(first[1:], np.uint64(1), word[:-1])
    after[:-1] = np.where(first[1:], np.uint64(1), word[1:])
    shift = np.uint64(64 - BITS)
    return np.stack([(B.mix(h * salt) >> shift).astype(np.int32) for h, salt in zip([*own, before, after], _SALTS, strict=True)])


@dataclass
class Model:
    table: np.ndarray  # float32 weights of the toxic state by feature
    bias: float
    moves: np.ndarray  # 2 x 2 log weights of state changes
    doc: np.ndarray  # weights of document features
    share: float  # of toxic labels, where nothing could be fitted

    def emissions(self, places: np.ndarray) -> np.ndarray:
        out = np.full(places.shape[1], self.bias, np.float32)
        for row in places:
            out += self.table[row]
        return out


def _by_length(first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lines in classes of like length: (first tokens, lengths), so that little padding is needed."""
    at = np.flatnonzero(first)
    sizes = np.diff(np.append(at, len(first)))
    classes = np.ceil(np.log2(np.maximum(sizes, 1)) * 2).astype(int)
    return [(at[classes == c], sizes[classes == c]) for c in np.unique(classes)]


def forward_backward(e: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the toxic state for each token, and the expected counts of the four state changes."""
    logit = np.zeros(len(e))
    pairs = np.zeros((2, 2))
    m = np.exp(moves)
    for at, sizes in _by_length(first):
        n, longest = len(at), int(sizes.max())
        step = max(1, (1 << 17) // longest)  # some twenty arrays of so many numbers at once, on the driver too
        for k in range(0, n, step):
            a, s = at[k : k + step], sizes[k : k + step]
            index = a[None, :] + np.arange(longest)[:, None]
            valid = np.arange(longest)[:, None] < s[None, :]
            x = np.where(valid, e[np.minimum(index, len(e) - 1)], 0.0)
            ahead = np.empty_like(x)
            ahead[0] = x[0]
            for t in range(1, longest):
                r = np.exp(ahead[t - 1])
                ahead[t] = np.clip(x[t] + np.log((m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])), -30, 30)
            behind = np.zeros_like(x)
            for t in range(longest - 2, -1, -1):
                r = np.exp(np.clip(x[t + 1] + behind[t + 1], -30, 30))
                behind[t] = np.where(valid[t + 1], np.log((m[1, 0] + m[1, 1] * r) / (m[0, 0] + m[0, 1] * r)), 0.0)
            logit[index[valid]] = (ahead + behind)[valid]
            if longest > 1:
                both = valid[1:]
                r, q = np.exp(ahead[:-1][both]), np.exp(np.clip(x[1:] + behind[1:], -30, 30)[both])
                p = np.stack([np.full_like(r, m[0, 0]), m[0, 1] * q, m[1, 0] * r, m[1, 1] * r * q])
                pairs += (p / p.sum(0)).sum(1).reshape(2, 2)
    return logit, pairs


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def document_features(logit: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """For each text: 1, the log of 1 + the expected number of toxic tokens, and the largest marginal."""
    out = np.zeros((len(ptr) - 1, 3))
    out[:, 0] = 1
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        p = _sigmoid(logit)
        out[full, 1] = np.log1p(np.add.reduceat(p, ptr[:-1][full]))
        out[full, 2] = np.maximum.reduceat(p, ptr[:-1][full])
    return out


def _adam(theta: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    """Gradient ascent with running moments."""
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        g = gradient(theta)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta


def fit_chain(places: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 40, decay: float = 1e-5) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by feature place, bias and state changes of the chain that makes the token labels likely."""
    seen = np.flatnonzero(np.bincount(places.ravel(), minlength=1 << BITS))
    column = np.stack([np.searchsorted(seen, row).astype(np.int32) for row in places])
    y = labels.astype(float)
    both = ~first[1:]
    had = np.zeros((2, 2))
    np.add.at(had, (labels[:-1][both].astype(int), labels[1:][both].astype(int)), 1)

    def gradient(theta):
        e = np.full(len(y), theta[-5])
        for row in column:
            e += theta[row]
        logit, pairs = forward_backward(e, first, theta[-4:].reshape(2, 2))
        miss = y - _sigmoid(logit)
        g = np.zeros_like(theta)
        for row in column:
            g[:-5] += np.bincount(row, miss, len(seen))
        g[-5] = miss.sum()
        g[-4:] = (had - pairs).ravel()
        return g / len(y) - decay * theta

    theta = _adam(np.concatenate([np.zeros(len(seen)), [-2.0], np.zeros(4)]), gradient, rounds, 0.3)
    table = np.zeros(1 << BITS, np.float32)
    table[seen] = theta[:-5]
    return table, float(theta[-5]), theta[-4:].reshape(2, 2)


def fit_scores(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of document features."""
    return _adam(np.zeros(x.shape[1]), lambda w: x.T @ ((y - _sigmoid(x @ w)) * weight) / weight.sum() - 1e-4 * w, 600, 0.1)


def training_sample(docs: DataFrame, labels: DataFrame, train, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(text, toxic, weight): the labelled training rows of least hash; weights bring back the share of each class."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    usable = usable.where(train(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = usable.select("doc_id", "toxic", F.xxhash64("doc_id").alias("r"))
    chosen = ranked.where("toxic = 1").orderBy("r", "doc_id").limit(toxic_rows).unionByName(ranked.where("toxic = 0").orderBy("r", "doc_id").limit(clean_rows))
    sizes = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    most = {1: toxic_rows, 0: clean_rows}
    weight = F.when(F.col("toxic") == 1, sizes.get(1, 0) / max(1, min(most[1], sizes.get(1, 0)))).otherwise(sizes.get(0, 0) / max(1, min(most[0], sizes.get(0, 0))))
    # toxic_rows + clean_rows ids at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    # copies of one text count once
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic", weight.alias("weight"))


def lexicon(sample: DataFrame, most: int, least_ratio: float = 40.0) -> np.ndarray:
    """Hashes of words and leading pieces that toxic documents hold too often for chance, the `most` strongest at most."""

    def count(batches):
        for batch, data, offsets in B.slices(batches, "text"):
            _, _, ptr, own, _ = tokens(data, offsets)
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            doc = np.repeat(np.arange(len(toxic)), np.diff(ptr))
            h = np.concatenate(own)
            of = np.tile(doc, len(own))
            _, one = np.unique(B.mix(h + of.astype(np.uint64) * _SALTS[0]), return_index=True)
            names, where = np.unique(h[one], return_inverse=True)
            bad = np.bincount(where, toxic[of[one]], len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad), pa.array(np.bincount(where, minlength=len(names)) - bad)], ["h", "bad", "good"])

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad_docs, good_docs = float(n.get(1, 0)), float(n.get(0, 0))
    if not bad_docs or not good_docs:
        return np.zeros(0, np.uint64)
    total = bad_docs + good_docs
    counts = map_batches(sample.select("text", "toxic"), count, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad >= 5")
    both = F.col("bad") + F.col("good")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (term(F.col("bad"), both * (bad_docs / total)) + term(F.col("good"), both * (good_docs / total)) + term(bad_docs - F.col("bad"), (total - both) * (bad_docs / total)) + term(good_docs - F.col("good"), (total - both) * (good_docs / total)))
    strong = counts.where(F.col("bad") * good_docs > F.lit(8.0) * F.col("good") * bad_docs).withColumn("ratio", ratio).where(F.col("ratio") >= least_ratio)
    found = strong.orderBy(F.desc("ratio"), "h").limit(most).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, train, toxic_rows: int = 6000, clean_rows: int = 12_000, chain_rows: int = 1500, most_tokens: int = 1_500_000, most_pieces: int = 20_000) -> Model:
    """Fit on rows whose doc_id passes `train`, a function from column to column; the bounds are those of the module's docstring."""
    sample = checkpoint(training_sample(docs, labels, train, toxic_rows, clean_rows))
    words = lexicon(sample, most_pieces)

    def label(batches):
        for batch, data, offsets in B.slices(batches, "text"):
            _, _, ptr, own, first = tokens(data, offsets)
            places = features(own, first)
            hit = np.zeros(len(first), bool)
            for h in own:
                if len(words):
                    hit |= words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            hit &= np.repeat(toxic, np.diff(ptr))
            rows = [(places[:, a:b].tobytes(), first[a:b].tobytes(), hit[a:b].tobytes()) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            arrays = [pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(1)], ["places", "first", "hit", "toxic"])

    by_hash = F.xxhash64("text")
    few = sample.where("toxic = 1").orderBy(by_hash).limit(chain_rows).unionByName(sample.where("toxic = 0").orderBy(by_hash).limit(chain_rows))
    got, held = [], 0
    typed = few.select("text", F.col("toxic").cast("int").alias("toxic")).orderBy(by_hash, "text")
    for row in map_batches(typed, label, "places binary, first binary, hit binary, toxic int").toLocalIterator():
        size = len(row.first)
        held += size
        if held > most_tokens and got:  # long texts aren't passed over in favour of short ones
            break
        got.append((np.frombuffer(row.places, np.int32).reshape(len(_SALTS), size), np.frombuffer(row.first, bool), np.frombuffer(row.hit, bool), row.toxic))
    kinds = {x[3] for x in got}
    share = float(np.mean([x[3] for x in got])) if got else 0.0
    if kinds != {0, 1} or not held:
        return Model(np.zeros(1 << BITS, np.float32), -20.0, np.zeros((2, 2)), np.zeros(3), share)
    places, first, hit = np.concatenate([x[0] for x in got], axis=1), np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got])
    lengths, y = np.array([len(x[1]) for x in got]), np.array([x[3] for x in got], float)
    del got  # the driver holds the sample once
    table, bias, moves = fit_chain(places, first, hit)
    model = Model(table, bias, moves, np.zeros(3), share)
    logit, _ = forward_backward(model.emissions(places).astype(float), first, moves)
    x = document_features(logit, B.runs_of(lengths))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    model.doc = fit_scores(x, y, weight)
    del places, first, hit, logit
    give_back()
    return model


def _scorer(model: Model):
    def run(data: np.ndarray, offsets: np.ndarray):
        starts, ends, ptr, own, first = tokens(data, offsets)
        if not model.doc.any():
            return starts, ends, ptr, np.full(len(starts), -30.0), np.full(len(ptr) - 1, model.share)
        e = model.emissions(features(own, first)) if len(starts) else np.zeros(0)
        logit, _ = forward_backward(e, first, model.moves) if len(starts) else (np.zeros(0), None)
        return starts, ends, ptr, logit, _sigmoid(document_features(logit, ptr) @ model.doc)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` (doc_id, text) as (doc_id, score, spans): spans are the byte offsets of tokens that are more likely toxic than not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(shared.value)
        for batch, data, offsets in B.slices(batches, "text"):
            starts, ends, ptr, logit, scores = scorer(data, offsets)
            bad = np.flatnonzero(logit > 0)
            text = np.searchsorted(ptr, bad, "right") - 1
            cut = np.searchsorted(bad, ptr)
            pair = pa.StructArray.from_arrays([pa.array(starts[bad] - offsets[text]), pa.array(ends[bad] - offsets[text])], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pair)], ["doc_id", "score", "spans"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(plain, run, "doc_id long, score double, spans array<struct<start: long, end: long>>")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(shared.value)
        for batch, data, offsets in B.slices(batches, "text"):
            yield batch.filter(pa.array(scorer(data, offsets)[4] < threshold))

    return map_batches(docs, run, docs.schema)


def not_in_fold(doc_id, folds: int = 5, fold: int = 0):
    """True for doc_ids whose crc32, of their decimal text, isn't `fold` modulo `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != fold
