"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

The benchmark's passages (items) are the rows of a TF-IDF matrix, with document frequencies over all documents.  Its
leading right singular vectors, half as many as there are items and `RANK` at most, come from a distributed randomised
SVD: a random projection and power iterations, in which every task multiplies its items' rows and the products are
summed by key, so the driver only holds matrices of 2^FEATURE_BITS x (RANK + 16) numbers at most, whatever the number of
items.  Documents are then folded in: runs of 16 words are projected into the latent space, and an item is compared
with every window of as many runs as it can touch.  The cosine is that of a window with the item's latent image, in
units of what the space keeps of the item, so it estimates the cosine of the TF-IDF rows at any rank; the tests
measure its recall against brute force.  Windows above `least_cosine` are candidates, and so are all windows that share
enough words with the item, whatever their order: that count, with repeats up to those in the item, is never
less than the longest common subsequence.  All candidates are checked for the longest common subsequence of the item's words with the
window's, and for the item's answer (its last words).  An item is leaked if the subsequence
has `copied` of its words, or `paraphrased` of them and the answer.  Words of every text in their usual order are no leak, so either
`LEAST_WEIGHING` of the item's words that weigh anything, `FEWEST_WEIGHING` at least, are in the window, or `copied` of its words,
whichever they are, stand in order within `COMPACT` times its length, as in a copy that lost the item's rare words.  An item of fewer than `LEAST_WORDS` words, of which
some part is found everywhere, is leaked where it stands word for word, if `SHORT_WEIGHING` of its words weigh anything.

Documents are read once to count words and once to search, without a shuffle of texts.  Items are searched for in blocks
of `BLOCK_ITEMS`, `BLOCKS_A_PASS` of which are broadcast at a time; a larger benchmark takes more passes, not more memory.

Defined cases: a null text is empty and holds no item; an item that is null or has no word, or is short and has fewer
than `SHORT_WEIGHING` words that weigh, is not searched for; repeated items each count; repeated rows each get their
links; a null doc_id gets links like any other; empty tables give no links; other columns are left aside, or kept
by decontaminate().
"""

from __future__ import annotations

import io
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import map_batches, sum_arrays

FEATURE_BITS = 16
RANK = 128
BLOCK_ITEMS = 512
BLOCKS_A_PASS = 2
RUN = 16
LEAST_WORDS = 8
LEAST_INFORMATIVE = 4
SHORT_WEIGHING = 2
#: Of an item's words that weigh anything, the share and the number that a window must have; items with fewer than LEAST_INFORMATIVE are exempt.
LEAST_WEIGHING = 0.4
FEWEST_WEIGHING = 3
#: A copy without them stands within so many times the item's length.
COMPACT = 1.25
#: Words of significantly more than this share of the documents weigh nothing.
MOST_COMMON = 0.2
SLICE = 1 << 19
#: Words are stripped of what is neither an ASCII letter or digit nor a byte of another character.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and pointers by text."""
    starts, ends, ptr = B.spans(_INSIDE[data], offsets)
    return B.hashes(data, starts, ends), ptr


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """In how many documents each feature occurs, and how many documents there are."""
    size = (1 << FEATURE_BITS) + 1

    def count(batches):
        total = np.zeros(size)
        for _, data, offsets in B.slices(batches, "text"):
            h, ptr = _words(data, offsets)
            doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
            pairs = doc << FEATURE_BITS | _feature(h)
            if len(ptr) <= 1 << 32 - FEATURE_BITS:  # half as wide, and sorted much faster
                pairs = pairs.astype(np.uint32)
            total[:-1] += np.bincount(np.unique(pairs) & ((1 << FEATURE_BITS) - 1), minlength=size - 1)
            total[-1] += len(ptr) - 1
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    counts = sum_arrays(map_batches(docs.select(F.col("text").cast("string").alias("text")), count, "part binary"), (size,))
    return counts[:-1], counts[-1]


def inverse_frequencies(seen: np.ndarray, n: float) -> np.ndarray:
    """Weights of the features: none for those in more than MOST_COMMON of all documents, by three standard errors of that share."""
    return np.where(seen > too_common(n), 0.0, np.log((n + 1) / (seen + 1)) + 0.1)


def too_common(n: float) -> float:
    """The number of documents that a word may be in and still weigh."""
    return MOST_COMMON * n + 3 * np.sqrt(MOST_COMMON * (1 - MOST_COMMON) * n) + 1


def _matrix(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the TF-IDF rows of some texts, rows having length 1."""
    h, ptr = _words(*B.buffers(texts))
    row, feature = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), _feature(h)
    value = idf[feature]
    norms = np.sqrt(np.maximum(1e-12, np.bincount(row, value**2, len(ptr) - 1)))
    use = value > 0
    return row[use], feature[use], (value / norms[row])[use]


def _projected(texts: pa.Array, idf: np.ndarray, place: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The TF-IDF rows of some texts times the basis, whose rows are the features with a place."""
    row, feature, value = _matrix(texts, idf)
    known = place[feature] >= 0
    out = np.zeros((len(texts), basis.shape[1]))
    np.add.at(out, row[known], value[known, None] * basis[place[feature[known]]])
    return out


def _sum_products(items: DataFrame, idf: np.ndarray, place: np.ndarray, basis: np.ndarray, gram: bool, part: int = 4096) -> np.ndarray:
    """A.T A basis over all items (or (A basis).T A basis): each task's products, summed by key of `part` features."""
    width = basis.shape[1]
    height = width if gram else len(basis)

    def multiply(batches):
        out = np.zeros((height, width))
        for batch in batches:
            left = _projected(batch.column(0), idf, place, basis)
            if gram:
                out += left.T @ left
            else:
                row, feature, value = _matrix(batch.column(0), idf)
                known = place[feature] >= 0
                np.add.at(out, place[feature[known]], value[known, None] * left[row[known]])
        keys = list(range(0, height, part))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([out[k : k + part].tobytes() for k in keys], pa.binary())], ["key", "sums"])

    def add(key, table):
        total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"key": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros((height, width))
    for r in map_batches(items.select("text"), multiply, "key int, sums binary").groupBy("key").applyInArrow(add, "key int, sums binary").toLocalIterator():
        total[r.key : r.key + part] = np.frombuffer(r.sums, np.float64).reshape(-1, width)
    return total


def latent_space(items: DataFrame, idf: np.ndarray, most: int = RANK, more: int = 16, powers: int = 2, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(places, basis): the leading right singular vectors of the items' (text) TF-IDF matrix; basis has a row for each feature in use."""
    seen, n = document_frequencies(items)
    used = np.flatnonzero((seen > 0) & (idf > 0))
    place = np.full(1 << FEATURE_BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    rank = max(1, min(most, int(n) // 2))
    width = min(rank + more, int(n), len(used))
    if not width:
        return used, np.zeros((0, 1))
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(used), width)))
    for _ in range(powers):
        basis, _ = np.linalg.qr(_sum_products(items, idf, place, basis, gram=False))
    _, turn = np.linalg.eigh(_sum_products(items, idf, place, basis, gram=True))
    return used, basis @ turn[:, ::-1][:, :rank]


class Block:
    """A block of items: what a task needs to search for them."""

    def __init__(self, ids: list, texts: list[str], idf: np.ndarray, space: tuple[np.ndarray, np.ndarray]):
        column = pa.array(texts, pa.string())
        h, ptr = _words(*B.buffers(column))
        self.ids = ids
        self.sizes = np.diff(ptr)
        values = idf[_feature(h)]
        #: Words that weigh anything, with their repeats, and how many a window must share.
        self.weighing = [Counter(h[a:b][values[a:b] > 0].tolist()) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
        self.short = self.sizes < LEAST_WORDS
        self.least_weighing = [max(FEWEST_WEIGHING, LEAST_WEIGHING * k) if (k := sum(c.values())) >= LEAST_INFORMATIVE else 0 for c in self.weighing]
        places, basis = space
        self.place = np.full(1 << FEATURE_BITS, -1, np.int32)
        self.place[places] = np.arange(len(places))
        items = _projected(column, idf, self.place, basis)
        kept = (items**2).sum(1)
        self.basis = (basis * idf[places][:, None]).astype(np.float32)
        #: Latent images, over the square of what the space keeps of an item (at least a twentieth).
        self.items = (items / np.maximum(0.05, kept)[:, None]).astype(np.float32)
        self.runs = -(-self.sizes // RUN) + 1
        self.words = [h[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
        self.masks = [_masks(w) for w in self.words]
        self._index()

    def searchable(self, i: int) -> bool:
        return bool(self.sizes[i]) and (not self.short[i] or sum(self.weighing[i].values()) >= SHORT_WEIGHING)

    def _index(self) -> None:
        """The block's words, and for each length of window and number of repeats, which items have which word so often.

        `layers` holds (runs of a window with its margins, items, repeats, row of each word or -1, rows x items).
        """
        sizes = self.sizes
        word, item = np.concatenate([*self.words, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sizes)), sizes)
        self.vocabulary, code = np.unique(word, return_inverse=True)
        self.known = np.zeros(1 << FEATURE_BITS, bool)
        self.known[_feature(self.vocabulary)] = True
        pair, repeats = np.unique(code * len(sizes) + item, return_counts=True)
        code, item = pair // len(sizes), pair % len(sizes)
        kind = np.int16 if sizes.max(initial=0) < 1 << 14 else np.int32
        self.layers = []
        for span in np.unique(self.runs + 2).tolist():
            items = np.flatnonzero(self.runs + 2 == span)
            mine = np.isin(item, items)
            parts = []
            for m in np.unique(repeats[mine]).tolist():
                use = mine & (repeats == m)
                held, row = np.unique(code[use], return_inverse=True)
                rows = np.full(len(self.vocabulary), -1, np.int32)
                rows[held] = np.arange(len(held))
                table = np.zeros((len(held), len(items)), kind)
                table[row, np.searchsorted(items, item[use])] = 1
                parts.append((m, rows, table))
            self.layers.append((span, items, parts))

    def codes(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are in the block's vocabulary, their codes)."""
        at = np.flatnonzero(self.known[f])
        code = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[code] == h[at]
        return at[same], code[same]


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item, by its bit masks of places, with some words."""
    whole = (1 << size) - 1
    state, find = whole, masks.get
    for m in [m for w in words if (m := find(w))]:
        u = state & m
        state = ((state + u) | (state - u)) & whole
    return size - state.bit_count()


def _stands(phrase: list[int], words: list[int]) -> bool:
    """Whether the phrase is among the words, word for word."""
    return any(words[k : k + len(phrase)] == phrase for k in range(len(words) - len(phrase) + 1))


def _sum_runs(basis: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the basis rows of each run; a run has RUN hits at most, so they are added in RUN rounds over whole rows."""
    counts = np.diff(np.append(first, len(place)))
    out = basis[place[first]]
    for k in range(1, int(counts.max(initial=0))):
        more = np.flatnonzero(counts > k)
        out[more] += basis[place[first[more] + k]]
    return out


def _add_runs(total: np.ndarray, table: np.ndarray, row: np.ndarray, target: np.ndarray, sign: int) -> None:
    """Add to (or take from) the total, at each target, the table's rows that go there."""
    if len(row):
        order = np.argsort(target, kind="stable")
        places, first = np.unique(target[order], return_index=True)
        total[places] += sign * _sum_runs(table, row[order], first)


def shared_words(block: Block, at: np.ndarray, code: np.ndarray, run: np.ndarray, text: np.ndarray, base: np.ndarray, places: int):
    """For each length of window: (its items, shared words by first run and item), as multisets.

    `run` counts the runs with an empty one before each text, which is `base`; `at` are the places of words with a
    code in the block, `text` their texts.  Of an item with m of a word, an occurrence counts in the windows that
    begin after the m-th occurrence before it and that reach it, so a window has min(occurrences, m) of them.
    """
    order = np.argsort(text * max(1, len(block.vocabulary)) + code, kind="stable")
    back = {}
    for span, items, parts in block.layers:
        total = np.zeros((places + 1, len(items)), parts[0][2].dtype if parts else np.int16)
        for m, rows, table in parts:
            if m not in back:
                before = np.full(len(at), -1)
                late, early = order[m:], order[:-m]
                same = (text[late] == text[early]) & (code[late] == code[early])
                before[late[same]] = run[early[same]]
                back[m] = before
            use = np.flatnonzero((rows[code] >= 0) & (back[m] < run))
            row, end = rows[code[use]], run[use]
            begin = np.maximum(np.maximum(back[m][use], end - span) + 1, base[text[use]])
            _add_runs(total, table, row, begin, 1)
            _add_runs(total, table, row, end + 1, -1)
        yield items, np.cumsum(total, axis=0, dtype=total.dtype)


class Search:
    """Blocks with the settings of a search; search() finds the leaked items of a slice of texts."""

    def __init__(self, blocks: list[Block], idf: np.ndarray, least_cosine: float, copied: float, paraphrased: float, answer_words: int):
        self.blocks, self.idf = blocks, idf.astype(np.float32)
        self.least_cosine, self.copied, self.paraphrased, self.answer_words = least_cosine, copied, paraphrased, answer_words

    def candidates(self, h: np.ndarray, ptr: np.ndarray):
        """For each block: (block, window's first word, its end, item, cosine, text) of the candidates.

        These are the windows at or above the least cosine, and those that share so many words with the item that the
        checks could accept them, counted with the margins that search() adds on both sides, and enough of its
        weighing ones, counted without.  If a window of w
        runs has a cosine of c, then one of its runs has c / sqrt(w) or more (Cauchy-Schwarz over the runs' lengths),
        so windows are summed only around such runs.
        """
        f = _feature(h)
        counts = np.diff(ptr)
        runs = -(-counts // RUN)
        of = B.runs_of(runs)
        text = np.repeat(np.arange(len(counts)), runs)
        begin = B.ragged(np.zeros(len(runs), np.int64), runs) * RUN + ptr[:-1][text]
        if not len(begin):
            return
        weights = np.concatenate([[0.0], np.cumsum(self.idf[f].astype(float) ** 2)])
        lengths = np.sqrt(np.maximum(1e-9, weights[np.append(begin[1:], len(h))] - weights[begin]))
        base = of[:-1] + np.arange(len(counts))  # runs are counted with an empty one before each text
        padded = np.repeat(np.arange(len(counts)), runs + 1)
        for block in self.blocks:
            place = block.place[f]
            hit = np.flatnonzero(place >= 0)
            run = np.searchsorted(begin, hit, "right") - 1
            full, first = np.unique(run, return_index=True)
            dots = np.zeros((0, len(block.ids)), np.float32)
            if len(full):
                dots = _sum_runs(block.basis, place[hit], first) @ block.items.T
            row = np.full(len(begin) + 1, len(full))
            row[full] = np.arange(len(full))
            dots = np.vstack([dots, np.zeros((1, dots.shape[1]), np.float32)])  # the last row is that of runs without a hit
            least = (self.least_cosine / np.sqrt(block.runs)).astype(np.float32)
            seed, item = np.nonzero(dots[:-1] >= lengths[full, None].astype(np.float32) * least)
            starts, items = [], []
            if len(seed):
                back = block.runs[item]
                starts.append(B.ragged(full[seed] - back + 1, back))
                items.append(np.repeat(item, back))
            sharing = self._sharing(block, h, f, ptr, begin, text, base, padded, of)
            if not starts and not len(sharing):
                continue
            start, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, items))
            good = start >= 0
            start, item = start[good], item[good]
            pair = np.unique(np.concatenate([start * len(block.ids) + item, sharing]))
            start, item = pair // len(block.ids), pair % len(block.ids)
            size = block.runs[item]
            end = np.minimum(start + size, of[text[start] + 1])
            total = np.zeros(len(start), np.float64)
            for k in range(int(size.max(initial=0))):
                inside = start + k < end
                total += np.where(inside, dots[row[np.minimum(start + k, len(begin))], item], 0.0)
            stop = np.minimum(begin[start] + size * RUN, ptr[text[start] + 1])
            cosine = total / np.sqrt(np.maximum(1e-9, weights[stop] - weights[begin[start]]))
            near = (cosine >= self.least_cosine) | np.isin(pair, sharing)
            yield block, begin[start[near]], stop[near], item[near], cosine[near], text[start[near]]

    def _sharing(self, block: Block, h, f, ptr, begin, text, base, padded, of) -> np.ndarray:
        """Windows (first run x items + item) that share enough words with the item to be candidates whatever their cosine."""
        at, code = block.codes(h, f)
        run = np.searchsorted(begin, at, "right") - 1
        texts = text[run]
        found, enough = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for items, shared in shared_words(block, at, code, run + texts + 1, texts, base, len(padded)):
            least = np.where(block.short[items], 1.0, min(self.copied, self.paraphrased)) * block.sizes[items]
            place, item = np.nonzero(shared[:-1] >= np.ceil(least - 1e-9).astype(shared.dtype))
            start = place - padded[place]  # the margin before a window is the run before it
            good = start < of[padded[place] + 1]
            found.append(start[good] * len(block.ids) + items[item[good]])
            enough.append((shared[place, item] >= np.ceil(self.copied * block.sizes[items[item]] - 1e-9))[good])
        pair = np.concatenate(found)
        first, item = pair // len(block.ids), pair % len(block.ids)
        low = begin[first]
        high = np.minimum(ptr[1:][text[first]], low + block.runs[item] * RUN)
        copied = np.concatenate(enough)
        return pair[[c or self._weighs(block, i, h[a:b].tolist()) for a, b, i, c in zip(low.tolist(), high.tolist(), item.tolist(), copied.tolist(), strict=True)]] if len(pair) else pair

    def _weighs(self, block: Block, i: int, words: list[int]) -> bool:
        weighing = block.weighing[i]
        shared = Counter([w for w in words if w in weighing]) & weighing
        return sum(shared.values()) >= block.least_weighing[i]

    def _compact(self, block: Block, i: int, words: list[int]) -> bool:
        """Whether `copied` of the item's words stand in order within COMPACT times its length."""
        size = int(block.sizes[i])
        span = int(COMPACT * size)
        return any(common_subsequence(block.masks[i], size, words[k : k + span]) >= self.copied * size for k in range(max(1, len(words) - span + 1)))

    def search(self, data: np.ndarray, offsets: np.ndarray):
        """The best window of each text and leaked item: (text, item_id, common, item words, cosine, answer found, first word)."""
        h, ptr = _words(data, offsets)
        best: dict = {}
        for block, begin, stop, items, cosines, texts in self.candidates(h, ptr):
            for a, b, i, cosine, t in zip(begin.tolist(), stop.tolist(), items.tolist(), cosines.tolist(), texts.tolist(), strict=True):
                weighs = self._weighs(block, i, h[a:b].tolist())
                a, b = max(int(ptr[t]), a - RUN), min(int(ptr[t + 1]), b + RUN)
                words, size = h[a:b].tolist(), int(block.sizes[i])
                if block.short[i] and not _stands(block.words[i].tolist(), words):
                    continue
                common = common_subsequence(block.masks[i], size, words)
                if not weighs and not (common >= self.copied * size and self._compact(block, i, words)):
                    continue
                tail = block.words[i][-self.answer_words :]
                answer = common_subsequence(_masks(tail), len(tail), words) * 5 >= 4 * len(tail)
                if common >= self.copied * size or (answer and common >= self.paraphrased * size):
                    found = (common, cosine, answer, a - int(ptr[t]))
                    key = (t, id(block), i)
                    if key not in best or (found[0], found[1]) > best[key][5:7]:
                        best[key] = (t, block.ids[i], size, answer, a - int(ptr[t]), common, cosine)
        return sorted(best.values(), key=lambda x: (x[0], str(x[1])))


def _searches(docs: DataFrame, benchmark: DataFrame, least_cosine: float, copied: float, paraphrased: float, answer_words: int):
    """A Search for each pass over the documents, made from a bounded number of items at a time."""
    seen, n = document_frequencies(docs)
    idf = inverse_frequencies(seen, n)
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    space = latent_space(items, idf)
    shared = spark.sparkContext.broadcast((idf, space))
    n_blocks = max(1, -(-items.count() // (BLOCK_ITEMS // 2)))
    # by hash, a block gets about half of what it may hold; fuller ones are cut again inside the task
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int"))

    def fit(table):
        import pickle

        idf, space = shared.value
        pairs = sorted(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=str)
        whole = Block([i for i, _ in pairs], [t for _, t in pairs], idf, space)
        pairs = [p for k, p in enumerate(pairs) if whole.searchable(k)]
        made = [Block([i for i, _ in part], [t for _, t in part], idf, space) for part in (pairs[k : k + BLOCK_ITEMS] for k in range(0, len(pairs), BLOCK_ITEMS))]
        return pa.table({"made": pa.array([pickle.dumps(x) for x in made], pa.binary())})

    fitted = blocks.groupBy("block").applyInArrow(fit, "made binary")
    held = []
    for row in fitted.toLocalIterator():
        import pickle

        held.append(pickle.load(io.BytesIO(row.made)))
        if len(held) == BLOCKS_A_PASS:
            yield Search(held, idf, least_cosine, copied, paraphrased, answer_words)
            held = []
    if held:
        yield Search(held, idf, least_cosine, copied, paraphrased, answer_words)


LINKS = "doc_id long, item_id long, common_words long, item_words long, cosine double, answer_found boolean, first_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.3, copied: float = 0.7, paraphrased: float = 0.5, answer_words: int = 5) -> DataFrame:
    """One row for each document row and item that it leaks, with the best window's figures."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], LINKS)
    for search in _searches(docs, benchmark, least_cosine, copied, paraphrased, answer_words):
        shared = docs.sparkSession.sparkContext.broadcast(search)

        def run(batches, shared=shared):
            for batch, data, offsets in B.slices(batches, "text", SLICE):
                if found := shared.value.search(data, offsets):
                    text, item, size, answer, first, common, cosine = zip(*found, strict=True)
                    ids = batch.column(0).take(pa.array(text, pa.int64()))
                    arrays = [ids, pa.array(item, pa.int64()), pa.array(common, pa.int64()), pa.array(size, pa.int64()), pa.array(cosine, pa.float64()), pa.array(answer, pa.bool_()), pa.array(first, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in LINKS.split(", ")])

        out = out.unionByName(map_batches(rows, run, LINKS))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.3, copied: float = 0.7, paraphrased: float = 0.5, answer_words: int = 5) -> DataFrame:
    """The rows of `docs`, with all their columns, that leak no item."""
    out = docs
    for search in _searches(docs, benchmark, least_cosine, copied, paraphrased, answer_words):
        shared = docs.sparkSession.sparkContext.broadcast(search)

        def run(batches, shared=shared):
            for batch, data, offsets in B.slices(batches, "text", SLICE):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in shared.value.search(data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        out = map_batches(out, run, docs.schema)
    return out
