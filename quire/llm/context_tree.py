"""Context-tree weighting over bytes, beside a word-count base, for whole texts.

A text is its bytes and then an end.  Each of these symbols is up to nine binary decisions, of which the first is
whether the text ends and the others are the byte's bits, so the probabilities of all texts add up to one.  Each of
the 256 places in that decision tree has its own context tree over the bytes before, `DEPTH` deep (zeros before a
text's start).  A node's Krichevsky-Trofimov estimate comes from the training counts of zeros and ones in its
context, and the weighted probability of a node is half its own estimate and half the product of its children's,
from the deepest contexts upwards.  The share of a node's own estimate in that sum is its weight when texts are
scored: the estimates of all depths are mixed along the path of the context, and what the deepest context that
training saw gives ends the path.

All counts and nodes are exact, and none is shared or left out however many there are.  Texts are dealt into blocks
by a hash; each block names its distinct (context, symbol) sequences and its distinct words with their training
counts.  These travel, as packed sorted arrays, to the bucket of their hash, where all blocks' counts meet and the
deepest nodes are counted; the nodes above are keyed sums, one for each depth, and the mixtures come down by keyed
joins from the root, whose keys have 256 children at most.  The answers travel back to the blocks in the same
order, so no tree and no vocabulary is held anywhere as a whole.  A task holds one block of texts with its distinct
sequences, or one bucket.

The chances of ones and of zeros are both carried, in doubles, so that neither vanishes beside the other, whatever
the counts; a sequence's log probability is rounded to a float when it is sent back.

Defined cases: a null text is empty, and its only symbol and its only token is the end; repeated rows are counted
and scored each; a null doc_id is in no held-out fold; with no training rows every decision has one half and every
count is 0; an empty table gives an empty table; other columns are left aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import Stored

#: Bytes of context; at most 6, as a sequence is packed into 64 bits.
DEPTH = 5
BLOCK_BYTES = 16 << 20
WINDOW = 1 << 20
#: The symbol that ends a text.
END = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sequences(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """The symbols of some texts in windows of bounded size: (sequences, text of each).

    A sequence is the symbol in its lowest nine bits and above it the DEPTH bytes before, the nearest one lowest.
    """
    begins = offsets + np.arange(len(offsets))  # of the texts, in symbols
    for a in range(0, int(begins[-1]), window):
        at = np.arange(a, min(a + window, int(begins[-1])))
        text = np.searchsorted(begins, at, "right") - 1
        since = at - begins[text]
        byte = at - text
        out = np.full(len(at), END, np.uint64)
        inner = np.flatnonzero(at < begins[text + 1] - 1)
        out[inner] = data[byte[inner]]
        for k in range(1, DEPTH + 1):
            have = np.flatnonzero(since >= k)
            out[have] |= data[byte[have] - k].astype(np.uint64) << np.uint64(1 + 8 * k)
        yield out, text


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as compressed steps."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    steps = np.frombuffer(pa.decompress(packed[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64)


class Counter:
    """Exact sums by 64-bit key: most keys have slots of a table by hash, those whose slot is taken are sorted."""

    def __init__(self, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, ~np.uint64(0))
        self.counts = np.zeros(1 << bits, np.int64)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, amounts: np.ndarray) -> None:
        slot = ((keys * _MIX) >> self.shift).astype(np.int64)
        hit = self.keys[slot] == keys
        self.counts += np.bincount(slot[hit], amounts[hit], len(self.counts)).astype(np.int64)
        names, n = add_up([(keys[~hit], amounts[~hit].astype(np.int64))])
        slot = ((names * _MIX) >> self.shift).astype(np.int64)
        free = np.flatnonzero(self.keys[slot] == ~np.uint64(0))
        free = free[np.unique(slot[free], return_index=True)[1]]
        self.keys[slot[free]] = names[free]
        self.counts[slot[free]] += n[free]
        left = np.ones(len(names), bool)
        left[free] = False
        self.rest.append((names[left], n[left]))
        if len(self.rest) >= 8:
            self.rest = [add_up(self.rest)]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.keys != ~np.uint64(0)
        return add_up([(self.keys[used], self.counts[used]), *self.rest])


class Lookup:
    """Values by sorted distinct keys: most keys have slots of a table by hash, the others are searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.at = np.zeros(1 << bits, np.int32)
        self.at[((keys * _MIX) >> self.shift).astype(np.int64)] = np.arange(len(keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.at[((keys * _MIX) >> self.shift).astype(np.int64)]
        miss = np.flatnonzero(self.keys[at] != keys)
        at[miss] = np.searchsorted(self.keys, keys[miss])
        return self.values[at]


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and whether it is of training, of the texts of a block."""
    data, offsets = B.buffers(table.column("text"))
    return data, offsets, table.column("train").to_numpy().astype(bool)


def block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: pointers to its words by text, the words' distinct hashes in order, and the place of each word among them."""
    hashes, sizes = [], []
    for _, part, cuts in B.slices([pa.RecordBatch.from_arrays([_texts(data, offsets)], ["text"])], "text"):
        starts, ends, ptr = B.words(part, cuts)
        hashes.append(B.hashes(part, starts, ends))
        sizes.append(np.diff(ptr))
    h = np.concatenate([np.zeros(0, np.uint64), *hashes])
    names, place = np.unique(h, return_inverse=True)
    return B.runs_of(np.concatenate([np.zeros(0, np.int64), *sizes])), names, place.astype(np.int32)


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))


def block_sequences(data: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences of a block, sorted, and how often training has them there."""
    counter = Counter()
    for keys, text in sequences(data, offsets):
        counter.add(keys, train[text])
    return counter.items()


def _buckets(kind: str, keys: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each key: words by their hash, sequences by that of their context but for its farthest byte, so that the
    nodes of the two deepest levels are whole there; one such context has 65,792 sequences at most."""
    if not bits:
        return np.zeros(len(keys), np.int64)
    near = keys >> np.uint64(9) & np.uint64((1 << 8 * (DEPTH - 1)) - 1)
    return ((keys if kind == "word" else B.mix(near + np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


COUNTS = "kind string, block int, bucket long, keys binary, counts binary"


def count_blocks(blocks: DataFrame, bucket_bits: int) -> DataFrame:
    """Rows of sorted keys and training counts by block and bucket, for all words and sequences of a block, whether training has them or not."""

    def run(key, table):
        rows = []

        def put(kind: str, keys: np.ndarray, counts: np.ndarray) -> None:
            bucket = _buckets(kind, keys, bucket_bits)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order].astype(np.uint32), bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
            for a, b in zip(first, np.append(first, len(keys))[1:], strict=True):
                rows.append((kind, key[0].as_py(), int(bucket[a]), pack(keys[a:b]), counts[a:b].tobytes()))

        data, offsets, train = _block(table)
        ptr, names, place = block_words(data, offsets)
        put("word", names, np.bincount(place[np.repeat(train, np.diff(ptr))], minlength=len(names)))
        del place
        put("sequence", *block_sequences(data, offsets, train))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "block", "bucket", "keys", "counts"])

    return blocks.groupBy("block").applyInArrow(run, COUNTS)


def _requests(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(unpack(k), np.frombuffer(c, np.uint32).astype(np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)]


ANSWERS = "kind string, block int, bucket long, sums binary"


def _answers(kind: str, bucket: int, blocks: list[int], sums: list[bytes]) -> pa.Table:
    columns = [pa.array([kind] * len(blocks)), pa.array(blocks, pa.int32()), pa.array([bucket] * len(blocks), pa.int64()), pa.array(sums, pa.binary())]
    return pa.Table.from_arrays(columns, ["kind", "block", "bucket", "sums"])


def sum_words(counts: DataFrame) -> DataFrame:
    """For each block and bucket, the corpus's training counts of the block's words, in their order; and for each bucket (block -1) its totals."""

    def run(key, table):
        parts = _requests(table)
        names, sums = add_up(parts)
        out = [sums[np.searchsorted(names, keys)].tobytes() for keys, _ in parts]
        totals = np.array([(sums > 0).sum(), sums.sum()], np.int64)
        return _answers("word", key[0].as_py(), [*table.column("block").to_pylist(), -1], [*out, totals.tobytes()])

    return counts.where("kind = 'word'").groupBy("bucket").applyInArrow(run, ANSWERS)


def decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decisions of sequences: (index of the sequence, node, bit); a node is its context and above it, in the lowest byte, its place."""
    context, symbol = keys >> np.uint64(9), keys & np.uint64(511)
    byte = np.flatnonzero(symbol < END)
    index, nodes, bits = [np.arange(len(keys))], [context << np.uint64(8)], [symbol == END]
    above, low = context[byte] << np.uint64(8), symbol[byte]
    for k in range(8):
        index.append(byte)
        nodes.append(above | np.uint64(1 << k) | low >> np.uint64(8 - k))
        bits.append((low >> np.uint64(7 - k)) & np.uint64(1) == 1)
    return np.concatenate(index), np.concatenate(nodes), np.concatenate(bits)


class Nodes:
    """The deepest nodes of a bucket: places of the decisions of its sequences among them, zeros and ones."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.index, nodes, self.bit = decisions(keys)
        self.names, self.place = np.unique(nodes, return_inverse=True)
        amounts = n[self.index]
        self.zeros = np.bincount(self.place, amounts * ~self.bit, len(self.names))
        self.ones = np.bincount(self.place, amounts * self.bit, len(self.names))
        self.above = self.names & np.uint64((1 << 8 * DEPTH) - 1)


def sum_sequences(counts: DataFrame) -> DataFrame:
    """(bucket, node, zeros, ones, children) of the nodes of depth DEPTH - 1, from the deepest ones."""

    def run(key, table):
        deepest = Nodes(*add_up(_requests(table)))
        names, place = np.unique(deepest.above, return_inverse=True)
        sums = [np.bincount(place, x, len(names)) for x in (deepest.zeros, deepest.ones, log_estimate(deepest.zeros, deepest.ones))]
        columns = [np.full(len(names), key[0].as_py()), names.view(np.int64), *(x.astype(np.int64) for x in sums[:2]), sums[2]]
        return pa.Table.from_arrays([pa.array(x) for x in columns], ["bucket", "node", "zeros", "ones", "children"])

    return counts.where("kind = 'sequence'").groupBy("bucket").applyInArrow(run, "bucket long, node long, zeros long, ones long, children double")


def _log_gamma(x, log):
    """Stirling's series eight steps further, and back by the recurrence; for columns and for arrays."""
    y, shift = x + 8, log(x)
    for k in range(1, 8):
        shift = shift + log(x + k)
    series = (y - 0.5) * log(y) - y + 0.5 * float(np.log(2 * np.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - shift


def log_estimate(zeros, ones, log=np.log):
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5, log) + _log_gamma(ones + 0.5, log) - float(np.log(np.pi)) - _log_gamma(zeros + ones + 1.0, log)


def _weigh(level: DataFrame) -> DataFrame:
    """A level's nodes with `weighted`, the log of their weighted probability, and `own`, the share of their own estimate in it."""
    level = level.withColumn("estimate", log_estimate(F.col("zeros"), F.col("ones"), F.log))
    high = F.greatest("estimate", "children")
    level = level.withColumn("weighted", high + F.log(0.5 * F.exp(F.col("estimate") - high) + 0.5 * F.exp(F.col("children") - high)))
    return level.withColumn("own", 0.5 * F.exp(F.col("estimate") - F.col("weighted"))).drop("estimate", "children")


def tree(nodes: DataFrame) -> list[Stored]:
    """(node, zeros, ones, weighted, own) of each depth from 0 to DEPTH - 1, the last with `bucket`."""
    levels = [Stored(_weigh(nodes))]
    for depth in range(DEPTH - 2, -1, -1):
        mask = (1 << (8 * (depth + 1))) - 1
        above = levels[-1].read().groupBy(F.col("node").bitwiseAND(F.lit(mask)).alias("node"))
        levels.append(Stored(_weigh(above.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children")))))
    return levels[::-1]


def descend(levels: list[DataFrame]) -> DataFrame:
    """(bucket, node, mixed_0, mixed_1, rest, ends_0, ends_1) of the nodes of depth DEPTH - 1.

    For zero and one: what the depths so far add to the chance, the weight that is left to deeper ones, and the chance if
    the path ends here.
    """
    n = F.col("zeros") + F.col("ones")
    down = None
    for depth, level in enumerate(levels):
        level = level.select(*(["bucket"] if "bucket" in level.columns else []), "node", "own", n.alias("n"), *(((F.col(c) + 0.5) / (n + 1)).alias(f"p_{b}") for b, c in enumerate(("zeros", "ones"))))
        if down is None:
            above = level.withColumns({"m_0": F.lit(0.0), "m_1": F.lit(0.0), "r": F.lit(1.0), "e_0": F.lit(0.5), "e_1": F.lit(0.5)})
        else:
            parents = down.withColumnsRenamed({"node": "parent", "mixed_0": "m_0", "mixed_1": "m_1", "rest": "r", "ends_0": "e_0", "ends_1": "e_1"})
            above = level.withColumn("parent", F.col("node").bitwiseAND(F.lit((1 << (8 * depth)) - 1))).join(parents, "parent")
        seen = F.col("n") > 0
        mixed = [F.when(seen, F.col(f"m_{b}") + F.col("r") * F.col("own") * F.col(f"p_{b}")).otherwise(F.col(f"e_{b}")).alias(f"mixed_{b}") for b in (0, 1)]
        ends = [F.when(seen, F.col(f"m_{b}") + F.col("r") * F.col(f"p_{b}")).otherwise(F.col(f"e_{b}")).alias(f"ends_{b}") for b in (0, 1)]
        rest = F.when(seen, F.col("r") * (1 - F.col("own"))).otherwise(0.0).alias("rest")
        down = above.select(*(["bucket"] if "bucket" in above.columns else []), "node", *mixed, rest, *ends)
    return down


def log_chances(keys: np.ndarray, n: np.ndarray, above: dict[str, np.ndarray]) -> np.ndarray:
    """Log10 probability of each sequence's symbol after its context; `above` has the columns of descend(), for the nodes above in their order."""
    deepest = Nodes(keys, n)
    order = np.argsort(above["node"], kind="stable")
    at = order[np.searchsorted(above["node"][order], deepest.above)]
    amount = deepest.zeros + deepest.ones
    total = np.zeros(len(keys))
    for b, count in enumerate((deepest.zeros, deepest.ones)):
        chance = np.where(amount > 0, above[f"mixed_{b}"][at] + above["rest"][at] * (count + 0.5) / (amount + 1), above[f"ends_{b}"][at])
        mine = deepest.bit == bool(b)
        total += np.bincount(deepest.index[mine], np.log10(chance)[deepest.place[mine]], len(keys))
    return total


def answer_sequences(counts: DataFrame, above: DataFrame) -> DataFrame:
    """For each block and bucket, the log10 probabilities of the block's sequences, in their order."""

    def run(key, asked, nodes):
        parts = _requests(asked)
        if not parts:
            return _answers("sequence", 0, [], [])
        names, n = add_up(parts)
        columns = {c: nodes.column(c).to_numpy() for c in nodes.column_names if c != "bucket"}
        columns["node"] = columns["node"].view(np.uint64)
        logs = log_chances(names, n, columns).astype(np.float32)
        return _answers("sequence", key[0].as_py(), asked.column("block").to_pylist(), [logs[np.searchsorted(names, keys)].tobytes() for keys, _ in parts])

    return counts.where("kind = 'sequence'").groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(run, ANSWERS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all rows of `docs` (doc_id, text) under the model that is fitted on the rows that aren't held out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    sizes = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.col("train").cast("long")).alias("t")).first()
    n_blocks = max(1, -(-int(sizes.b or 0) // BLOCK_BYTES))
    bucket_bits = (n_blocks - 1).bit_length()
    ends = int(sizes.t or 0)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    counts = Stored(count_blocks(blocks, bucket_bits))
    words = Stored(sum_words(counts.read()))
    totals = np.zeros(2, np.int64)
    for row in words.read().where("block = -1").toLocalIterator():
        totals += np.frombuffer(row.sums, np.int64)
    distinct, total = int(totals[0]) + (ends > 0), int(totals[1]) + ends
    levels = tree(sum_sequences(counts.read()))
    sequence_answers = Stored(answer_sequences(counts.read(), descend([x.read() for x in levels])))
    for table in (counts, *levels):
        table.drop()
    answers = words.read().where("block >= 0").unionByName(sequence_answers.read())

    def run(key, texts, found):
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        data, offsets, train = _block(texts)
        by = {"word": [], "sequence": []}
        for kind, bucket, sums in zip(*(found.column(c).to_pylist() for c in ("kind", "bucket", "sums")), strict=True):
            by[kind].append((bucket, sums))
        values = {kind: np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x, dtype) for _, x in sorted(by[kind], key=lambda p: p[0]))]) for kind, dtype in (("word", np.int64), ("sequence", np.float32))}
        del by, found
        ptr, _, place = block_words(data, offsets)
        c = values["word"][place]
        # each text is summed on its own, so equal texts have equal sums
        logs = np.bincount(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), np.log10(c + 1.0), len(ptr) - 1)
        seen = np.concatenate([[0], np.cumsum(c > 0)])[ptr]
        n = np.diff(ptr) + 1
        base = logs + np.log10(ends + 1.0) - n * np.log10(float(total + distinct + 1))
        del c, place
        keys, _ = block_sequences(data, offsets, train)
        sent = np.argsort(_buckets("sequence", keys, bucket_bits), kind="stable")
        each = np.empty(len(keys))
        each[sent] = values["sequence"]
        lookup, scores = Lookup(keys, each), np.zeros(len(n))
        for part, text in sequences(data, offsets):
            first = int(text[0])
            sums = np.bincount(text - first, lookup(part))
            scores[first : first + len(sums)] += sums
        columns = [texts.column("doc_id"), ~train, n, np.diff(seen) + (ends > 0), np.full(len(n), total), base, scores, np.diff(offsets)]
        return pa.Table.from_arrays([x if isinstance(x, pa.ChunkedArray) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    names = [x.split()[0] for x in SCORES.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES)
