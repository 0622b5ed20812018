"""Byte-level BPE by batched merge rounds over numpy arrays, from a tokenizers JSON file.

The symbols of many words lie in one flat array.  A round looks up the ranks of all adjacent pairs by binary
search over the sorted pair keys, takes each word's lowest rank, and merges every place of the word that has it,
from the left where places overlap; words without a pair in the table leave the array.  A merge can only make
pairs of higher rank than its own, which is checked when the file is read, so a round that merges all places of the
lowest rank gives what merging one place after the other gives.

Words are the pre-tokens of the byte-level pattern.  They are found with the regex library; texts with a character
that it puts into another class than the tokenizers library does (their Unicode versions differ) are split by the latter.
Strings of added tokens inside a text are those tokens, or ordinary text with specials=False.  Decoding maps ids to
bytes, and bytes that aren't UTF-8 to replacement characters.

Defined cases: a null text is empty and has no ids; repeated rows each get a row; an empty table gives an empty
table.  Texts are encoded whole, whatever their length; a worker remembers words up to a bound and then forgets all.
"""

from __future__ import annotations

import hashlib
import json
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import map_batches

#: Bytes of words and ids that a worker remembers, about.
REMEMBER = 24 << 20

# Fixed value: the byte-level pattern that splits texts into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NEVER = np.int64(1) << 62


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: visible Latin-1 for itself, the other bytes from U+0100 on in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in visible)
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class _Added:
    """An added token in a list of words; equal to others of its text, and to no word."""

    def __init__(self, text: str):
        self.text = text

    def __eq__(self, other) -> bool:
        return isinstance(other, _Added) and self.text == other.text

    def __hash__(self) -> int:
        return hash(("added", self.text))


class Splitter:
    """Texts to words, as the tokenizers library's byte-level pre-tokenizer splits them."""

    def __init__(self):
        import regex
        from tokenizers import pre_tokenizers

        self.pattern = regex.compile(PATTERN)
        self.other = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.seen: set[str] = set()
        self.odd: set[str] = set()

    def _spans(self, text: str) -> list[tuple[int, int]]:
        return [span for _, span in self.other.pre_tokenize_str(text)]

    def _look_at(self, characters: set[str]) -> None:
        for c in characters:
            probe = f"a{c}a 1{c}{c}1{c}"
            if self._spans(probe) != [m.span() for m in self.pattern.finditer(probe)]:
                self.odd.add(c)
        self.seen |= characters

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            characters = set(text)
            if new := characters - self.seen:
                self._look_at(new)
            if not self.odd.isdisjoint(characters):
                return [text[a:b] for a, b in self._spans(text)]
        return self.pattern.findall(text)


class Codec:
    """Encoder and decoder of one vocabulary; made once in each worker process."""

    _made: dict[tuple[str, bool], "Codec"] = {}

    def __init__(self, path: str, specials: bool = True):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens must be matched as they are")
        ids, characters = model["vocab"], byte_characters()
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = np.array([ids[a] for a, _ in pairs]), np.array([ids[b] for _, b in pairs])
        made = np.array([ids[a + b] for a, b in pairs])
        born = np.full(max(ids.values()) + 1, -1)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if (born[left] >= np.arange(len(made))).any() or (born[right] >= np.arange(len(made))).any():
            raise ValueError(f"{path}: a merge comes before the merges of its parts")
        self.width = np.int64(len(born))
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.rank_at, self.made = keys[order], order.astype(np.int64), made.astype(np.int32)
        self.first = np.array([ids[c] for c, _ in sorted(characters.items(), key=lambda x: x[1])], np.int32)
        self.bytes_of = {i: bytes(characters[c] for c in t) for t, i in ids.items()} | {t["id"]: t["content"].encode() for t in added}
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added} if specials else {}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.splitter = Splitter()
        self.known: dict[str | _Added, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, path: str, specials: bool = True) -> "Codec":
        if (path, specials) not in cls._made:
            cls._made[path, specials] = cls(path, specials)
        return cls._made[path, specials]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_at[at], _NEVER)

    def merge(self, data: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie one after the other in `data` (ptr has their n + 1 bounds): the ids, and their bounds."""
        symbols, word = self.first[data], np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        if not len(symbols):
            return symbols, np.zeros(len(ptr), np.int64)
        # rank[i] is that of symbols i and i + 1, and none at the end of a word
        rank = np.full(len(symbols), _NEVER)
        rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(symbols[:-1], symbols[1:]), _NEVER)
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            ended = np.repeat(least == _NEVER, sizes)
            if ended.any():
                done.append((word[ended], symbols[ended]))
                symbols, word, rank, least, sizes = symbols[~ended], word[~ended], rank[~ended], least[least < _NEVER], sizes[least < _NEVER]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of places that overlap, which are all of one symbol, every other one from the left
            run = np.cumsum(np.r_[True, hit[1:] != hit[:-1] + 1]) - 1
            hit = hit[(hit - hit[np.searchsorted(run, run)]) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(word) - 1)
                rank[i] = np.where((word[i] == word[j]) & (i < j), self._ranks(symbols[i], symbols[j]), _NEVER)
        word, symbols = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], B.runs_of(np.bincount(word, minlength=len(ptr) - 1))

    def _learn(self, words: list[str]) -> None:
        coded = [w.encode() for w in words]
        ids, ptr = self.merge(np.frombuffer(b"".join(coded), np.uint8), B.runs_of(np.fromiter(map(len, coded), np.int64, len(coded))))
        raw = memoryview(ids.astype("<u4").tobytes())
        for word, a, b in zip(words, (4 * ptr[:-1]).tolist(), (4 * ptr[1:]).tolist(), strict=True):
            self.known[word] = found = bytes(raw[a:b])
            self.held += getsizeof(word) + getsizeof(found) + 100

    def _parts(self, text: str) -> list[str | _Added]:
        """The words of a text; an added token is a part of its own."""
        if self.cut is None or not self.cut.search(text):
            return self.splitter.words(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.splitter.words(text[at : m.start()]), _Added(m.group())]
            at = m.end()
        return out + self.splitter.words(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        parts = [self._parts(t) for t in texts]
        if self.held > REMEMBER:
            self.known.clear()
            self.held = 0
        if missing := set().union(*parts).difference(self.known):
            added = {p for p in missing if isinstance(p, _Added)}
            self.known |= {p: self.special[p.text] for p in added}
            self._learn([*missing - added])
        return [b"".join(map(self.known.__getitem__, x)) for x in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, specials: bool = True) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text as an array of ints."""

    def run(batches):
        codec = Codec.of(path, specials)
        for batch, _, _ in B.slices(batches, "text"):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(_rows(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the texts that the ids stand for; null ids are an empty text."""

    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            out = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded in one pass over the texts."""

    def run(batches):
        codec = Codec.of(path)
        for batch, _, _ in B.slices(batches, "text"):
            ids = codec.encode([t or "" for t in batch.column(1).to_pylist()])
            digest = lambda x: hashlib.sha256(x).hexdigest()
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([digest(x) for x in ids]), pa.array([digest(codec.decode(x).encode()) for x in ids])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(_rows(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
