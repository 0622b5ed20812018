"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

The model has one piece for each token of the vocabulary, in rank order, so that a piece's id is its rank.
A piece's characters stand for bytes (byte b is the character U+0100 + b), its score is its negative rank,
so that the merge of least rank goes first, and the normaliser is the identity.  Texts are split by the
pre-token pattern; every pre-token is encoded on its own, and one that is a token itself is that token, as
in the rank file's own encoder.  Decoding maps ids back to bytes and joins them.

The vocabulary and the pattern are parameters: a file that every worker can read, and a string.

Defined cases: a null text is empty and has no ids; repeated rows each get a row; an empty table gives an
empty table.  Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import map_batches

#: Bytes of pre-tokens and ids that a worker remembers, about; the memory is emptied when it is full.
REMEMBER = 24 << 20

_TO_CHARS = {i: chr(0x100 + i) for i in range(256)}


def _number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _int(field: int, n: int) -> bytes:
    return _number(field << 3) + _number(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model (public protocol-buffer format) with these tokens as pieces 0..n-1 and the unknown piece last."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_bytes(1, _bytes(1, t.decode("latin-1").translate(_TO_CHARS).encode()) + _number(2 << 3 | 5) + struct.pack("<f", -rank) + _int(3, normal)) for rank, t in enumerate(tokens)]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + _number(2 << 3 | 5) + struct.pack("<f", 0) + _int(3, unknown)))
    trainer = _int(3, bpe) + _int(4, len(pieces)) + _int(40, len(tokens)) + _int(41, -1) + _int(42, -1) + _int(43, -1)
    normaliser = _bytes(1, b"identity") + _bytes(2, b"") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary; made once in each worker process."""

    _made: dict[tuple[str, str], "Codec"] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.whole = {t: str(i) for i, t in enumerate(tokens)}
        self.bytes_of = {str(i): t for i, t in enumerate(tokens)}
        self.known: dict[str, str] = {}
        self.held = 0

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def _learn(self, missing: set[str]) -> None:
        if self.held > REMEMBER:
            self.known.clear()
            self.held = 0
        merged = []
        for piece in missing:
            if (found := self.whole.get(piece.encode())) is not None:
                self.known[piece] = found
                self.held += getsizeof(piece) + 100
            else:
                merged.append(piece)
        mapped = [p.encode().decode("latin-1").translate(_TO_CHARS) for p in merged]
        for piece, ids in zip(merged, self.model.encode(mapped, num_threads=1), strict=True):
            self.known[piece] = found = ",".join(map(str, ids))
            self.held += getsizeof(piece) + getsizeof(found) + 100

    def encode(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        pieces = self.split(text)
        try:
            return ",".join(map(self.known.__getitem__, pieces))
        except KeyError:
            missing = set(pieces).difference(self.known)
            while missing:  # again where the memory was emptied
                self._learn(missing)
                missing = set(pieces).difference(self.known)
            return ",".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text as an array of ints."""

    def run(batches):
        codec = Codec.of(path, pattern)
        for batch, _, _ in B.slices(batches, "text"):
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            values = [list(map(int, x.split(","))) if x else [] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text_bytes): the bytes that the ids stand for."""

    def run(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            out = [codec.decode(",".join(map(str, x or []))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "text_bytes"])

    return map_batches(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text_bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded in one pass over the texts."""

    def run(batches):
        codec = Codec.of(path, pattern)
        for batch, _, _ in B.slices(batches, "text", 1 << 19):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
