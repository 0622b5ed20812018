"""The serialised model against the rank file's own encoder."""

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from quire.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "\n\n  x", "it's we'll 'tis", "<|endoftext|>", "<unk>", "▁a ▁▁", "a\x00b\x1c\x1d\x85\xa0", "é漢字🙂 ñ¿ ｆｕｌｌ", "word" * 9000, " " * 5000 + "x", "9" * 3000, "%%%***!!!" * 500]
    for _ in range(120):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x4E00, 0x4F00), 32, 10, rng.randrange(0x1F600, 0x1F640)])) for _ in range(rng.randrange(200))))
    return out


def test_ids_and_bytes_match(spark):
    enc, rows = reference(), list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(None, "a b", 1, "x")], "doc_id long, text string, ids int, n_tokens string")
    found = {r.doc_id: r for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, PATH, P.PATTERN).collect()}
    back = {r.doc_id: bytes(r.text_bytes) for r in bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    for i, t in rows:
        want = enc.encode_ordinary(t or "")
        assert ids[i] == want, t
        assert back[i] == (t or "").encode()
        assert found[i].n_tokens == len(want)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert None in found


def test_memory_can_be_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    codec, enc = bpe.Codec(PATH, P.PATTERN), reference()
    for t in ("a b c d e f g", "one two", "hundreds of words of words"):
        assert codec.encode(t) == ",".join(map(str, enc.encode_ordinary(t)))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(empty, PATH, P.PATTERN).collect() == []
