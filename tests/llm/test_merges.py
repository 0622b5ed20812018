"""Batched merge rounds against the tokenizers library, on hostile texts and on random small vocabularies' words."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quire.llm import merges

PATH = P.path("byte_bpe_50k.json")
_random = random.Random(5)
TEXTS = [
    "", "a", "aaaaaaa" * 40, "aa", "aaa", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "\x00\x1c\x1d a\u0085b  ", "你好世界" * 300, "ab" * 700, "\n\n  \t x  ", "'s't're'LL don't", "ա՘b ՋӔ \U0001f642\U0010ffff",
    "".join(chr(_random.choice([*range(1, 0x3100), *range(0xA000, 0xABFF), *range(0x10000, 0x10FFF)])) for _ in range(4000)), "".join(_random.choice("abc ") for _ in range(3000)),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library):
    codec = merges.Codec(PATH)
    for text, ids in zip(TEXTS, codec.encode(TEXTS), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(merges, "REMEMBER", 100)
    codec = merges.Codec(PATH)
    for text in TEXTS * 2:
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_strings_of_added_tokens_can_be_ordinary_text(library):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    codec = merges.Codec(PATH, specials=False)
    for text in TEXTS:
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_broken_utf8_decodes_as_in_the_library(library):
    codec = merges.Codec(PATH)
    for _ in range(200):
        ids = [_random.randrange(50257) for _ in range(12)]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_one_merge_after_the_other_gives_the_same(library):
    codec = merges.Codec(PATH)
    rank = {int(k): int(r) for k, r in zip(codec.keys, codec.rank_at, strict=True)}
    made = {int(k): int(m) for k, m in zip(codec.keys, codec.made[codec.rank_at], strict=True)}
    words = ["".join(_random.choice("aeinst ") for _ in range(_random.randrange(1, 40))) for _ in range(300)]
    data = "".join(words).encode()
    ids, ptr = codec.merge(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, words)]))
    for word, a, b in zip(words, ptr[:-1], ptr[1:], strict=True):
        symbols = [int(codec.first[x]) for x in word.encode()]
        while True:
            pairs = [(rank.get(x * int(codec.width) + y, 1 << 40), i) for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False))]
            if not pairs or min(pairs)[0] == 1 << 40:
                break
            _, i = min(pairs)
            symbols[i : i + 2] = [made[symbols[i] * int(codec.width) + symbols[i + 1]]]
        assert ids[a:b].tolist() == symbols


def test_defined_cases(spark, library):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, None, "en"), (3, "aa", None), (3, "aa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted(merges.round_trip(docs, PATH).collect(), key=str)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)
    assert merges.round_trip(docs.limit(0), PATH).count() == 0
    back = {r.doc_id: r.text for r in merges.decode(merges.encode(docs.where("doc_id > 3"), PATH), PATH).collect()}
    assert back == {i: t for i, t in enumerate(TEXTS) if i > 3}
