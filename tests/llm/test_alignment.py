"""Cross-tokenizer alignment against a plain pair loop over the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quire.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "Straßenbahn naïve  café\n\n  x", "the the the cat", "a▁b", "▁", "x \n y\t z ", "   ", "\n", "\x00\x1c a", "你好 世界 🙂", "<s> a</s><|endoftext|> <0x0A>", "antidisestablishmentarianism" * 3, "l'été, l'hiver; ça va?\r\n" * 5,
    " leading", "trailing ", "tab\tand\x0bvertical", "a b   c", "x" * 300, "0123456789 " * 20,
]


def _token_bytes():
    import sentencepiece

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if b not in visible]
    table |= {chr(256 + k): b for k, b in enumerate(hidden)}
    return library, model, table


def brute(texts):
    library, model, table = _token_bytes()
    rows, links = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(table[c] for c in library.id_to_token(i))) for i in library.encode(whole.decode(), add_special_tokens=False).ids]
        b = []
        for i in model.encode(text or ""):
            piece = model.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append((0, 0, 0, [], ""))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        found = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e]
        links.update(found)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in side if before <= s and e <= end) for side in spans))
            before = end
        rows.append((len(a), len(b), len(groups), found, ";".join(groups)))
    most = defaultdict(int)
    for (_, j), n in links.items():
        most[j] = max(most[j], n)
    return [(n_a, n_b, n_g, len(f), sum(links[p] == most[p[1]] for p in f), sum(links[p] for p in f), hashlib.sha256(g.encode()).hexdigest() if n_a else "") for n_a, n_b, n_g, f, g in rows], links, most


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "the cat", "x"), (5, "the the the cat", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, pair string").repartition(3)


def test_report_equals_the_plain_loop(spark, docs, monkeypatch):
    texts = [*TEXTS, "the cat", "the the the cat"]
    ids = [*range(len(TEXTS)), None, 5]
    want, _, _ = brute(texts)
    for size in (8 << 20, 40):
        monkeypatch.setattr(alignment, "SLICE_BYTES", size)
        found = alignment.report(docs, A, B)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, found.collect()), key=str) == sorted([(i, *w) for i, w in zip(ids, want, strict=True)], key=str)


def test_pair_counts_and_groups(spark, docs):
    texts = [*TEXTS, "the cat", "the the the cat"]
    _, links, most = brute(texts)
    found = {(r.a_id, r.b_id): (r.links, r.best) for r in alignment.pair_counts(docs, A, B).collect()}
    assert found == {p: (n, n == most[p[1]]) for p, n in links.items()}
    rows = alignment.groups(docs.where("doc_id = 4"), A, B).orderBy("place").collect()
    text = ";".join("|".join(",".join(map(str, x)) for x in (r.a_ids, r.b_ids)) for r in rows)
    assert hashlib.sha256(text.encode()).hexdigest() == brute([TEXTS[4]])[0][0][-1]


def test_units_can_be_encoded_on_their_own(spark):
    library, model, _ = _token_bytes()
    tools = alignment.Units.of(A, B)
    import numpy as np

    texts = [t for t in TEXTS if t] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    for text in texts:
        units = tools.cut(" " + text)
        assert "".join(units) == " " + text
        want = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        assert tuple(x.tolist() for x in tools.tokens(units)) == want
        alone = [tools.tokens([u]) for u in units]
        assert tuple(np.concatenate([x[k] for x in alone]).tolist() for k in (0, 1)) == want


def test_empty_table(spark, docs):
    assert alignment.report(docs.limit(0), A, B).count() == 0
