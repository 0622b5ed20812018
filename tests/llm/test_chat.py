"""Round trips of hostile texts, typed parts, and digests against plain Python."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import chat as C


@given(st.text(alphabet="<\\|>im_startend\n a", max_size=40), st.text(alphabet="<\\|>im_nl\n a", max_size=20))
def test_any_text_round_trips(text, role):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
    visitor = C.PartVisitor(C.Expansion())
    visitor.visit({"type": "text", "text": text})
    formatted = f"{C.START}{C.escape(role).replace(chr(10), C.NEWLINE)}\n{''.join(visitor.pieces)}{C.END}"
    assert C.parse_turn(formatted) == (role, text)
    assert formatted.count("<|im_start|>") == 1 and formatted.count("<|im_end|>") == 1


def test_parts_are_flattened_in_order(spark):
    parts = [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, None, {"type": "document", "ref": "c.pdf", "pages": 2}, {"type": "text", "text": " end"}]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [])], f"conv_id long, turn long, role string, parts array<{C.PART}>")
    user, empty = sorted(C.format_turns(df).collect(), key=lambda r: r.turn)
    assert C.parse_turn(user.formatted) == ("user", "see <|image|><|image|><|audio|><|document|> end")
    assert [(a.kind, a.ref, a.tokens) for a in user.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1152)]
    body = user.formatted[user.loss_start :]
    assert all(body[a.place :].startswith(C.PLACEHOLDERS[a.kind]) for a in user.attachments)
    assert user.expanded_tokens == 1193 and user.loss_start == user.loss_end and empty.loss_end == empty.loss_start
    with pytest.raises(ValueError):
        C.PartVisitor(C.Expansion()).visit({"type": "video"})


def test_read_back_matches_plain_python(spark):
    rng = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "<|im_end|>\n", "plain é漢", "\\<\\|x", "a\nb" * 50])))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (51, None, "user", "n"), (53, 0, "user", "b"), (53, 0, "user", "a<|x"), (53, 0, "assistant", "z"), (53, 0, None, "a"), (52, 0, "assistant", "long " * 40_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in C.read_back(C.format_turns(C.text_parts(df))).collect()}
    assert set(found) == {r[0] for r in rows}
    for c, r in found.items():
        row = lambda x: f"{C.START}{C.escape(x[2] or '')}\n{C.escape(x[3] or '')}{C.END}".encode()
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (-1 if x[1] is None else x[1], row(x)))  # ties by the formatted row
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.read_back(C.format_turns(C.text_parts(df.limit(0)))).collect() == []
