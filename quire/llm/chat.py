"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A visitor flattens them, in order,
into escaped text and placeholders, and records each attachment's reference, place and the number of
tokens that its placeholder expands to.  The template marks turns by control strings; control strings in
texts and roles are escaped by one more backslash after `<`, which unescape() takes away again, so any
text can be read back.

format_turns() works on each row alone.  read_back() parses the formatted rows of a conversation in turn
order, as a stream over sorted partitions: it holds one row and running digests, whatever a
conversation's length.

Defined cases: a null text or part is empty; a null role is the empty role; turns are ordered by `turn`,
nulls first, ties by the formatted row; repeated rows are turns of their own; rows with a null conv_id are one
conversation with a null id; an empty table gives an empty table; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._spark import map_batches

#: Fixed values of the template.
START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


@dataclass(frozen=True)
class Expansion:
    """How many tokens an attachment stands for."""

    image_patch: int = 28
    audio_tokens_a_second: float = 25.0
    document_tokens_a_page: int = 576


class PartVisitor:
    """Flattens the parts of a turn; visit() is called once for each, in order."""

    def __init__(self, expansion: Expansion):
        self.expansion, self.pieces, self.attachments, self.length = expansion, [], [], 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "place": self.length, "tokens": tokens})
        self._add(PLACEHOLDERS[kind])

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        patch = self.expansion.image_patch
        self._attach("image", part, math.ceil((part.get("width") or 0) / patch) * math.ceil((part.get("height") or 0) / patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.expansion.audio_tokens_a_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.expansion.document_tokens_a_page)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"no such part type: {part.get('type')}")


PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long, attachments array<struct<kind: string, ref: string, place: long, tokens: long>>, expanded_tokens long"


def text_parts(conversations: DataFrame) -> DataFrame:
    """Conversations of plain texts as rows (conv_id, turn, role, parts) of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.array(part).alias("parts"))


def format_turns(conversations: DataFrame, expansion: Expansion | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, turn, role, parts) formatted one by one.

    A conversation's formatted text is its rows' `formatted`, in order.  loss_start and loss_end are the
    code points of the row's loss mask (equal, where nothing is learned); `place` counts from loss_start's
    origin, the first code point of the content; expanded_tokens sums the attachments' tokens.
    """
    expansion = expansion or Expansion()
    names = ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())])), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                visitor = PartVisitor(expansion)
                for part in parts or []:
                    visitor.visit(part or {})
                head = f"{START}{escape(role or '').replace(chr(10), NEWLINE)}\n"
                body = "".join(visitor.pieces)
                size = len(body) if role in learn else 0
                rows.append((head + body + END, len(head), len(head) + size, visitor.attachments, sum(a["tokens"] for a in visitor.attachments)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds[2:], strict=True))], names)

    return map_batches(conversations.select("conv_id", "turn", "role", "parts"), run, FORMATTED)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    role, body = formatted[len(START) :].split("\n", 1)
    if not formatted.startswith(START) or not body.endswith(END):
        raise ValueError("not a formatted turn")
    return unescape(role.replace(NEWLINE, "\n")), unescape(body[: -len(END)])


class _Digest:
    """Running digests of one conversation, from its formatted turns."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars, self.all, self.loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int) -> None:
        role, text = parse_turn(formatted)
        self.all.update(f"{role}\n{text}\n".encode())
        learned = unescape(formatted[start:end])
        self.loss.update(learned.encode())
        self.turns += 1
        self.chars += len(formatted)
        self.loss_chars += len(learned)

    def row(self, conv_id):
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """For each conversation, what its formatted turns say when parsed: counts and digests of turns and of the text under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held, digest, out = None, None, []
        for batch in batches:
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if digest is None or conv != held:
                    if digest:
                        out.append(digest.row(held))
                    held, digest = conv, _Digest()
                digest.add(text, start, end)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], _schema(names))
                out = []
        if digest:
            yield pa.RecordBatch.from_pylist([dict(zip(names, digest.row(held), strict=True))], _schema(names))

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")
    return map_batches(ordered.select("conv_id", "formatted", "loss_start", "loss_end"), run, schema)


def _schema(names: list[str]) -> pa.Schema:
    return pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
