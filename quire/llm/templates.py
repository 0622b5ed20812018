"""Line dedup by log templates: a tree of fixed depth generalises variable fields, recurring templates go.

The tree's levels are a line's number of tokens and its leading tokens; a leaf holds the distinct lines
that share them.  Inside a leaf the fields are told apart by votes instead of by arrival, so the result
doesn't depend on any order and every step is a keyed count:

* tokens are runs of [^\\x20\\x09-\\x0D]; a token with an ASCII digit is a variable field at once;
* at each place after the leading tokens, a group's constant is the token that more than half of its
  distinct lines have there, if there is one; every other token there is a variable field; a leaf is one group at first;
* a line whose tokens after the leading ones are constants to `agree` tenths at least has the group's template;
* a leaf may hold several templates, so what is left goes on for ROUNDS rounds: where a group had a template, its other lines
  are a group; where it had too few constants for one, it is cut up by the token at the place of its most frequent token
  that isn't a constant (the lowest place of equals), which tells templates apart that share the leaf;
* a line that no group takes in is a template of its own.

The number of lines of one template thus doesn't matter to another one that shares its leaf.

A template recurs if `min_docs` documents have it (`short_docs` if it has fewer than `long_tokens`
tokens; lines of fewer than `min_tokens` are never counted).  Its lines stay in the first of these
documents, by doc_id, and are dropped from the others.  Lines are keyed by 64-bit hashes.

Only distinct lines of leaves with two lines or more are ever spelled out into tokens, and frequent lines
are counted before they are shuffled, so neither a frequent line nor a full leaf lands in one task.

Defined cases: a null text stays null and has no lines; empty lines are kept; rows with equal doc_id and
text are one document and get equal results; a null doc_id is ordered last; an empty table gives an
empty table; other columns of the input are kept as they are by drop_lines().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import bit_filter, checkpoint, map_batches, passes

DEPTH = 3
_WILD = np.uint64(0x5851F42D4C957F2D)
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1


class _Lines:
    """The lines with a token of a slice of texts: text, number in the text, tokens, and hashes of leaf and masked line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, ptr = B.words(data, offsets)
        h = B.hashes(data, starts, ends, B.IDENTITY)
        digits = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_DIGIT[data], out=digits[1:])
        self.tokens = np.where(digits[ends] > digits[starts], _WILD, h)
        breaks = np.flatnonzero(data == 0x0A)
        text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        line = np.searchsorted(breaks, starts)
        begins = np.ones(len(starts), bool)
        begins[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        self.start = np.flatnonzero(begins)
        self.size = np.diff(np.append(self.start, len(starts)))
        self.text = text[self.start]
        self.number = line[self.start] - np.searchsorted(breaks, offsets[self.text])
        total = np.zeros(len(starts) + 1, np.uint64)
        np.cumsum(self.tokens * B._power_table("up", len(starts)), out=total[1:])
        down = B._power_table("down", len(starts) + 1)[self.start]

        def spelled(n: np.ndarray) -> np.ndarray:
            return (total[self.start + n] - total[self.start]) * down

        self.line = B.mix(spelled(self.size) + self.size.astype(np.uint64))
        self.leaf = B.mix(spelled(np.minimum(self.size, DEPTH)) ^ B.mix(self.size.astype(np.uint64)))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of a document: __ord (its doc_id, nulls last) and __rid (a hash of doc_id and text)."""
    doc_id = F.col("doc_id").cast("long")
    return docs.withColumn("__ord", F.coalesce(doc_id, F.lit((1 << 63) - 1))).withColumn("__rid", F.xxhash64(doc_id, F.col("text").cast("string")))


def read_lines(keyed: DataFrame, min_tokens: int) -> DataFrame:
    """(ord, rid, number, size, leaf, line) of the lines with min_tokens tokens or more."""

    def run(batches):
        for batch, data, offsets in B.slices(batches, "text"):
            x = _Lines(data, offsets)
            keep = x.size >= min_tokens
            text = pa.array(x.text[keep])
            arrays = [batch.column(0).take(text), batch.column(1).take(text), *(pa.array(v[keep].astype(np.int64)) for v in (x.number, x.size)), *(pa.array(v[keep].view(np.int64)) for v in (x.leaf, x.line))]
            yield pa.RecordBatch.from_arrays(arrays, ["ord", "rid", "number", "size", "leaf", "line"])

    rows = keyed.select("__ord", "__rid", F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "ord long, rid long, number long, size long, leaf long, line long")


def spell(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(leaf, line, lines, tokens) of the chosen lines (leaf, line, lines), tokens being those after the leading ones.

    Texts aren't shuffled: a bit filter of the chosen lines passes through every text, and what passes is joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(chosen.select(F.col("line").alias("h"))))

    def run(batches):
        for _, data, offsets in B.slices(batches, "text"):
            x = _Lines(data, offsets)
            at = np.flatnonzero((x.size > DEPTH) & passes(shared.value, x.line))
            at = at[np.unique(x.line[at], return_index=True)[1]]
            rest = x.size[at] - DEPTH
            tokens = pa.ListArray.from_arrays(pa.array(B.runs_of(rest), pa.int32()), pa.array(x.tokens[B.ragged(x.start[at] + DEPTH, rest)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x.line[at].view(np.int64)), tokens], ["line", "tokens"])

    lines = map_batches(docs.select(F.col("text").cast("string").alias("text")), run, "line long, tokens array<long>").groupBy("line").agg(F.first("tokens").alias("tokens"))
    return lines.join(chosen, "line").select("leaf", "line", "lines", "tokens")


#: Lines of a leaf that a task handles together, about.
PART = 500


def _parts(lines: Column) -> Column:
    return F.ceil(lines / PART)


def _dealt(lines: DataFrame) -> DataFrame:
    """lines (leaf, line, lines, ...) with the part of its leaf that a line is dealt to."""
    return lines.withColumn("part", F.pmod(F.col("line"), _parts(F.col("lines"))))


def _for_parts(by_leaf: DataFrame) -> DataFrame:
    """Rows by leaf, with its number of lines, once for each part of the leaf: one in PART of the lines, and one for each leaf."""
    return by_leaf.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _parts(F.col("lines")) - 1)))


#: Rounds in which groups are given a template or cut up.
ROUNDS = 4


def generalised(spelled: DataFrame, agree: int) -> DataFrame:
    """(line, template) of the spelled lines that agree with a group's constants in `agree` tenths of their tokens.

    A group's lines are dealt out in parts of about PART lines, in which tokens are counted by place before the counts
    are shuffled; a group's constants are one token for each place at most, and go to all of its parts.
    """
    state, found = spelled.select("line", "tokens", F.col("leaf").alias("grp"), "lines"), None
    for k in range(ROUNDS):
        dealt = _dealt(state)
        votes = dealt.repartition("grp", "part").select("grp", "lines", F.posexplode("tokens").alias("place", "token")).groupBy("grp", "place", "token").agg(F.count("*").alias("n"), F.first("lines").alias("lines"))
        most = F.col("n") * 2 > F.col("lines")
        groups = votes.groupBy("grp").agg(F.collect_list(F.when(most, F.struct("place", "token"))).alias("constants"), F.max(F.when(~most, F.struct("n", -F.col("place")))).alias("cut"), F.first("lines").alias("lines"))
        joined = dealt.join(_for_parts(groups).drop("lines"), ["grp", "part"])
        same = F.size(F.filter("constants", lambda c: F.get("tokens", c["place"]) == c["token"]))
        taken = F.lit(10) * same >= F.lit(agree) * F.size("tokens")
        place = -F.col("cut.col2")
        settled = F.lit(10) * F.size("constants") >= F.lit(agree) * F.size("tokens")
        further = F.when(settled, F.xxhash64("grp", F.lit("rest"))).when(place.isNotNull(), F.xxhash64("grp", place, F.get("tokens", place)))
        # what a round says of each line is narrow and stored once; tokens are fetched again for lines that still have a group
        marks = checkpoint(joined.select("line", F.when(taken, F.xxhash64("grp", F.lit("template"))).alias("template"), F.when(~taken, further).alias("grp")))
        named = marks.where(F.col("template").isNotNull()).select("line", "template")
        found = named if found is None else found.unionByName(named)
        if k + 1 < ROUNDS:
            left = marks.where(F.col("grp").isNotNull()).select("line", "grp")
            sizes = left.groupBy("grp").agg(F.count("*").alias("lines")).where("lines > 1")
            state = checkpoint(spelled.select("line", "tokens").join(left.join(sizes, "grp"), "line"))
    return found


def recurring_lines(docs: DataFrame, min_docs: int = 2, short_docs: int = 5, long_tokens: int = 10, min_tokens: int = 3, agree: int = 7) -> DataFrame:
    """(ord, rid, numbers): for each document, by its key, the line numbers (from 0) that are to be dropped."""
    keyed = _keyed(docs)
    lines = checkpoint(read_lines(keyed, min_tokens))
    distinct = lines.groupBy("leaf", "line").agg(F.first("size").alias("size")).where(F.col("size") > DEPTH)
    full = distinct.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1")
    chosen = distinct.join(full, "leaf").select("leaf", "line", "lines")
    general = generalised(checkpoint(spell(docs, chosen)), agree)
    named = lines.join(general, "line", "left").withColumn("template", F.coalesce("template", "line"))
    named = checkpoint(named.select("ord", "rid", "number", "size", "template"))
    held = named.groupBy("template", "ord", "rid").agg(F.first("size").alias("size"))
    counted = held.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("ord", "rid")).alias("first"), F.first("size").alias("size"))
    recurring = counted.where(F.col("n") >= F.when(F.col("size") < long_tokens, short_docs).otherwise(min_docs)).select("template", "first")
    recurring = checkpoint(recurring)  # a join of two plain shuffles, of which a frequent template's can be split
    dropped = named.join(recurring, "template").where((F.col("ord") != F.col("first.ord")) | (F.col("rid") != F.col("first.rid")))
    return dropped.groupBy("ord", "rid").agg(F.collect_set("number").alias("numbers"))


def _marked(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs with the columns of `drops` other than its key (ord, rid)."""
    keyed, drops = _keyed(docs), drops.withColumnsRenamed({"ord": "__o", "rid": "__r"})
    joined = keyed.join(drops, (keyed["__ord"] == drops["__o"]) & (keyed["__rid"] == drops["__r"]), "left")
    return joined.drop("__ord", "__rid", "__o", "__r")


class _Whole:
    """The lines with a word of a slice of texts, word for word: text, number in the text, characters, hash of all bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, ptr = B.spans(data != 0x0A, offsets)
        inked, characters = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
        np.cumsum(~B.SPACE[data], out=inked[1:])
        np.cumsum(data & 0xC0 != 0x80, out=characters[1:])
        keep = inked[ends] > inked[starts]
        breaks = np.flatnonzero(data == 0x0A)
        self.text = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[keep]
        starts, ends = starts[keep], ends[keep]
        self.number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[self.text])
        self.characters = characters[ends] - characters[starts]
        self.hash = B.hashes(data, starts, ends, B.IDENTITY).view(np.int64)
        self.sizes = characters[offsets[1:]] - characters[offsets[:-1]]


def copies(docs: DataFrame, drops: DataFrame, least_kept: float) -> DataFrame:
    """(ord, rid) of the documents that keep less than `least_kept` of their characters, and no line that is first there.

    A line with a word, as it stands, is first in the least document that has it.  That document keeps the line and is
    no copy, so a line of a copy is never lost.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(drops.select(F.col("rid").alias("h"))))
    keyed = _keyed(docs).select("__ord", "__rid", F.col("text").cast("string").alias("text"))

    def measured(batches):
        for batch, data, offsets in B.slices(batches, "text"):
            x = _Whole(data, offsets)
            at = np.flatnonzero(passes(shared.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            ptr = np.searchsorted(x.text, np.arange(len(offsets)))
            count = ptr[at + 1] - ptr[at]
            line = B.ragged(ptr[at], count)
            cuts = pa.array(B.runs_of(count), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v[line].astype(np.int64))) for v in (x.number, x.characters, x.hash)]
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(x.sizes[at]), *lists], ["ord", "rid", "size", "number", "characters", "hash"])

    lines = map_batches(keyed, measured, "ord long, rid long, size long, number array<long>, characters array<long>, hash array<long>")
    kept = F.filter(F.arrays_zip("number", "characters", "hash"), lambda x: ~F.array_contains("numbers", x["number"]))
    found = lines.join(drops, ["ord", "rid"]).select("ord", "rid", "size", kept.alias("kept"))
    characters = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["characters"] + 1) - 1
    short = checkpoint(found.where(characters < F.lit(least_kept) * F.col("size")).select("ord", "rid", F.col("kept.hash").alias("hashes")).distinct())
    left = short.select("ord", "rid", F.explode("hashes").alias("hash"))
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(left.select(F.col("hash").alias("h"))))

    def held(batches):
        for batch, data, offsets in B.slices(batches, "text"):
            x = _Whole(data, offsets)
            at = np.flatnonzero(passes(wanted.value, x.hash.view(np.uint64)))
            text = pa.array(x.text[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(1).take(text), pa.array(x.hash[at])], ["ord", "rid", "hash"])

    first = map_batches(keyed, held, "ord long, rid long, hash long").groupBy("hash").agg(F.min(F.struct("ord", "rid")).alias("first"))
    own = left.join(first, "hash").where((F.col("ord") == F.col("first.ord")) & (F.col("rid") == F.col("first.rid"))).select("ord", "rid").distinct()
    return short.select("ord", "rid").join(own, ["ord", "rid"], "left_anti")


def line_report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_lines, dropped, text): the text without its recurring lines, and the numbers of the lines dropped."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _marked(docs, recurring_lines(docs, **settings).withColumnRenamed("numbers", "__drop"))
    numbers = F.coalesce(F.sort_array("__drop"), F.array().cast("array<long>"))

    def run(batches):
        for batch, _, _ in B.slices(batches, "text"):
            texts, counts = [], []
            for text, numbers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = [] if text is None else text.split("\n")
                gone = set(numbers)
                counts.append(len(parts))
                texts.append(text if not gone else "\n".join(x for i, x in enumerate(parts) if i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(2), pa.array(texts, pa.string())], ["doc_id", "n_lines", "dropped", "text"])

    return map_batches(rows.select("doc_id", "text", numbers.alias("dropped")), run, "doc_id long, n_lines long, dropped array<long>, text string")


def drop_lines(docs: DataFrame, least_kept: float = 0.3, n_chars: str | None = "n_chars", **settings) -> DataFrame:
    """The rows of `docs`, with all their columns, without their recurring lines.

    A document that keeps less than `least_kept` of its characters, and no line that isn't in an earlier document too, is
    a copy of what stays elsewhere, and goes as a whole.  The column `n_chars`, if there is one, is counted anew for texts that change.
    """
    drops = checkpoint(recurring_lines(docs, **settings))
    gone = copies(docs, drops, least_kept).withColumn("__copy", F.lit(True))
    rows = _marked(docs, drops.join(gone, ["ord", "rid"], "left").withColumnRenamed("numbers", "__drop"))
    names = docs.columns
    text_at, drop_at = names.index("text"), len(names)

    def run(batches):
        for batch, _, _ in B.slices(batches, "text"):
            texts, keep = batch.column(text_at).to_pylist(), [x is None for x in batch.column(drop_at + 1).to_pylist()]
            for i, numbers in enumerate(batch.column(drop_at).to_pylist()):
                if numbers:
                    gone = set(numbers)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
            columns = list(batch.columns[:drop_at])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    out = map_batches(rows.select(*[F.col(f"`{c}`") for c in names], "__drop", "__copy"), run, docs.schema)
    if n_chars and n_chars in names:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(n_chars, F.when(F.col("text").isNull(), F.col(n_chars)).otherwise(F.length("text")).cast(kind)).select(*names)
    return out
