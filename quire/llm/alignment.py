"""Which tokens of two tokenizers overlap, and how often over a corpus: A is a byte-level BPE (JSON file), B a sentencepiece BPE.

A reads a space and the text, without special tokens, and B the text, which adds the space itself; so both cut the same bytes.
Texts are cut into units before a space that follows another character than white space.  No token of either side crosses
such a place: A's pattern starts a word there, and no piece of B holds its space mark after another character (checked
when the model is read).  A slice of texts is thus a list of its different units with the units of each text.

Each Arrow partition hands the units of a slice to DuckDB as two tables of token intervals.  An ASOF join finds, for each
token's start, the other side's token that holds it, a range condition leaves out those that end before it: each
overlapping pair is found once, by the later of its starts.  Window sums over places where both sides start number the
groups.  Pair counts of a slice are merged in Spark; a slice asks for the counts of its own pairs (one request for each
different pair), and the answers are brought back to it by its number.  Slices are bounded by bytes, so a task holds
one slice, whatever the corpus.

Defined cases: texts that are null or empty, or whose bytes the tokens of A or B don't give back (those that hold the
space mark U+2581 itself), have no tokens: zeros and an empty digest.  Repeated rows and null doc_ids each get a row;
an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import Stored, map_batches
from quire.llm.merges import Codec

#: Bytes of text in a slice, about.
SLICE_BYTES = 4 << 20
_RUN = 1 << 14

MARK = "▁"
# a unit ends before a plain space that follows neither white space nor the mark
_UNITS = r"[\s▁]*[^\s▁]+(?:(?:[^\S ]|▁)[\s▁]*[^\s▁]*)*|[\s▁]+"


class Units:
    """Texts to units, and units to the ids of both tokenizers; made once in each worker process."""

    _made: dict[tuple[str, str], "Units"] = {}

    def __init__(self, path_a: str, path_b: str):
        import duckdb
        import regex
        import sentencepiece

        self.a = Codec(path_a, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path_b}: a piece holds the space mark after another character")
        as_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_b = _Table(as_bytes)
        self.bytes_a = _Table([self.a.bytes_of.get(i, b"") for i in range(max(self.a.bytes_of) + 1)])
        self.lone = self.b.encode("x ")[len(self.b.encode("x")) :]  # a space alone, as the model has no ids for an empty text
        self.cut = regex.compile(_UNITS).findall
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Units":
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's and B's ids of the units, one after the other, as if they were one text.

        A unit ends in white space only where its text does; such units are encoded on their own, for no word to run into the next.
        """
        runs: list[list[str]] = [[]]
        size = 0
        for unit in units:
            runs[-1].append(unit)
            size += len(unit)
            if size > _RUN or unit[-1].isspace():
                runs.append([])
                size = 0
        texts = ["".join(run) for run in runs if run]
        # B puts a space of its own before a text; all units start with one
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        b = chain.from_iterable(x if len(t) > 1 else self.lone for t, x in zip(texts, b, strict=True))
        return np.frombuffer(b"".join(self.a.encode(texts)), "<u4").astype(np.int32), np.fromiter(b, np.int32)


class _Table:
    """The bytes of all tokens by id."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = B.runs_of(self.sizes)[:-1]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[B.ragged(self.starts[ids], self.sizes[ids])]


def _token_table(ids: np.ndarray, table: _Table, starts: np.ndarray, whole: np.ndarray) -> pa.Table | None:
    """The interval table of one side, or None where its tokens don't spell the units."""
    stop = np.cumsum(table.sizes[ids])
    if (stop[-1] if len(stop) else 0) != len(whole) or (table.spell(ids) != whole).any():
        return None
    start = np.r_[0, stop[:-1]] if len(stop) else stop
    unit = np.searchsorted(starts, start, "right") - 1
    return pa.table({k: v.astype(np.int32) for k, v in {"unit": unit, "id": ids, "start": start, "stop": stop}.items()})


# each overlap once: by A's start inside a token of B, or by B's start strictly inside a token of A
_LINKS = """
SELECT a.unit AS unit, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.start >= b.start
UNION ALL SELECT b.unit, a.id, b.id FROM b ASOF JOIN a ON b.start > a.start WHERE b.start < a.stop
ORDER BY unit
"""
_GROUPS = """
WITH both_start AS (SELECT start FROM a SEMI JOIN b USING (start)),
 tokens AS (SELECT unit, id, start, 0 AS side FROM a UNION ALL SELECT unit, id, start, 1 FROM b),
 cut AS (SELECT t.*, CASE WHEN c.start IS NULL THEN 0 ELSE 1 END AS opens FROM tokens t LEFT JOIN both_start c USING (start))
SELECT unit, side, id, CAST(sum(opens) OVER (PARTITION BY side ORDER BY start ROWS UNBOUNDED PRECEDING) AS INTEGER) AS grp FROM cut ORDER BY grp, side, start
"""


class Aligned:
    """What DuckDB finds for the units of a slice: tokens, groups, links and the digest's text of each unit."""

    def __init__(self, tools: Units, units: list[str]):
        # a mark becomes a space in B's pieces, so its unit isn't spelled; other units may only fail together with a whole slice, which is then looked at one by one
        self.fits = np.fromiter((MARK not in u for u in units), bool, len(units))
        sides = self._sides(tools, units)
        if sides is None:
            for k in np.flatnonzero(self.fits):
                alone = np.zeros(len(units), bool)
                alone[k] = True
                self.fits[k] = self._sides(tools, units, alone) is not None
            sides = self._sides(tools, units)
        for name, side in zip("ab", sides, strict=True):
            tools.duck.register(name, side)
        links, rows = tools.duck.sql(_LINKS).to_arrow_table(), tools.duck.sql(_GROUPS).to_arrow_table()
        tools.duck.unregister("a")
        tools.duck.unregister("b")
        column = lambda table, name: table[name].to_numpy().astype(np.int64)
        n = len(units)
        self.links_of = B.runs_of(np.bincount(column(links, "unit"), minlength=n))
        self.pairs = column(links, "a") << 20 | column(links, "b")
        unit, side, token, group = (column(rows, c) for c in ("unit", "side", "id", "grp"))
        self.n_a, self.n_b = np.bincount(unit[side == 0], minlength=n), np.bincount(unit[side == 1], minlength=n)
        last = np.r_[group[1:] != group[:-1], np.ones(min(1, len(group)), bool)]
        self.n_groups = np.bincount(unit[last], minlength=n)
        turn = np.r_[side[1:] != side[:-1], np.zeros(min(1, len(group)), bool)]
        sign = np.where(last, ord(";"), np.where(turn, ord("|"), ord(","))).astype(np.uint8)
        self.text_of = _written(token, sign, unit, n)
        self.rows = rows

    def _sides(self, tools: Units, units: list[str], chosen: np.ndarray | None = None) -> list[pa.Table] | None:
        """The token tables of the chosen units, or None if one side doesn't spell them; starts count over the chosen units alone."""
        chosen = self.fits if chosen is None else chosen
        some = [u for u, c in zip(units, chosen, strict=True) if c]
        coded = [u.encode() for u in some]
        sizes = np.zeros(len(units), np.int64)
        sizes[chosen] = np.fromiter(map(len, coded), np.int64, len(coded))
        starts, whole = B.runs_of(sizes), np.frombuffer(b"".join(coded), np.uint8)
        del coded
        sides = [_token_table(ids, table, starts, whole) for ids, table in zip(tools.tokens(some), (tools.bytes_a, tools.bytes_b), strict=True)]
        return None if any(x is None for x in sides) else sides


def _written(ids: np.ndarray, sign: np.ndarray, unit: np.ndarray, n: int) -> list[bytes]:
    """For each unit its ids in decimal, each followed by its sign."""
    width = len(str(int(ids.max(initial=0))))
    digits = np.zeros((len(ids), width + 1), np.uint8)
    rest = ids.copy()
    for k in range(width - 1, -1, -1):
        digits[:, k] = rest % 10 + ord("0")
        rest //= 10
    digits[:, width] = sign
    size = np.ones(len(ids), np.int64)
    for k in range(1, width):
        size += ids >= 10**k
    shown = np.arange(width + 1) >= width - size[:, None]
    whole = memoryview(digits[shown].tobytes())
    ends = B.runs_of(np.bincount(unit, size + 1, n).astype(np.int64)).tolist()
    return [bytes(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Numbers(dict):
    """Units numbered as they come."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


def _slices(docs: DataFrame, path_a: str, path_b: str, work, schema: str) -> DataFrame:
    """work(doc_ids, number of the slice, places of each text's units, the slice's units) for each slice of the texts."""

    def run(batches):
        tools = Units.of(path_a, path_b)
        number = (TaskContext.get().partitionId() << 32) - 1
        for batch, _, _ in B.slices(batches, "text", SLICE_BYTES):
            number += 1
            numbers = _Numbers()
            places = [np.fromiter(map(numbers.__getitem__, tools.cut(" " + t)), np.uint32) if t else np.zeros(0, np.uint32) for t in batch.column(1).to_pylist()]
            found = Aligned(tools, list(numbers))
            places = [p if found.fits[p].all() else p[:0] for p in places]
            yield from work(batch.column(0).to_pylist(), number, places, found)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, schema, SLICE_BYTES)


_SLICE = "block long, doc_id long, is_doc boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, times binary, pairs binary"


def _slice_rows(doc_ids, number, places, found: Aligned):
    """A row for each text with the places of its units, and one for the slice's units: how often each is there, and its links."""
    n_links = np.diff(found.links_of)
    times = np.bincount(np.concatenate(places) if places else [], minlength=len(n_links)).astype(np.int64)
    rows = []
    for doc_id, p in zip(doc_ids, places, strict=True):
        whole = b"".join(map(found.text_of.__getitem__, p.tolist()))[:-1]
        sums = [int(x[p].sum()) for x in (found.n_a, found.n_b, found.n_groups, n_links)]
        rows.append((number, doc_id, True, *sums, hashlib.sha256(whole).hexdigest() if len(p) else "", p.tobytes(), None, None))
    rows.append((number, None, False, 0, 0, 0, 0, "", n_links.astype(np.uint32).tobytes(), times.tobytes(), found.pairs.tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 3]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _SLICE.split(", ")])


def _requests(stored: DataFrame) -> DataFrame:
    """(block, pair, n): the different pairs of each slice, and how many links of the slice are of it."""

    def run(batches):
        for batch in batches:
            for block, units, times, pairs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                weight = np.repeat(np.frombuffer(times, np.int64), np.frombuffer(units, np.uint32))
                pair, place = np.unique(np.frombuffer(pairs, np.int64), return_inverse=True)
                n = np.bincount(place, weight, len(pair)).astype(np.int64)
                held = n > 0  # units of texts without tokens alone are counted nowhere
                yield pa.RecordBatch.from_arrays([pa.array(np.full(held.sum(), block)), pa.array(pair[held]), pa.array(n[held])], ["block", "pair", "n"])

    return map_batches(stored.where("not is_doc").select("block", "units", "times", "pairs"), run, "block long, pair long, n long", SLICE_BYTES)


def _totals(requests: DataFrame) -> DataFrame:
    """(pair, total, best): links of each pair over the corpus, and whether no other pair of its B id has more.

    The table of the greatest counts has one row for each id of B's vocabulary, so its size is bounded.
    """
    totals = requests.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("__b", F.col("pair").bitwiseAND(F.lit((1 << 20) - 1)))
    most = totals.groupBy("__b").agg(F.max("total").alias("__most"))
    return totals.join(F.broadcast(most), "__b").select("pair", "total", (F.col("total") == F.col("__most")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a_id, b_id, links, best): how many pairs of overlapping occurrences each pair of ids has over the corpus."""
    found = _totals(_requests(_slices(docs, path_a, path_b, _slice_rows, _SLICE)))
    return found.select(F.shiftright("pair", 20).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("b_id"), F.col("total").alias("links"), "best")


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, place, a_ids, b_ids): the groups of each text in order, place from 0; texts without tokens have no row."""

    def work(doc_ids, number, places, found: Aligned):
        per_unit: list[list] = [[] for _ in found.text_of]
        before = None
        for unit, side, token, group in zip(*(found.rows[c].to_pylist() for c in ("unit", "side", "id", "grp")), strict=True):
            if group != before:
                per_unit[unit].append(([], []))
                before = group
            per_unit[unit][-1][side].append(token)
        for doc_id, p in zip(doc_ids, places, strict=True):
            rows = [g for k in p for g in per_unit[k]]
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), *[pa.array([g[k] for g in rows], pa.list_(pa.int32())) for k in (0, 1)]], ["doc_id", "place", "a_ids", "b_ids"])

    return _slices(docs, path_a, path_b, work, "doc_id long, place long, a_ids array<int>, b_ids array<int>")


_REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Tokens, groups and links of each text, links whose pair is the most frequent of its B id, and the sum of its links' counts."""
    stored = Stored(_slices(docs, path_a, path_b, _slice_rows, _SLICE)).read()
    requests = _requests(stored)
    answers = requests.select("block", "pair").join(_totals(requests), "pair").select("block", "pair", "total", "best")

    def add_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
        units = rows.filter(pc.invert(rows["is_doc"]))
        docs = rows.filter(rows["is_doc"])
        if not docs.num_rows:
            return _nothing()
        n_links = np.frombuffer(units["units"][0].as_py(), np.uint32)
        pairs = np.frombuffer(units["pairs"][0].as_py(), np.int64)
        order = np.argsort(answers["pair"].to_numpy())
        known = answers["pair"].to_numpy()[order]
        total, best = answers["total"].to_numpy()[order], answers["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        at = np.searchsorted(known, pairs)
        held = at < len(known)
        held[held] = known[at[held]] == pairs[held]
        ptr = B.runs_of(n_links.astype(np.int64))
        sums = []
        for value in (best, total):
            each = np.zeros(len(pairs), np.int64)
            each[held] = value[at[held]]
            whole = B.runs_of(each)
            sums.append(whole[ptr[1:]] - whole[ptr[:-1]])
        places = [np.frombuffer(x, np.uint32) for x in docs["units"].to_pylist()]
        n_best, count_sum = ([int(s[p].sum()) for p in places] for s in sums)
        same = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return same.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])

    kept = stored.drop("times")
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, _REPORT)


def _nothing() -> pa.Table:
    kinds = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _REPORT.split(", ")]
    return pa.schema(kinds).empty_table()
