"""Phrase collocations: phrases of two or three words that are likelier together than the words of their weakest cut.

Texts are cut into pieces at punctuation and line ends, and equal pieces of a language become one row with a multiplicity,
so a passage that thousands of documents share is read once.  N-grams are counted by DuckDB in each hash bucket of
pieces, which are the files that the shuffle by piece has written: a task inserts the bucket's n-grams with their weights into
a table that DuckDB may spill, and hands on one row for each different n-gram, now and then if there are many.  Spark adds up
the buckets' counts.

Counting goes by length.  A phrase that is frequent enough has only frequent parts, so pairs are counted of frequent
words, and triples of frequent pairs.  The parts are told by a bit set of a fixed size, which lets all frequent parts pass
and few others, and counts are compared with the threshold in the end; so nothing is lost, at any size of the input.

A candidate asks for the counts of its parts: requests and counts are shuffled by part, and the answers by phrase.

Defined cases: a null text is empty; a null language is `und`, as is that name itself; repeated rows count each time; a
table without candidates gives no rows; other columns are left out.  Equal scores and counts are ordered by phrase.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import Stored, bit_filter, map_batches, passes, shared_folder

#: Words of a phrase, counts of a candidate, percent of its count that a longer phrase needs to take it in, phrases reported of a language.
LONGEST, LEAST, ABSORBED, REPORTED = 3, 10, 50, 2000
#: What DuckDB may hold in memory of a bucket's counts; the rest is spilled.
MEMORY = "256MB"
#: N-grams that a task gathers before it hands their counts on.
GATHERED = 1 << 23

# The bytes that end a piece, and the language of texts without one.
BREAKS = b".,;:!?\n\x0b\x0c\r"
NO_LANGUAGE = "und"

_PLAIN = bytes(0x0A if b in BREAKS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n): the different pieces of each language, lower-cased, words joined by single spaces, and how often each is there."""

    def run(batches):
        for batch, data, offsets in B.slices(batches, "text"):
            counts: dict[str, Counter] = {}
            whole = data.tobytes().translate(_PLAIN)
            ends = offsets.tolist()
            for lang, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                counts.setdefault(lang, Counter()).update([b" ".join(words) for p in whole[a:b].split(b"\n") if (words := p.split())])
            for lang, found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["lang", "piece", "n"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    data, offsets = B.buffers(langs)
    return B.hashes(data, offsets[:-1], offsets[1:], B.IDENTITY)


def _bits(grams: DataFrame) -> np.ndarray:
    """The bit set of (lang, phrase)."""

    def run(batches):
        for batch, data, offsets in B.slices(batches, "phrase"):
            h = B.mix(B.hashes(data, offsets[:-1], offsets[1:], B.IDENTITY) + _lang_hashes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return bit_filter(map_batches(grams.select("lang", "phrase"), run, "h long"))


def counted(different: DataFrame, size: int, parts: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, n) of all phrases of `size` words; with the bit set of frequent phrases of a word less, those whose parts pass it.

    different: as pieces() gives it, stored, so that a file is a hash bucket.
    """
    spill = _spill_root(different)

    def run(batches):
        import duckdb

        scratch = os.path.join(spill or os.getcwd(), f"quire-spill-{uuid.uuid4().hex}")
        langs: dict[str, int] = {}
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as duck:
            try:
                duck.execute("CREATE TABLE grams (lang INTEGER, phrase VARCHAR, n BIGINT)").fetchall()
                gathered = 0
                for batch, data, offsets in B.slices(batches, "piece"):
                    table = _grams(batch, data, offsets, size, parts, langs)
                    duck.register("slice", table)
                    duck.execute("INSERT INTO grams SELECT lang, phrase, n FROM slice").fetchall()
                    duck.unregister("slice")
                    gathered += table.num_rows
                    if gathered >= GATHERED:
                        yield from _sums(duck, langs)
                        duck.execute("TRUNCATE grams").fetchall()
                        gathered = 0
                yield from _sums(duck, langs)
            finally:
                shutil.rmtree(scratch, ignore_errors=True)

    found = map_batches(different.select("lang", "piece", "n"), run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _sums(duck, langs: dict[str, int]):
    """The counts of a task's n-grams so far, in batches."""
    names = pa.array(list(langs), pa.string())
    for found in duck.sql("SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS n FROM grams GROUP BY lang, phrase").to_arrow_reader(1 << 16):
        yield pa.RecordBatch.from_arrays([names.take(found.column(0)), found.column(1), found.column(2)], ["lang", "phrase", "n"])


def _spill_root(df: DataFrame) -> str | None:
    """The shared folder where it is one of a file system, for what a task spills and removes; elsewhere a task spills where Spark does."""
    where = urlparse(shared_folder(df.sparkSession))
    return where.path if where.scheme in ("", "file") else None


def _grams(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, size: int, parts: np.ndarray | None, langs: dict[str, int]) -> pa.Table:
    """The phrases of `size` words of a slice of pieces, each with its piece's multiplicity."""
    starts, ends, ptr = B.spans(data != 0x20, offsets)
    row = np.repeat(np.arange(batch.num_rows), np.diff(ptr))
    first = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
    if parts is not None:
        hasher, of_lang = B.Hasher(data, B.IDENTITY), _lang_hashes(batch.column(0))
        passed = np.ones(len(first), bool)
        for k in (0, 1):
            a, b = starts[first + k], ends[first + k + size - 2]
            passed &= passes(parts, B.mix(hasher.of(a, b) + of_lang[row[first]]))
        first = first[passed]
    a, b = starts[first], ends[first + size - 1]
    spelled = data[B.ragged(a, b - a)]
    phrases = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(B.runs_of(b - a)), pa.py_buffer(spelled)])
    code = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], np.int32)
    times = batch.column(2).to_numpy()
    return pa.table({"lang": code[row[first]], "phrase": phrases, "n": times[row[first]]})


def mined(docs: DataFrame, least: int = LEAST, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that no longer one takes in; the weakest cut counts, the first of equals."""
    different = Stored(pieces(docs)).read()
    words = Stored(counted(different, 1)).read()
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = [words.where(F.col("n") >= least)]
    for size in range(2, LONGEST + 1):
        frequent.append(Stored(counted(different, size, _bits(frequent[-1])).where(F.col("n") >= least)).read())
    candidates = None
    for size, found in enumerate(frequent[1:], 2):
        rows = found.select("lang", "phrase", F.col("n").alias("a"), F.lit(size).alias("size"))
        candidates = rows if candidates is None else candidates.unionByName(rows)
    scored = _scored(candidates, frequent)
    return _not_taken_in(scored, candidates, absorbed).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def _scored(candidates: DataFrame, frequent: list[DataFrame]) -> DataFrame:
    """Candidates with l, r and score of their weakest cut."""
    counts = frequent[0].select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    for found in frequent[1:-1]:
        counts = counts.unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    words = F.split("phrase", " ")
    join = lambda x: F.array_join(x, " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.array(join(F.slice(words, F.lit(1), k)), join(F.slice(words, k + 1, F.col("size")))).alias("parts")))
    requests = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.k", F.posexplode("cut.parts").alias("side", "part"))
    answers = requests.join(counts, ["lang", "part"])
    both = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    exact = both.withColumn("score", F.expr("cast(1000000BD * cast(a as decimal(18,0)) * cast(a as decimal(18,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)"))
    cut = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return exact.groupBy("lang", "phrase", "a").agg(cut.alias("c")).select("lang", "phrase", "a", "c.*")


def _not_taken_in(scored: DataFrame, candidates: DataFrame, absorbed: int) -> DataFrame:
    """Candidates without those whose words lie in a longer candidate that is frequent enough beside them."""
    words = F.split("phrase", " ")
    inner = F.transform(
        F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.struct(i.alias("i"), m.alias("m"))))), lambda x: x["m"] >= 2),
        lambda x: F.array_join(F.slice(words, x["i"], x["m"]), " "),
    )
    longer = candidates.where(F.col("size") > 2).select("lang", F.col("a").alias("__a"), F.explode(inner).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("__a").alias("__most"))
    return scored.join(most, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("__most") >= absorbed * F.col("a"), F.lit(False))).drop("__most")


def top(docs: DataFrame, most: int = REPORTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and phrase; ranks from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return mined(docs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
