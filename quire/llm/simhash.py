"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints are computed inside tasks from whole texts.  Distinct fingerprints are dealt out by blocks of
their bits: of radius + 1 blocks, two fingerprints at distance <= radius share one.  Buckets that are too
large are dealt again by blocks of the remaining bits, so no bucket grows with the corpus unless its
fingerprints agree in three blocks.  Inside a bucket the fingerprints are sorted by Gray rank and grouped
into nodes of eight, sixty-four, ...; a node keeps the bits that all its members share.  Two nodes are
compared by the shared bits in which they differ: more than `radius` of them prunes both groups at once,
and if all their members must be within the radius they are linked at once.  A bucket gives a spanning
forest, never all pairs; components of the forests' edges are found by star contraction.

Defined cases: a null or word-less text has fingerprint 0 and links like any other; fewer words than the
width make one shingle; repeated rows each get a row; a null doc_id takes part but never names a component
(a component of null ids only has a null id); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _bytes as B
from quire.llm._spark import checkpoint, map_batches
from quire.llm._xxh64 import xxh64
from quire.llm.components import components

#: Byte counters of eight bits: entry x holds bit i of x in its byte i.
_SPREAD = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) @ (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8)))
FANOUT = 8


def fingerprint_slice(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    """SimHash of each text of a slice: bit set where over half of the shingles' hashes have it."""
    starts, ends, ptr = B.words(data, offsets)
    counts = np.diff(ptr)
    lengths = ends - starts
    out = np.zeros(len(counts), np.uint64)
    if not len(starts):
        return out
    index = B.ragged(starts, lengths + 1)
    joined = B.LOWER[data[np.minimum(index, len(data) - 1)]]
    begin = B.runs_of(lengths + 1)[:-1]
    joined[begin + lengths] = 0x20
    finish = begin + lengths
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = B.ragged(ptr[:-1], shingles)
    last = first + np.repeat(np.where(counts >= width, width, counts) - 1, shingles)
    h = xxh64(joined, begin[first], finish[last], seed)
    of = B.runs_of(shingles)
    pieces = -(-shingles // 255)
    cuts = np.repeat(of[:-1], pieces) + 255 * B.ragged(np.zeros(len(pieces), np.int64), pieces)
    byte_sums = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    bits = byte_sums.view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    full = np.flatnonzero(shingles)
    totals = np.add.reduceat(bits, B.runs_of(pieces)[:-1][full], axis=0)
    on = totals * 2 > shingles[full, None]
    out[full] = np.packbits(on, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _keyed_fingerprints(keyed: DataFrame, width: int, seed: int) -> DataFrame:
    """(key, fp) for each row of (key, text); fp is the 64-bit fingerprint as a signed long."""

    def run(batches):
        for batch, data, offsets in B.slices(batches, "text"):
            fp = fingerprint_slice(data, offsets, width, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["key", "fp"])

    kind = keyed.schema["key"].dataType.simpleString()
    return map_batches(keyed.select("key", F.col("text").cast("string").alias("text")), run, f"key {kind}, fp long")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row."""
    return _keyed_fingerprints(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), width, seed).withColumnRenamed("key", "doc_id")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray sequence."""
    x = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class _Forest:
    """Union-find over 0..n-1, with arrays of edges at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> bool:
        changed = False
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            changed = True
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
        return changed


class GrayIndex:
    """Fingerprints of some buckets in Gray order under nodes of shared bits; links() gives each member's least linked member."""

    CHUNK = 1 << 17

    def __init__(self, keys: np.ndarray, fp: np.ndarray, radius: int):
        self.order = np.lexsort((gray_rank(fp), keys))
        self.radius = radius
        fp, keys = fp[self.order], keys[self.order]
        self.n = len(fp)
        level = {"shared": np.full(self.n, ~np.uint64(0)), "bits": fp, "low": keys, "high": keys}
        self.levels = [level]
        while len(level["bits"]) > 1:
            at = np.arange(0, len(level["bits"]), FANOUT)
            shared = np.bitwise_and.reduceat(level["shared"], at)
            ones = np.bitwise_and.reduceat(level["bits"] | ~level["shared"], at)
            some = np.bitwise_or.reduceat(level["bits"] & level["shared"], at)
            shared &= ~(ones ^ some)
            level = {"shared": shared, "bits": some & shared, "low": np.minimum.reduceat(level["low"], at), "high": np.maximum.reduceat(level["high"], at)}
            self.levels.append(level)

    def _expand(self, depth: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children of the pairs of nodes, each once."""
        size = len(self.levels[depth]["bits"])
        i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
        x = (a[:, None] * FANOUT + i).ravel()
        y = (b[:, None] * FANOUT + j).ravel()
        keep = (x <= y) & (y < size) if depth else (x < y) & (y < size)
        return x[keep], y[keep]

    def _below(self, depth: int, a: np.ndarray, b: np.ndarray):
        """The pairs below these pairs of nodes, piece by piece when they are asked for, so a level of the walk holds one piece."""
        step = max(1, self.CHUNK // (FANOUT * FANOUT))
        for k in range(0, len(a), step):
            x, y = self._expand(depth, a[k : k + step], b[k : k + step])
            if len(x):
                yield depth, x, y

    def links(self) -> np.ndarray:
        forest = _Forest(self.n)
        top = len(self.levels) - 1
        if not top:
            return self.order
        stack = [iter([(top, np.zeros(1, np.int64), np.zeros(1, np.int64))])]
        spread = None
        while stack:
            if (pairs := next(stack[-1], None)) is None:
                stack.pop()
                continue
            depth, a, b = pairs
            node = self.levels[depth]
            near = (node["low"][b] <= node["high"][a]) & (node["low"][a] <= node["high"][b])
            common = node["shared"][a] & node["shared"][b]
            differ = np.bitwise_count((node["bits"][a] ^ node["bits"][b]) & common)
            near &= differ <= self.radius
            if depth == 0:
                near &= a < b
                if forest.link(a[near], b[near]):
                    spread = None
                continue
            if spread is None:
                spread = [(forest.label, forest.label)]
                for level in self.levels[1:]:
                    at = np.arange(0, len(spread[-1][0]), FANOUT)
                    spread.append((np.minimum.reduceat(spread[-1][0], at), np.maximum.reduceat(spread[-1][1], at)))
            low, high = spread[depth]
            near &= ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            one = near & (node["low"][a] == node["high"][a]) & (node["low"][b] == node["high"][b])
            sure = one & (differ + np.bitwise_count(~common) <= self.radius)
            if sure.any():
                reach = FANOUT**depth
                for x in (a[sure], b[sure]):
                    members = B.ragged(x * reach, np.minimum(self.n, (x + 1) * reach) - x * reach)
                    forest.link(members, members // reach * reach)
                forest.link(a[sure] * reach, b[sure] * reach)
                spread = None
            a, b = a[near & ~sure], b[near & ~sure]
            by = np.argsort(b - a, kind="stable")
            stack.append(self._below(depth - 1, a[by], b[by]))
        out = np.empty(self.n, np.int64)
        out[self.order] = self.order[forest.label]
        return out


def _blocks(taken: int, radius: int, bits: int = 64) -> list[int]:
    """Masks of radius + 1 near-equal blocks of the bits that are not taken."""
    free = [i for i in range(bits) if not taken >> i & 1]
    cuts = [round(k * len(free) / (radius + 1)) for k in range(radius + 2)]
    return [sum(1 << i for i in free[p:q]) for p, q in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, radius: int = 4, bucket: int = 20_000, levels: int = 3) -> DataFrame:
    """Edges (u, v) that connect any two of the distinct fingerprints `fp` at distance <= radius, directly or over others.

    A bucket of more than `bucket` fingerprints is dealt again by the bits that its key leaves, `levels` times at most.
    """

    def keys_of(taken: int) -> list[tuple[int, int]]:
        return [(mask, taken | mask) for mask in _blocks(taken, radius)]

    def deal(df: DataFrame, masks: list[int]) -> DataFrame:
        return df.select("fp", F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for m in masks])).alias("k")).select("fp", "k.mask", "k.bits")

    dealt = deal(distinct.select("fp"), [taken for _, taken in keys_of(0)])
    level_masks = [taken for _, taken in keys_of(0)]
    for _ in range(levels - 1):
        hot = checkpoint(dealt.groupBy("mask", "bits").count().where(F.col("count") > bucket).select("mask", "bits", F.lit(True).alias("hot")))
        if hot.isEmpty():
            break
        marked = dealt.join(hot, ["mask", "bits"], "left")
        again, next_masks = None, []
        for mask in level_masks:
            taken = [t for _, t in keys_of(mask)]
            next_masks += taken
            part = deal(marked.where(F.col("hot") & (F.col("mask") == F.lit(_signed(mask)))), taken)
            again = part if again is None else again.unionByName(part)
        cool = marked.where(F.col("hot").isNull()).select("fp", "mask", "bits")
        dealt = checkpoint(cool.unionByName(again.distinct()))
        level_masks = next_masks

    def link(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        root = GrayIndex(keys, fp, radius).links()
        least = fp.view(np.int64).copy()
        np.minimum.at(least, root, fp.view(np.int64))
        u, v = fp.view(np.int64), least[root]
        far = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[far]), pa.array(v[far])], ["u", "v"]) if far.any() else None

    def run(batches):
        held_k, held_f, rows = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held_k.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_f.append(batch.column(1).to_numpy(zero_copy_only=False))
            rows += batch.num_rows
            if rows >= 200_000 and held_k[0][0] != held_k[-1][-1]:  # a bucket isn't cut, nor copied for each batch of it
                k, f = np.concatenate(held_k), np.concatenate(held_f)
                whole = int(np.searchsorted(k, k[-1], "left"))
                if (out := link(k[:whole], f[:whole].view(np.uint64))) is not None:
                    yield out
                held_k, held_f, rows = [k[whole:]], [f[whole:]], len(k) - whole
        if rows:
            k, f = np.concatenate(held_k), np.concatenate(held_f)
            if (out := link(k, f.view(np.uint64))) is not None:
                yield out

    # Two buckets may share a hash; the index links by distance alone, so that adds nothing wrong.
    keyed = dealt.select(F.xxhash64("mask", "bits").alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def _components_of(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root) of the distinct fingerprints (fp, least)."""
    roots = components(near_links(distinct, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def _with_least(placed: DataFrame, parts: int = 1000) -> DataFrame:
    """(fp, name): the least `least` of each root, given back to all its fingerprints.

    Roots with more than one in `parts` of all fingerprints are fewer than `parts`, so these are broadcast and the
    join of the others has no hot key.
    """
    names = checkpoint(placed.groupBy("root").agg(F.min("least").alias("name"), F.count("*").alias("n")))
    limit = max(1000, int(names.agg(F.sum("n")).first()[0] or 0) // parts)
    hot = F.broadcast(names.where(F.col("n") > limit).select("root", F.col("name").alias("hot_name"), F.lit(True).alias("hot")))
    marked = placed.select("fp", "root").join(hot, "root", "left")
    rest = marked.where(F.col("hot").isNull()).select("fp", "root").join(names.where(F.col("n") <= limit).select("root", "name"), "root")
    return marked.where("hot").select("fp", F.col("hot_name").alias("name")).unionByName(rest.select("fp", "name"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the least doc_id that is reachable over links of `radius` bits at most."""
    prints = checkpoint(fingerprints(docs, width, seed))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = _with_least(_components_of(distinct, radius))
    return prints.join(named, "fp").select("doc_id", "fp", F.col("name").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one document of each near-duplicate group stays.

    A document is what rows of one doc_id and text have in common.  Of a group, the document with the least doc_id
    stays, and of several texts under that doc_id the one of least hash; its repeated rows are cut to one.  Texts under
    one doc_id that are no near-duplicates are documents of their own.  Rows without a doc_id come after all others and are told
    apart by their texts.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    key = F.struct(number.alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text"))
    prints = checkpoint(_keyed_fingerprints(docs.select(key.alias("key"), "text"), width, seed))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("key").alias("least")))
    kept = _components_of(distinct, radius).groupBy("root").agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.id").alias("__id"), F.col("least.text").alias("__text"))
    names = docs.columns
    rows = docs.withColumn("__id", number).withColumn("__text", F.xxhash64(F.col("text").cast("string")))
    return rows.join(kept, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"]).select(*[F.col(f"`{c}`") for c in names])
