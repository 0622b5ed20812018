"""First-wins and near-match dedup. First-wins is a min_by aggregate, so rows of a hot key are combined before the shuffle."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import checkpoint


def first_wins(df: DataFrame, key: Column | str, order: list[str], last: bool = False) -> DataFrame:
    """One row of each key: the first (or last) by the order columns (WI1, JN6 with a key of both sides)."""
    pick = F.max_by if last else F.min_by
    key = F.col(key) if isinstance(key, str) else key
    row = pick(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("__row")
    return df.groupBy(key.alias("__key")).agg(row).select("__row.*")


def ranked_union(parts: list[DataFrame], key, order: str, most: int) -> DataFrame:
    """Rows of several ranked lists, list by list, the first of each key, `most` at most (SE1)."""
    tagged = [p.withColumn("__list", F.lit(i)) for i, p in enumerate(parts)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p)
    return first_wins(whole, key, ["__list", order]).orderBy("__list", order).limit(most).drop("__list")


def greedy_leaders(df: DataFrame, group: str, order: str, vector: str, least: float, protected: str | None = None) -> DataFrame:
    """Adds `kept`: in order, a row goes if its vector's correlation with a kept one is `least` or more (WI4).

    Protected rows are kept and not compared.  Rows are ordered by `order`, equal ones by all their columns.

    A copy of an earlier row of its group always goes, so of equal vectors only the first reaches the fold: what is left of a hot
    group are its different vectors.  The fold streams them by in order and holds the kept ones alone.  As the result
    depends on the order, a group is one task's fold, which takes time by its rows times its leaders.
    A vector that is null, empty or of one value correlates with nothing and is kept.
    """
    rows = df.withColumn("__safe", F.coalesce(F.col(protected), F.lit(False)) if protected else F.lit(False))
    value = F.col(f"`{vector}`")
    flat = F.coalesce(F.array_min(value) == F.array_max(value), F.lit(True))
    rows = rows.withColumn("__key", F.when(~F.col("__safe") & ~flat, F.sha2(F.concat_ws(",", value.cast("array<string>")), 256)))
    place = F.struct(*[F.col(f"`{c}`") for c in (order, *[x for x in df.columns if x != order])])
    rows = rows.withColumn("__place", F.to_json(place))
    first = rows.where(F.col("__key").isNotNull()).groupBy(group, "__key").agg(F.min(F.struct(F.col(f"`{order}`").alias("o"), "__place")).alias("__first"))
    rows = rows.join(first, [group, "__key"], "left")
    rows = rows.withColumn("__copy", F.col("__key").isNotNull() & ((F.col(f"`{order}`") != F.col("__first.o")) | (F.col("__place") != F.col("__first.__place"))))
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("kept", T.BooleanType())])
    folded = rows.where(~F.col("__copy")).select(*[F.col(f"`{c}`") for c in names], "__safe", "__place")

    class Leaders:
        def __init__(self):
            self.leaders: dict[int, tuple[np.ndarray, int]] = {}  # by length: a matrix with room to grow, and how many rows of it count

        def eval(self, row):
            x = np.asarray([] if row[vector] is None else row[vector], float)
            near = False
            if not row["__safe"] and len(x):
                x = x - x.mean()
                x = x / (np.linalg.norm(x) or 1.0)
                known, n = self.leaders.get(len(x), (np.zeros((64, len(x))), 0))
                near = bool((known[:n] @ x >= least).any())
                if not near and x.any():
                    known = np.concatenate([known, np.zeros_like(known)]) if n == len(known) else known
                    known[n] = x
                    self.leaders[len(x)] = known, n + 1
            yield *(row[c] for c in names), not near

    fold = F.udtf(Leaders, returnType=schema)
    kept = fold(folded.asTable().partitionBy(group).orderBy(order, "__place"))
    return kept.unionByName(rows.where("__copy").select(*[F.col(f"`{c}`") for c in names], F.lit(False).alias("kept")))


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two packed bit strings of longs."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def nearest_within(pages: DataFrame, known: DataFrame, aspect: str, words: list[str], within: int, most_aspect: int, id_: str) -> DataFrame:
    """For each page, the known bit string of least Hamming distance within limits, its own aside, ties by id.

    For few bits and wide limits, where no part of the bits need agree: a stated set of pages meets all known rows of its aspects.
    Aspects are joined by bucket: a known row is written to the three buckets it can reach.  For page fingerprints use
    nearest_fingerprint().
    """
    width = most_aspect + 1
    left = pages.withColumn("__b", F.floor(F.col(aspect) / width))
    right = known.select(F.col(id_).alias("__id"), F.col(aspect).alias("__a"), *[F.col(w).alias(f"__{w}") for w in words])
    right = right.withColumn("__b", F.explode(F.array(*[F.floor(F.col("__a") / width) + k for k in (-1, 0, 1)])))
    near = left.join(right, "__b").where((F.abs(F.col(aspect) - F.col("__a")) <= most_aspect) & (F.col(id_) != F.col("__id")))
    near = near.withColumn("__d", hamming([F.col(w) for w in words], [F.col(f"__{w}") for w in words])).where(F.col("__d") <= within)
    best = near.groupBy(id_).agg(F.min(F.struct("__d", "__id")).alias("m"))
    return best.select(id_, F.col("m.__id").alias("match_id"), F.col("m.__d").alias("distance"))


PRINT = ["aspect", "difference", "average"]


def _masks(bands: int) -> list[list[Column]]:
    """For each band the four longs of its bits: band k has the bits k, k + bands, ..., so margins of a page don't fill a band of their own."""
    out = []
    for k in range(bands):
        masks = [sum(1 << (63 - i % 64) for i in range(256) if i // 64 == w and i % bands == k) for w in range(4)]
        out.append([F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    return out


def band_pairs(pages: DataFrame, known: DataFrame, bands: int, most_aspect: int) -> DataFrame:
    """Pairs p, q of fingerprints that agree in a band of the difference hash and are near by aspect, once for each such band."""
    width = most_aspect + 1
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col("difference")[w].bitwiseAND(m) for w, m in enumerate(masks)]) for k, masks in enumerate(_masks(bands))])
    bucket = F.floor(F.col("aspect") / width)
    left = pages.select(F.struct(*PRINT).alias("p"), bucket.alias("__b"), F.posexplode(keys).alias("band", "__k"))
    right = known.select(F.struct(*PRINT).alias("q"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"), keys.alias("__ks")).select("q", "__b", F.explode("__ks").alias("__k"))
    return left.join(right, ["__b", "__k"]).where(F.abs(F.col("p.aspect") - F.col("q.aspect")) <= most_aspect).select("p", "q", "band")


def near_prints(pages: DataFrame, known: DataFrame, most_aspect: int = 8, difference_bits: int = 16, average_bits: int = 20) -> DataFrame:
    """Pairs of fingerprints within all three limits, each once: columns p and q (structs aspect, difference, average), d and a.

    Of difference_bits + 1 bands of the difference hash one agrees in full if no more than difference_bits bits differ, so
    pairs are found by equality of a band and of the aspect's bucket.  Both tables have each fingerprint once.
    """
    words = lambda c: [F.col(c)[i] for i in range(4)]
    rows = band_pairs(pages, known, difference_bits + 1, most_aspect)
    rows = rows.withColumns({"d": hamming(words("p.difference"), words("q.difference")), "a": hamming(words("p.average"), words("q.average"))})
    rows = rows.where((F.col("d") <= difference_bits) & (F.col("a") <= average_bits))
    same = lambda masks: reduce(lambda x, y: x & y, [x.bitwiseXOR(y).bitwiseAND(m) == 0 for x, y, m in zip(words("p.difference"), words("q.difference"), masks, strict=True)])
    first = reduce(lambda rest, km: F.when(same(km[1]), km[0]).otherwise(rest), reversed([*enumerate(_masks(difference_bits + 1))]), F.lit(-1))
    return rows.where(F.col("band") == first).select("p", "q", "d", "a")


MOST = np.iinfo(np.int64).max
_RANK = 40  # bits of a key that hold the place of an id; above them are both distances


def _two_least(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the least of its keys and the least one of another id; `at` is the row of each key, ascending."""
    out = np.full((n, 2), MOST)
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first], 0] = np.minimum.reduceat(keys, first)
        other = np.where((keys ^ out[at, 0]) & ((1 << _RANK) - 1) == 0, MOST, keys)
        out[at[first], 1] = np.minimum.reduceat(other, first)
    return out


def _ring_search(asked: tuple, known: tuple, most_aspect: int, difference_bits: int, average_bits: int) -> np.ndarray:
    """Keys of the two nearest known fingerprints of different ids for each one asked for: difference, average, place of the id.

    asked and known are (aspect, difference, average), known in order of ids, whose places are its fourth part.  Rows are gathered in cells
    by how many bits they have set in each part of the difference hash, of which there are more if more rows are known.  These counts differ by no more than the bits, so a cell's
    rows go through the known cells by their distance from it and stop where no cell can have anything nearer.
    """
    split = 1 if len(known[0]) < 20_000 else 2 if len(known[0]) < 200_000 else 4
    masks = [np.uint64(sum(1 << i for i in range(k, 64, split))) for k in range(split)]
    counts = lambda words: np.stack([np.bitwise_count(words & m).sum(1) for m in masks], 1).astype(np.int16)
    cells, cell = np.unique(counts(known[1]), axis=0, return_inverse=True)
    order = np.argsort(cell.ravel(), kind="stable")
    bounds = np.searchsorted(cell.ravel()[order], np.arange(len(cells) + 1))
    own, mine = np.unique(counts(asked[1]), axis=0, return_inverse=True)
    out = np.full((len(asked[0]), 2), MOST)
    by_cell = np.argsort(mine.ravel(), kind="stable")
    for c, rows in enumerate(np.split(by_cell, np.cumsum(np.bincount(mine.ravel(), minlength=len(own)))[:-1])):
        away = np.abs(cells - own[c]).sum(1)
        for ring in np.unique(away[away <= difference_bits]):
            bound = np.minimum(out[rows, 1] >> (_RANK + 10), difference_bits)
            rows, bound = rows[bound >= ring], bound[bound >= ring]
            if not len(rows):
                break
            near = np.sort(np.concatenate([order[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(away == ring)]))
            step = max(1, 2**20 // len(rows))
            for part in (near[k : k + step] for k in range(0, len(near), step)):
                d = sum(np.bitwise_count(asked[1][rows, w, None] ^ known[1][None, part, w]).astype(np.int16) for w in range(4))
                at, to = np.nonzero((d <= bound[:, None]) & (np.abs(asked[0][rows, None] - known[0][None, part]) <= most_aspect))
                a = sum(np.bitwise_count(asked[2][rows[at], w] ^ known[2][part[to], w]).astype(np.int64) for w in range(4))
                fits = a <= average_bits
                at, to, a = at[fits], to[fits], a[fits]
                found = _two_least((d[at, to].astype(np.int64) << 10 | a) << _RANK | known[3][part[to]], at, len(rows))
                both = np.concatenate([out[rows], found], 1)
                flat, of = both.ravel(), np.repeat(np.arange(len(rows)), 4)
                out[rows] = _two_least(flat, of, len(rows))
    return out


def _nearest_two(pages: DataFrame, known: DataFrame, id_: str, most_aspect: int, difference_bits: int, average_bits: int, part: int = 50_000, slice_: int = 500_000) -> DataFrame:
    """(p, d, a, match_id): for each different fingerprint of pages the two nearest known rows of different ids, of each slice of the known ones.

    For fingerprints of few bits, which agree in bands by chance: no pair is a row.  Rows meet by aspect bucket; parts of the pages and
    slices of the known rows have a bounded number of rows, each part meets each slice in a task of its own.
    """
    bucket = F.floor(F.col("aspect") / (most_aspect + 1))
    most = lambda df: df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rows = most(pages)
    parts, slices = max(-(-rows // part), min(16, -(-rows // 2500))) or 1, -(-most(known) // slice_) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = pages.select(*PRINT, (F.pmod(F.xxhash64("difference"), F.lit(parts)).cast("int")).alias("__part"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b")).select("*", each(slices).alias("__slice"))
    # of one table, both sides would have the same columns, which a cogroup can't tell apart
    held = known.select(*[F.col(c).alias(c) for c in (id_, *PRINT)], bucket.alias("__b"), F.pmod(F.xxhash64(F.col(id_)), F.lit(slices)).cast("int").alias("__slice")).select("*", each(parts).alias("__part"))
    kinds = {f.name: f.dataType for f in pages.schema}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in PRINT], T.StructField("d", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("match_id", known.schema[id_].dataType)])

    def words(column) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 4)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by(id_)
        ids, place = right[id_], np.zeros(right.num_rows, np.int64)
        if right.num_rows:
            place[1:] = np.cumsum(pc.not_equal(ids.combine_chunks().slice(1), ids.combine_chunks().slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False))
        aspect = lambda t: t["aspect"].to_numpy().astype(np.int64)
        rows = np.zeros((0, 2), np.int64)
        if left.num_rows and right.num_rows:
            rows = _ring_search((aspect(left), words(left["difference"]), words(left["average"])), (aspect(right), words(right["difference"]), words(right["average"]), place), most_aspect, difference_bits, average_bits)
        at, rank = np.nonzero(rows < MOST)
        key = rows[at, rank]
        match = ids.take(pa.array(np.searchsorted(place, key & ((1 << _RANK) - 1))))
        out = left.select(PRINT).take(pa.array(at))
        out = out.append_column("d", pa.array((key >> (_RANK + 10)).astype(np.int32))).append_column("a", pa.array((key >> _RANK & 1023).astype(np.int32)))
        return out.append_column("match_id", match)

    keys = ["__b", "__slice", "__part"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, schema)
    return found.select(F.struct(*PRINT).alias("p"), "d", "a", "match_id")


def chance_pairs(pages: DataFrame, known: DataFrame, bands: int, most_aspect: int) -> int:
    """How many rows band_pairs() would join, from the sizes of its groups."""
    width = most_aspect + 1
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col("difference")[w].bitwiseAND(m) for w, m in enumerate(masks)]) for k, masks in enumerate(_masks(bands))])
    sizes = lambda df, name: df.select(F.floor(F.col("aspect") / width).alias("__b"), F.explode(keys).alias("__k")).groupBy("__b", "__k").agg(F.count("*").alias(name))
    near = sizes(known, "__m").select(F.explode(F.array(*[F.col("__b") + k for k in (-1, 0, 1)])).alias("__b"), "__k", "__m").groupBy("__b", "__k").agg(F.sum("__m").alias("__m"))
    return int(sizes(pages, "__n").join(near, ["__b", "__k"]).agg(F.sum(F.col("__n").cast("decimal(38,0)") * F.col("__m"))).first()[0] or 0)


def nearest_fingerprint(pages: DataFrame, known: DataFrame, id_: str, most_aspect: int = 8, difference_bits: int = 16, average_bits: int = 20, chance: int = 200) -> DataFrame:
    """(id, match_id, difference_bits, average_bits): for each page the nearest known fingerprint by both distances, then by id (JN5).

    pages and known: id, aspect (in thousandths), difference and average (four longs each).  A page doesn't match the row of its own id.
    Copies are one fingerprint with its two least ids, so their number makes no pairs.  Rows without a
    fingerprint have no match and are none.

    Pairs are found by equal bands where these make at most `chance` candidates for each row; fingerprints of few bits agree in bands
    by chance, and are searched for by their counts of bits.  Both ways find the same.
    """
    usable = lambda df: df.where(F.col("aspect").isNotNull() & (F.size("difference") == 4) & (F.size("average") == 4) & F.col(id_).isNotNull()).select(id_, *PRINT)
    pages, known = checkpoint(usable(pages)), checkpoint(usable(known))
    first = known.groupBy(*PRINT).agg(F.min(id_).alias("__first"))
    second = known.join(first, PRINT).where(F.col(id_) != F.col("__first")).groupBy(*PRINT).agg(F.min(id_).alias("__second"))
    named = first.join(second, PRINT, "left")
    once = pages.select(*PRINT).distinct()
    rows = pages.select(F.col(id_), F.struct(*PRINT).alias("p"))
    if chance_pairs(once, first, difference_bits + 1, most_aspect) <= chance * known.count():
        near = near_prints(once, first.select(*PRINT), most_aspect, difference_bits, average_bits)
        rows = rows.join(near.join(named.select(F.struct(*PRINT).alias("q"), "__first", "__second"), "q"), "p")
        rows = rows.withColumn("match_id", F.when(F.col("__first") != F.col(id_), F.col("__first")).otherwise(F.col("__second"))).where(F.col("match_id").isNotNull())
    else:
        two = named.select(*PRINT, F.explode(F.array_compact(F.array("__first", "__second"))).alias(id_))
        rows = rows.join(_nearest_two(once, two, id_, most_aspect, difference_bits, average_bits), "p").where(F.col("match_id") != F.col(id_))
    best = rows.groupBy(id_).agg(F.min(F.struct("d", "a", "match_id")).alias("m"))
    return best.select(id_, "m.match_id", F.col("m.d").cast("int").alias("difference_bits"), F.col("m.a").cast("int").alias("average_bits"))
