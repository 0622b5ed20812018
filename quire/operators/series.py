"""Operators over ordered pages: runs, moving means, parity consensus, samples, turns, natural joins."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import constants as K


def longest_true_run(df: DataFrame, group: str, order: list[str], flag: Column) -> DataFrame:
    """For each group, where its longest run of true rows begins (from 1) and how long it is; the first wins ties (WI5)."""
    place = Window.partitionBy(group).orderBy(*order)
    rows = df.select(group, F.row_number().over(place).alias("pos"), flag.alias("flag"))
    islands = rows.where("flag").withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(group).orderBy("pos")))
    runs = islands.groupBy(group, "island").agg(F.min("pos").alias("start"), F.count("*").alias("length"))
    return runs.groupBy(group).agg(F.max(F.struct("length", -F.col("start"))).alias("m")).select(group, (-F.col("m.col2")).alias("start"), F.col("m.length").alias("length"))


def moving_mean(df: DataFrame, group: str, order: list[str], value: str, reach: int = 3, out: str = "mean") -> DataFrame:
    """Mean over 2 reach + 1 rows, where rows beyond the ends count as 0 (WI6)."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn(out, F.sum(value).over(w) / (2 * reach + 1))


def projection_run(values: list[float], threshold: float = 0.10, close: float = 0.02, reach: int = 3) -> tuple[int, int]:
    """The longest run of a smoothed projection above the threshold, small gaps closed; the whole if there is none (WI6)."""
    import numpy as np

    x = np.asarray(values, float)
    width = min(2 * reach + 1, len(x))
    flags = np.convolve(x, np.ones(width) / width, "same") > threshold
    gap = max(3, round(len(x) * close))
    on = np.flatnonzero(flags)
    for a, b in zip(on[:-1], on[1:], strict=False):
        if 1 < b - a <= gap:
            flags[a:b] = True
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(int), 0]))
    if not len(edges):
        return 0, len(x)
    starts, ends = edges[::2], edges[1::2]
    best = int(np.argmax(ends - starts))
    return int(starts[best]), int(ends[best])


def consensus_boxes(df: DataFrame, book: str, idx: str, box: list[str], foreground: str, size: list[str], padding: int = K.CROP_PADDING) -> DataFrame:
    """Crop boxes: weak boxes of sparse pages take the median box of their odd or even pages; then padded and clamped (AG3, AG4)."""
    side = [F.col(book), (F.col(idx) % 2).alias("__side")]
    medians = df.groupBy(*side).agg(*[F.bround(F.median(c)).cast("int").alias(f"__{c}") for c in box])
    rows = df.withColumn("__side", F.col(idx) % 2).join(medians, [book, "__side"])
    left, top, right, bottom = box
    sparse = F.col(foreground) < K.SPARSE_FOREGROUND

    def weak(a: str, b: str) -> Column:
        return sparse & (F.col(b) - F.col(a) < F.greatest(F.lit(1), F.col(f"__{b}") - F.col(f"__{a}")) * K.LEAST_SPAN)

    across, down = weak(left, right), weak(top, bottom)
    picked = {c: F.when(across if c in (left, right) else down, F.col(f"__{c}")).otherwise(F.col(c)) for c in box}
    rows = rows.withColumns({f"__p{c}": v for c, v in picked.items()})
    out = {left: F.greatest(F.lit(0), F.col(f"__p{left}") - padding), top: F.greatest(F.lit(0), F.col(f"__p{top}") - padding), right: F.least(F.col(size[0]), F.col(f"__p{right}") + padding), bottom: F.least(F.col(size[1]), F.col(f"__p{bottom}") + padding)}
    return rows.withColumns(out).select(*df.columns)


def sampled_median(df: DataFrame, group: str, order: list[str], value: str, most: int = K.RENDER_SAMPLE, low: float = K.RENDER_LOW, high: float = K.RENDER_HIGH, default: float = K.RENDER_DEFAULT, out: str = "median") -> DataFrame:
    """Median of `most` evenly spaced rows of each group, clamped; the default where it is below `low` or there is none (AG5)."""
    place = Window.partitionBy(group).orderBy(*order)
    rows = df.withColumn("__p", F.row_number().over(place) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(group)))
    steps = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (most - 1)).cast("long"))
    chosen = rows.where((F.col("__n") <= most) | F.array_contains(steps, F.col("__p").cast("long")))
    middle = F.median(value)
    return chosen.groupBy(group).agg(F.when(middle >= low, F.least(middle, F.lit(float(high)))).otherwise(float(default)).alias(out))


def page_ratio(pages: DataFrame, book: str, width: str, height: str) -> DataFrame:
    """The usual width to height of each book's pages: the median, or 1 where no page has a size (AG1)."""
    sized = (F.col(width) > 0) & (F.col(height) > 0)
    return pages.groupBy(book).agg(F.coalesce(F.median(F.when(sized, F.col(width) / F.col(height))), F.lit(1.0)).alias("ratio"))


def net_turns(df: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """Quarter turns that are left over after all turns, pages back in place dropped (AG11)."""
    return df.groupBy(*keys).agg(F.pmod(F.sum(delta), F.lit(4)).cast("int").alias("turns")).where("turns <> 0")


class _Middle:
    """The median of the values so far, from how often each different one was there."""

    def __init__(self):
        self.values: list[float] = []
        self.counts: dict[float, int] = {}
        self.n = 0
        self.at = 0  # place in `values` of the lower median, and how many values lie before that place
        self.before = 0

    def add(self, x: float) -> None:
        if x not in self.counts:
            k = bisect.bisect_left(self.values, x)
            self.values.insert(k, x)
            if self.n and k <= self.at:
                self.at += 1
        self.counts[x] = self.counts.get(x, 0) + 1
        if self.n and x < self.values[self.at]:
            self.before += 1
        self.n += 1
        lower = (self.n - 1) // 2
        while self.before > lower:
            self.at -= 1
            self.before -= self.counts[self.values[self.at]]
        while self.before + self.counts[self.values[self.at]] <= lower:
            self.before += self.counts[self.values[self.at]]
            self.at += 1

    def whole(self) -> int:
        """The median as an integer, halves to even."""
        low = self.values[self.at]
        shared = self.n % 2 or self.before + self.counts[low] > self.n // 2
        return round(low if shared else (low + self.values[self.at + 1]) / 2)


class SizeClusters:
    """Greedy clusters of page sizes around running medians, for pages that come in order."""

    def __init__(self, least_pages: int):
        self.least_pages = least_pages
        self.n = 0
        self.clusters: list[list] = []  # number of pages, and the medians of width and height

    def add(self, w: float, h: float) -> None:
        self.n += 1
        for c in self.clusters:
            mw, mh = c[1].whole(), c[2].whole()
            if abs(w - mw) <= max(10, int(0.035 * mw)) and abs(h - mh) <= max(10, int(0.035 * mh)):
                break
        else:
            c = [0, _Middle(), _Middle()]
            self.clusters.append(c)
        c[0] += 1
        c[1].add(w)
        c[2].add(h)

    def common(self) -> tuple[float | None, float | None]:
        """Width and height of the largest cluster, the first of equals, if it is large enough."""
        best = max(self.clusters, key=lambda c: c[0], default=[0])
        if self.n < self.least_pages or best[0] < max(6, int(0.2 * self.n)):
            return None, None
        return float(best[1].whole()), float(best[2].whole())


def greedy_sizes(df: DataFrame, group: str, order: str, width: str, height: str, least_pages: int = 6) -> DataFrame:
    """The dominant page size of each group by greedy clusters around running medians, or null (AG2).

    Order matters, so a group's pages stream through one task's fold, equal places by their sizes; it holds how often each
    size occurs in a cluster, and no pages.  Pages without a size don't count; a group without others has nulls.
    """
    kind = dict(df.dtypes)[group]

    class Sizes:
        def __init__(self):
            self.group, self.found = None, SizeClusters(least_pages)

        def eval(self, row):
            self.group = row["g"]
            if row["w"] is not None and row["h"] is not None and row["w"] >= 300 and row["h"] >= 300:
                self.found.add(row["w"], row["h"])

        def terminate(self):
            yield self.group, *self.found.common()

    fold = F.udtf(Sizes, returnType=f"{group} {kind}, common_width double, common_height double")
    rows = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(width).cast("double").alias("w"), F.col(height).cast("double").alias("h"))
    return fold(rows.asTable().partitionBy("g").orderBy("o", "w", "h"))


def _at_most(x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending numbers, the first and the place after the last one whose difference to it, as doubles, is `most` or less.

    A rounded difference grows with the number it is taken from, so these are a range; a search by x - most finds it but for rounding.
    """
    n = len(x)
    low, high = np.searchsorted(x, x - most, "left"), np.searchsorted(x, x + most, "right")
    while (m := (low > 0) & (x - x[low - 1] <= most)).any():
        low = low - m
    while (m := x - x[low] > most).any():
        low = low + m
    while (m := (high < n) & (x[np.minimum(high, n - 1)] - x <= most)).any():
        high = high + m
    while (m := x[high - 1] - x > most).any():
        high = high - m
    return low, high


def _weight_below(rank: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query, the weight of the places low to high (without it) whose rank is below `bound`; bit by bit, so n log n in all."""
    total, low, high = np.zeros(len(low), np.int64), low.copy(), high.copy()
    for bit in reversed(range(int(max(rank.max(), bound.max())).bit_length())):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        sums = np.concatenate([[0], np.cumsum(np.where(one, 0, weight))])
        up = (bound >> bit & 1).astype(bool)
        total += np.where(up, sums[high] - sums[low], 0)
        low, high = (np.where(up, zeros[-1] + k - zeros[k], zeros[k]) for k in (low, high))
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        rank, weight = rank[order], weight[order]
    return total


def _pairs_of(x: np.ndarray, y: np.ndarray, n: np.ndarray, own: np.ndarray, most_x: float, most_y: float) -> int:
    """Pairs within both bands, of which the lower by (x, y) is one of `own`; n counts the rows of each different point."""
    order = np.lexsort((y, x))
    x, y, n, own = x[order], y[order], n[order], own[order]
    xs, at = np.unique(x, return_inverse=True)
    ys, rank = np.unique(y, return_inverse=True)
    last = np.searchsorted(at, _at_most(xs, most_x)[1])[at]  # the place after the last point near by x
    first = np.arange(1, len(x) + 1)
    y_low, y_high = (edge[rank] for edge in _at_most(ys, most_y))
    ask = own & (first < last)
    pairs = (n[own] * (n[own] - 1) // 2).sum()
    if ask.any():
        near = _weight_below(rank, n, first[ask], last[ask], y_high[ask]) - _weight_below(rank, n, first[ask], last[ask], y_low[ask])
        pairs += (n[ask] * near).sum()
    return int(pairs)


def _pairs_by(df: DataFrame, keys: list[str], x: str, y: str, most_x: float, most_y: float) -> DataFrame:
    """(*keys, pairs): pairs of rows within both bands.  Equal points are one with their number; a bucket of x meets the next one alone."""
    usable = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    points = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where(usable("__x") & usable("__y"))
    points = points.groupBy(*keys, "__x", "__y").agg(F.count("*").alias("__n"))
    width = most_x * (1 + 2**-20) or 1.0  # a little more, so that a difference that is rounded down to most_x spans two buckets
    own = F.floor(F.col("__x") / width)
    dealt = points.select("*", F.explode(F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own - 1).alias("b"), F.lit(False).alias("own")))).alias("__to")).select(*keys, "__x", "__y", "__n", F.col("__to.b").alias("__b"), F.col("__to.own").alias("__own"))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("__pairs", T.LongType())])

    def count(t: pa.Table) -> pa.Table:
        x, y, n, own = (t[c].to_numpy() for c in ("__x", "__y", "__n", "__own"))
        pairs = _pairs_of(x, y, n, own.astype(bool), most_x, most_y) if own.any() else 0
        return t.select(keys).slice(0, 1).append_column("__pairs", pa.array([pairs], pa.int64()))

    return dealt.groupBy(*keys, "__b").applyInArrow(count, schema).groupBy(*keys).agg(F.sum("__pairs").alias("pairs"))


def band_pairs(df: DataFrame, group: str, id_: str, x: str, y: str, most_x: float, most_y: float) -> DataFrame:
    """For each group that has some, how many pairs i < j lie within both bands (JN7), x and y as doubles.

    Pairs are counted, not made: points are sorted by x, and each asks how many of those after it, within x's band, lie within y's.
    That takes n log n steps.  Rows of one id are no pair, so where an id comes more than once, its own pairs are taken off.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(id_).isNotNull())
    again = rows.groupBy(group, id_).agg(F.count("*").alias("__copies")).where("__copies > 1").drop("__copies")
    same = _pairs_by(rows.join(again, [group, id_]), [group, id_], x, y, most_x, most_y).groupBy(group).agg(F.sum("pairs").alias("__same"))
    found = _pairs_by(rows, [group], x, y, most_x, most_y).join(same, group, "left")
    return found.select(group, (F.col("pairs") - F.coalesce("__same", F.lit(0))).alias("pairs")).where("pairs > 0")


def page_order(df: DataFrame) -> DataFrame:
    """Pages by spine place, then place inside it; pages without a spine place come last (SO4)."""
    return df.withColumn("spine_idx", F.coalesce("spine_idx", F.lit(K.FALLBACK_SPINE))).orderBy("spine_idx", "sub_idx")
