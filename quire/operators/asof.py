"""Joins by time: the last row before (as-of), and overlapping intervals, as pairs or summed up. All split a hot key or a dense stretch of time over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _number(df: DataFrame, name: str) -> Column:
    """A time as a number that keeps its order: microseconds of dates and timestamps, with or without a zone, and numbers as they are."""
    kind = dict(df.dtypes)[name]
    return F.unix_micros(F.col(f"`{name}`").cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(f"`{name}`").cast("double")


def _edges(values: DataFrame, parts: int) -> Column:
    """Quantiles of the column `t` as an array of at most parts - 1 different numbers; their number, and so their size, is fixed."""
    found = values.agg(F.percentile_approx("t", [k / parts for k in range(1, parts)], 10_000).alias("e")).first().e
    return F.array(*[F.lit(x) for x in sorted(set(found))]) if found else F.array().cast("array<double>")


def _bin(t: Column, edges: Column) -> Column:
    """How many edges are at or before t."""
    return F.size(F.filter(edges, lambda e: e <= t))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, fields: list[str], parts: int = 64, tie: str | None = None) -> DataFrame:
    """left with `fields` of the last right row of its key at or before its time, or nulls.

    Both sides are sorted together: a window carries the last right row forward.  The time axis is cut at quantiles into `parts` ranges
    and rows are dealt out by key and range, so a hot key is `parts` tasks' work; what a range inherits is a carry of one row
    for each key and range, summed up in a second, small window.

    Right rows of one time are ordered by `tie` (or by their fields), the last counts; null keys and times match nothing, and their left rows stay.
    """
    t_left, t_right = _number(left, time), _number(right, time)
    edges = _edges(left.select(t_left.alias("t")).union(right.select(t_right.alias("t"))), parts)
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns])
    value = F.struct(*[F.col(f"`{c}`").alias(c) for c in fields])
    order = F.col(f"`{tie}`") if tie else value
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    l = left.select(F.col(key).alias("__k"), t_left.alias("__t"), F.lit(1).alias("__side"), row.alias("__row"))  # noqa: E741
    r = right.where(usable).select(F.col(key).alias("__k"), t_right.alias("__t"), F.lit(0).alias("__side"), order.alias("__tie"), value.alias("__value"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__bin", _bin(F.col("__t"), edges))
    inside = Window.partitionBy("__k", "__bin").orderBy("__t", "__side", "__tie")
    here = both.withColumn("__last", F.last("__value", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    latest = r.withColumn("__bin", _bin(F.col("__t"), edges)).groupBy("__k", "__bin").agg(F.max_by("__value", F.struct("__t", "__tie")).alias("__value"))
    # a key's carries are `parts` rows at most: each range takes over what the ranges before it had last
    every = both.where("__side = 1").select("__k", "__bin").distinct().join(latest, ["__k", "__bin"], "full")
    before = Window.partitionBy("__k").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.withColumn("__carry", F.last("__value", True).over(before)).where(F.col("__carry").isNotNull()).select("__k", "__bin", "__carry")
    joined = here.where("__side = 1").join(carry, ["__k", "__bin"], "left")
    found = F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), F.coalesce("__last", "__carry"))
    return joined.select("__row.*", *[found[c].alias(c) for c in fields])


def overlaps(left: DataFrame, right: DataFrame, start: str, stop: str, parts: int = 200) -> DataFrame:
    """Pairs of rows, as the structs l and r, whose intervals [start, stop) overlap.

    Bins are cut at quantiles of both sides' starts, so dense stretches have narrow bins; an interval goes to the bins it touches.
    A pair is reported by one bin alone, the one in which the later of the two begins.  An interval that is empty or has a null
    end overlaps nothing.
    """
    edges = _edges(left.select(_number(left, start).alias("t")).union(right.select(_number(right, start).alias("t"))), parts)

    def dealt(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
        a, b = _number(df, start), _number(df, stop)
        # the last bin is that of the last moment before the end
        last = F.size(F.filter(edges, lambda e: e < b))
        return df.where(a < b).select(row.alias(name), a.alias(f"__{name}a"), b.alias(f"__{name}b"), _bin(a, edges).alias(f"__{name}bin"), F.explode(F.sequence(_bin(a, edges), last)).alias("__bin"))

    pairs = dealt(left, "l").join(dealt(right, "r"), "__bin")
    near = (F.col("__la") < F.col("__rb")) & (F.col("__ra") < F.col("__lb")) & (F.col("__bin") == F.greatest("__lbin", "__rbin"))
    return pairs.where(near).select("l", "r")


def _whole(df: DataFrame, name: str) -> Column:
    """A time as a long that keeps its order and distances: microseconds of dates and timestamps, and whole numbers as they are."""
    kind = dict(df.dtypes)[name]
    if kind.startswith(("timestamp", "date")):
        return F.unix_micros(F.col(f"`{name}`").cast("timestamp"))
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{name} is {kind}; sums over overlaps are exact for dates, timestamps and whole numbers")
    return F.col(f"`{name}`").cast("long")


def overlap_sums(left: DataFrame, right: DataFrame, start: str, stop: str, values: list[str], parts: int = 64) -> DataFrame:
    """left with, over the right intervals that overlap its own, their number `n`, the sum of each of `values` and of the shared lengths, `shared`.

    What overlaps(left, right) would give when summed up by left row, but no pair is made.  Of proper intervals, those that don't overlap
    [a, b) have ended by a or begin at b or later, never both, so sums over the overlapping ones are differences of two running sums;
    the shared length is the difference of the time that intervals ran until b and until a.  Running sums have a row for each
    different time and are cut at quantiles into `parts` ranges, each of which adds what the ranges before it came to.

    Left rows that overlap nothing, are empty or have a null end are left out.  Values are whole numbers, nulls count 0; sums are decimals.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    names = ["n", "t", *values]

    def steps(end: str, side: str) -> DataFrame:
        a, b = _whole(right, start), _whole(right, stop)
        t = a if end == start else b
        rows = right.where(a < b).select(t.alias("__t"), *[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(c) for c in values])
        sums = [exact(F.count("*")).alias(f"n_{side}"), exact(F.count("*") * exact(F.col("__t"))).alias(f"t_{side}"), *[F.sum(exact(F.col(c))).alias(f"{c}_{side}") for c in values]]
        return rows.groupBy("__t").agg(*sums)

    a, b = _whole(left, start), _whole(left, stop)
    own = left.where(a < b).select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"), a.alias("__a"), b.alias("__b"))
    asked = own.select(F.col("__a").alias("__t")).union(own.select("__b")).distinct()
    every = asked.join(steps(start, "a"), "__t", "full").join(steps(stop, "b"), "__t", "full")
    sums = [f"{c}_{side}" for side in "ab" for c in names]
    edges = _edges(every.select(F.col("__t").cast("double").alias("t")), parts)
    every = every.select("__t", _bin(F.col("__t").cast("double"), edges).alias("__bin"), *[F.coalesce(F.col(c), exact(F.lit(0))).alias(c) for c in sums])
    # begun: strictly before the time; ended: at it or before
    earlier = Window.partitionBy("__bin").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy("__bin").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    here = every.select("__t", "__bin", *[exact(F.sum(c).over(earlier if c.endswith("_a") else until)).alias(c) for c in sums])
    before = Window.partitionBy("__all").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = every.groupBy("__bin").agg(*[exact(F.sum(c)).alias(c) for c in sums]).withColumn("__all", F.lit(0))
    ranges = ranges.select("__bin", *[F.coalesce(exact(F.sum(c).over(before)), F.lit(0)).alias(f"__{c}") for c in sums])
    total = here.join(F.broadcast(ranges), "__bin").select("__t", F.struct(*[exact(F.coalesce(c, F.lit(0)) + F.col(f"__{c}")).alias(c) for c in sums]).alias("__s"))
    at = lambda name: total.select(F.col("__t").alias(f"__{name}"), F.col("__s").alias(f"__at_{name}"))
    rows = own.join(at("a"), "__a").join(at("b"), "__b")
    low, high = F.col("__at_a"), F.col("__at_b")
    ran = lambda t, s: exact(exact(t) * exact(s["n_a"] - s["n_b"])) - s["t_a"] + s["t_b"]
    out = [exact(high[f"{c}_a"] - low[f"{c}_b"]).alias(c) for c in values]
    rows = rows.withColumn("__n", (high["n_a"] - low["n_b"]).cast("long")).where("__n > 0")
    return rows.select("__row.*", F.col("__n").alias("n"), *out, exact(ran(F.col("__b"), high) - ran(F.col("__a"), low)).alias("shared"))
