"""Minimum-cost-flow resharding: from old shards to new ones of given capacities, moving the fewest bytes.

A network from old shards to new ones (supply: the old shard's bytes; capacity: what the new shard lacks; cost:
0 for a byte that stays, 1 or a given cost for a byte that moves) is solved by successive shortest paths on the
driver, whose size is old x new shards and never rows.  It is solved for all bytes at once, so the flow moves the
fewest bytes whatever sizes the shards' rows have.  Rows fill its flows by classes of like size, largest first:
each old shard's rows of the class are laid out by their running bytes, and a cut of that line goes to each new
shard, in proportion to the old shard's flows.  A row on a cut goes where it begins, so before the next class, of
smaller rows, the flow of all bytes that are left is solved anew with what is really lacking, and the last error is
that of a few rows of the smallest class.

Running bytes and the gapless slots are sums in two steps: over blocks of about `BLOCK_ROWS` rows each,
and inside a block, so no shard lands in one task.

Defined cases: a null text has no bytes and size 1; repeated rows and null doc_ids are rows of their own;
old shards that are null count as 0; an empty table gives an empty table; capacities default to equal
shares of all bytes; all columns are kept by reshard(), those named like a new one (`shard`, `slot`) as `shard_in`
and `slot_in` (with more of the ending where that is taken too).
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._spark import checkpoint

BLOCK_ROWS = 20_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Flows from suppliers to receivers of least total cost(i, j) per unit; the capacities must hold the supplies."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, price: float) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    while True:
        far, via, queue, waiting = [float("inf")] * len(graph), [None] * len(graph), deque([source]), {source}
        far[source] = 0
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room > 0 and far[a] + price < far[b] - 1e-12:
                    far[b], via[b] = far[a] + price, (a, k)
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if via[sink] is None:
            break
        path, b = [], sink
        while b != source:
            a, k = via[b]
            path.append(graph[a][k])
            b = a
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            graph[e[0]][e[3]][1] += amount
    flows = [[0] * m for _ in range(n)]
    for i in range(n):
        for b, room, _, _ in graph[i]:
            if n <= b < n + m:
                flows[i][b - n] = supply[i] - room
    return flows


def _running(rows: DataFrame, keys: list[str], value, out: str) -> DataFrame:
    """rows with the sum of `value` over the earlier rows of the same keys, in the order of block and __id."""
    sums = rows.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__block").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [*keys, "__block"]).withColumn(out, F.col("__start") + F.col("__in")).drop("__start", "__in")


def _cuts(flows: dict[tuple[int, int], list[int]]):
    """A column with the new shard of a row by its class, old shard and running bytes; the cuts are old x new x classes at most."""
    place = None
    for (kind, old), flow in flows.items():
        upto, case = 0, None
        ordered = [old, *(j for j in range(len(flow)) if j != old)] if old < len(flow) else range(len(flow))
        used = [j for j in ordered if flow[j]]
        for j in used[:-1]:
            upto += flow[j]
            test = F.col("__at") < upto
            case = F.when(test, j) if case is None else case.when(test, j)
        case = F.lit(used[-1] if used else 0) if case is None else case.otherwise(used[-1])
        test = (F.col("__class") == kind) & (F.col("__old") == old)
        place = F.when(test, case) if place is None else place.when(test, case)
    return place


def _kept_columns(names: list[str]) -> list[Column]:
    """The columns of the struct __row, under names that leave `shard` and `slot` free."""
    out, taken = [], {*names, "shard", "slot"}
    for name in names:
        new = name
        while name in ("shard", "slot") and new in taken:
            new += "_in"
        taken.add(new)
        out.append(F.col("__row").getField(name).alias(new))
    return out


def reshard(rows: DataFrame, size: str, old: str, n_old: int, n_new: int, capacities: list[int] | None = None, cost=None) -> DataFrame:
    """`rows` with `shard` and `slot` (gapless from 0 in each shard); sizes are positive longs, old shards 0..n_old-1.

    With no capacities the shards get equal bytes, the first ones a byte more where the total doesn't divide.
    """
    cost = cost or (lambda i, j: 0 if i == j else 1)
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), F.col(size).cast("long").alias("__size"), F.coalesce(F.col(old), F.lit(0)).cast("int").alias("__old"))
    kinds = F.floor(F.log2(F.greatest(F.col("__size"), F.lit(1)).cast("double")) / 2).cast("int")
    kept = checkpoint(kept.withColumn("__id", F.monotonically_increasing_id()).withColumn("__class", kinds))  # ids are fixed from here on
    totals = {(r["__class"], r["__old"]): (r.n, int(r.b)) for r in kept.groupBy("__class", "__old").agg(F.count("*").alias("n"), F.sum("__size").alias("b")).collect()}
    blocks = max(1, -(-sum(n for n, _ in totals.values()) // BLOCK_ROWS))
    kept = checkpoint(_running(kept.withColumn("__block", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int")), ["__class", "__old"], F.col("__size"), "__at"))
    total = sum(b for _, b in totals.values())
    lacking = list(capacities) if capacities else [total // n_new + (j < total % n_new) for j in range(n_new)]
    if sum(lacking) < total:
        raise ValueError("the capacities don't hold the rows")
    flows: dict[tuple[int, int], list[int]] = {}
    for kind in sorted({k for k, _ in totals}, reverse=True):
        supply = [totals.get((kind, i), (0, 0))[1] for i in range(n_old)]
        left = [sum(b for (k, o), (_, b) in totals.items() if o == i and k <= kind) for i in range(n_old)]
        planned = min_cost_flow(left, _holding(lacking, sum(left)), cost)
        own = {(kind, i): _shares(planned[i], supply[i]) for i in range(n_old) if supply[i]}
        flows |= own
        got = kept.where(F.col("__class") == kind).groupBy(_cuts(own).alias("shard")).agg(F.sum("__size").alias("b")).collect()
        for r in got:
            lacking[r.shard] -= int(r.b)
    placed = kept.withColumn("shard", _cuts(flows).cast("int") if flows else F.lit(0))
    slotted = _running(placed, ["shard"], F.lit(1), "slot")
    return slotted.select(*_kept_columns(rows.columns), "shard", F.col("slot").cast("long").alias("slot"))


def _holding(lacking: list[int], amount: int) -> list[int]:
    """Capacities for the bytes that are left: what each shard lacks, and in the one that lacks most what rows on cuts took elsewhere."""
    out = [max(0, x) for x in lacking]
    out[max(range(len(out)), key=out.__getitem__)] += max(0, amount - sum(out))
    return out


def _shares(flow: list[int], amount: int) -> list[int]:
    """The part of an old shard's flows that a class of `amount` bytes fills, in proportion, so that smaller rows can still even out all of them."""
    whole = sum(flow)
    out = [x * amount // whole for x in flow]
    for j in sorted(range(len(out)), key=lambda j: -flow[j]):
        if (short := amount - sum(out)) <= 0:
            break
        out[j] += min(short, flow[j] - out[j])
    return out


def moved_bytes(placed: DataFrame, size: str, old: str) -> DataFrame:
    """(old, shard, rows, bytes) of the block transfers that were made; rows with old = shard stay."""
    return placed.groupBy(F.coalesce(F.col(old), F.lit(0)).cast("int").alias("old"), "shard").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def rewrite_affected(placed: DataFrame, old: str, path: str, rows_a_file: int = 1_000_000) -> list[int]:
    """Bring the shards that rows leave or enter up to date, as `path`/shard=j; shards whose rows are unchanged are left as they are.

    Returns the shards written or, where no row is left, removed.  A shard is written by many tasks, a block of its
    slots each.  The rows come from a checkpoint, so they may have been read from `path` itself.

    New shards are written beside the old ones; a file that lists what is to be replaced makes them count, and only then do
    they take their places.  If the driver is lost before, nothing has changed; if it is lost after, finish() goes on, which the next
    call does first.
    """
    finish(placed.sparkSession, path)
    placed = checkpoint(placed)
    spark = placed.sparkSession
    moves = placed.where(F.coalesce(F.col(old), F.lit(0)) != F.col("shard")).select(F.coalesce(F.col(old), F.lit(0)).cast("int").alias("a"), "shard").distinct().collect()
    affected = sorted({r.a for r in moves} | {r.shard for r in moves})
    if affected:
        chosen = placed.where(F.col("shard").isin(affected)).withColumn("__file", F.floor(F.col("slot") / rows_a_file))
        chosen.repartition("shard", "__file").drop("__file").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/{_NEW}")
        _stated(spark, path, affected)
        finish(spark, path)
    return affected


#: New shards before they count; readers pass over names with an underscore.
_NEW = "_new"


def _files(spark: SparkSession, path: str):
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return at, at("").getFileSystem(spark._jsc.hadoopConfiguration())


def _stated(spark: SparkSession, path: str, shards: list[int]) -> None:
    """The commit: a file of the shards that are replaced (+) or emptied (-), which is there as a whole or not at all."""
    at, files = _files(spark, path)
    out = files.create(at(f"{_NEW}/part.txt"), True)
    out.writeBytes(",".join(f"{j}{'+' if files.exists(at(f'{_NEW}/shard={j}')) else '-'}" for j in shards))
    out.close()
    files.rename(at(f"{_NEW}/part.txt"), at(f"{_NEW}/shards.txt"))


def finish(spark: SparkSession, path: str) -> None:
    """Put stated new shards in the place of the old ones; what was done before a loss of the driver is passed over."""
    at, files = _files(spark, path)
    if not files.exists(at(f"{_NEW}/shards.txt")):
        return
    for stated in spark.read.text(f"{path}/{_NEW}/shards.txt").first().value.split(","):
        shard, new = f"shard={stated[:-1]}", at(f"{_NEW}/shard={stated[:-1]}")
        if stated[-1] == "-" or files.exists(new):  # a new shard that isn't there is in place already
            files.delete(at(shard), True)
            if stated[-1] == "+":
                files.rename(new, at(shard))
    files.delete(at(_NEW), True)
