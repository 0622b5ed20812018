"""Sessions of events by event time, as a stream and as a table, with late rows put aside.

A session of a key ends when no event of it comes within `gap`.  A row is late if it is older, by more than `delay`, than the newest row of
the batches before its own.  split_late() deals a stream's rows out to two tables, on time and late, batch by batch under
the batch's number, so a batch that runs again writes the same rows.

A stream of the rows on time keeps open sessions only: its watermark lags by `delay` and `gap` together, so a session that has
left the state can't be joined by any row that is still on time, and the sessions of the stream are those of the table.
A table with the number of each row's batch gives the same rows on time.

Defined cases: rows without a time belong to neither table, rows without a key to no session; a batch without rows moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str, aggregates: list[Column], delay: str | None = None) -> DataFrame:
    """(key, start, stop, aggregates) of each session; a stream needs `delay`, which is the allowed lateness and the gap, and gives a session when
    the watermark has passed its end."""
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    if delay is not None:
        rows = rows.withWatermark(time, delay)
    found = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(*aggregates)
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *[c for c in found.columns if c not in ("w", key)])


def with_lateness(events: DataFrame, batch: str, time: str, delay: str) -> DataFrame:
    """events that have a time, with `late`, from the number of each row's batch.

    What batches leave behind is one row each, so the running maximum is over as many rows as there were batches.
    """
    rows = events.where(F.col(time).isNotNull())
    most = rows.groupBy(batch).agg(F.max(time).alias("__most"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    marks = most.select(batch, (F.max("__most").over(before) - F.expr(f"INTERVAL {delay}")).alias("__mark"))
    return rows.join(marks, batch).withColumn("late", F.coalesce(F.col(time) < F.col("__mark"), F.lit(False))).drop("__mark")


def split_late(stream: DataFrame, time: str, delay: str, folder: str, checkpoint: str):
    """Start a query that writes each batch's rows to `folder`/on_time and `folder`/late, and its greatest time to `folder`/marks; returns the query."""

    def split(rows: DataFrame, number: int) -> None:
        mark = _greatest(rows.sparkSession, f"{folder}/marks", number)
        late = F.lit(False) if mark is None else F.col(time) < F.lit(mark) - F.expr(f"INTERVAL {delay}")
        marked = rows.where(F.col(time).isNotNull()).withColumn("__late", late)
        for name, wanted in (("on_time", ~F.col("__late")), ("late", F.col("__late"))):
            marked.where(wanted).drop("__late").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        rows.agg(F.max(time).alias("most")).where("most IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _greatest(spark: SparkSession, folder: str, number: int):
    """The greatest time of the batches before this one, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder).where(F.col("batch") < number).agg(F.max("most")).first()[0]
