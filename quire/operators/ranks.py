"""Places in a whole table's order, without a task that sorts the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import checkpoint


def global_rank(df: DataFrame, order: list[str], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds each row's place (from 1) in the order: rows are dealt by range, ranked inside, and shifted by the sizes of the ranges before."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    # the ranges are sampled anew for each use, so the dealt rows are kept where a lost executor can't change them
    ranged = checkpoint(ranged)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return ranged.withColumn("__r", F.row_number().over(inside)).join(shifts, "__part").withColumn(out, F.col("__before") + F.col("__r")).drop("__part", "__before", "__r")
