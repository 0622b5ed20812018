"""Sessions as a stream and as a table, and late rows in both."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quire.streaming import sessions as S

GAP, DELAY = "10 minutes", "20 minutes"


def test_stream_and_table_agree(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = []
    for batch in range(6):
        for _ in range(40):
            minute = batch * 30 + rng.randrange(30) - (rng.randrange(120) if rng.random() < 0.3 else 0)
            rows.append((batch, rng.randrange(5), start + timedelta(minutes=minute, seconds=rng.randrange(60)), float(rng.randrange(9))))
    rows += [(2, None, start, 1.0), (3, 1, None, 1.0)]
    table = spark.createDataFrame(rows, "batch int, user int, ts timestamp, value double")
    sums = [F.count("*").alias("events"), F.sum("value").alias("total")]
    schema = "arrival int, user int, ts timestamp, value double"
    folder = {k: str(tmp_path / k) for k in ("in", "out", "c1", "c2", "sessions")}
    for batch in range(6):  # each round is one batch of both queries
        table.where(F.col("batch") == batch).withColumnRenamed("batch", "arrival").coalesce(1).write.mode("append").parquet(folder["in"])
        split = S.split_late(spark.readStream.schema(schema).parquet(folder["in"]), "ts", DELAY, folder["out"], folder["c1"])
        assert split.awaitTermination(120)
        kept = spark.readStream.schema(schema).parquet(folder["out"] + "/on_time/*")
        out = S.sessions(kept, "user", "ts", GAP, sums, "30 minutes").writeStream.format("parquet").option("path", folder["sessions"]).option("checkpointLocation", folder["c2"]).trigger(availableNow=True).start()
        assert out.awaitTermination(120)

    marked = S.with_lateness(table, "batch", "ts", DELAY)
    late = {tuple(r) for r in marked.where("late").select(table.columns).collect()}
    plain, mark = set(), None
    for batch in range(6):
        own = [r for r in rows if r[0] == batch and r[2] is not None]
        plain |= {r for r in own if mark is not None and r[2] < mark - timedelta(minutes=20)}
        mark = max([mark or start, *(r[2] for r in own)])
    assert late == plain and late
    assert {tuple(r) for r in spark.read.schema(schema).parquet(folder["out"] + "/late/*").collect()} == late

    seen = {tuple(r) for r in spark.read.parquet(folder["sessions"]).collect()}
    whole = {tuple(r) for r in S.sessions(marked.where("NOT late"), "user", "ts", GAP, sums).collect()}
    assert seen == {s for s in whole if s[2] <= mark - timedelta(minutes=30)} and seen and len(whole) > len(seen)  # the others are open still
