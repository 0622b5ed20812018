"""The fold over books against a plain loop, as a stream of several batches."""

import random

from quire.streaming import known_pages as K


def near(value: bytes, bits: int, rng: random.Random) -> bytes:
    x = int.from_bytes(value, "big")
    for k in rng.sample(range(256), bits):
        x ^= 1 << k
    return x.to_bytes(32, "big")


def page(seed: int, confirmed: bool, off: int = 0) -> dict:
    rng = random.Random(seed)
    dhash, ahash = rng.randbytes(32), rng.randbytes(32)
    return {"aspect": 700 + off, "dhash": near(dhash, off, rng), "ahash": near(ahash, off, rng), "confirmed": confirmed}


def test_leading_pages():
    known: list = []
    assert K.leading_pages([page(1, True), page(2, True), page(3, False)], known) == 2 and len(known) == 2
    assert K.leading_pages([page(1, False, 8), page(9, True)], known) == 1 and len(known) == 2  # an unknown page after known ones ends it
    assert K.leading_pages([page(1, False, 9)], known) == 0  # beyond the aspect's limit
    assert K.leading_pages([page(4, True), page(1, False), page(2, False), page(5, True)], known) == 3 and len(known) == 3
    assert K.leading_pages([{"aspect": 1, "dhash": None, "ahash": None, "confirmed": True}], known) == 1 and len(known) == 3
    for seed in range(100, 160):
        K.leading_pages([page(seed, True)], known)
    assert len(known) == K.FINGERPRINTS


def test_stream_keeps_its_memory_between_batches(spark, tmp_path):
    batches = [[("a", 1, [page(1, True)]), ("b", 1, [page(1, False)])], [("a", 3, [page(1, False, 5), page(7, True)]), ("a", 2, [page(7, False)]), ("b", 2, None)]]
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, K.BOOK).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(K.BOOK).option("maxFilesPerTrigger", 1).parquet(folder)
    out = K.without_known_pages(stream).writeStream.format("memory").queryName("known_pages").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    found = {(r.collection, r.book): (r.removed, r.remembered) for r in spark.table("known_pages").collect()}
    assert found == {("a", 1): (1, 1), ("a", 2): (0, 1), ("a", 3): (1, 1), ("b", 1): (0, 0), ("b", 2): (0, 0)}
