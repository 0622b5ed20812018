"""Spark helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quire-checkpoints")
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


class Stored:
    """A table written once into the shared folder, which cuts the lineage like a checkpoint but is compressed and can be dropped."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/quire-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.spark._jvm.System.gc()  # lets the driver's cleaner remove the shuffle files that led here
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files; only for tables whose readers have been stored themselves."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def give_back() -> None:
    """Hand freed memory to the system, as a worker process is used again by tasks that need none of it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        return


def map_batches(df: DataFrame, run, schema, most: int = 4 << 20) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about `most` bytes, so that what a task holds doesn't follow the length of its texts."""

    def tidy(batches):
        yield from run(batches)
        give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df.mapInArrow(tidy, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sum_arrays(parts: DataFrame, shape: tuple[int, ...], fan: int = 8) -> np.ndarray:
    """Sum the float64 arrays in the binary column `part`; the driver gets `fan` arrays of a fixed size at most."""

    def add(batches):
        total = None
        for batch in batches:
            for value in batch.column(0):
                array = np.frombuffer(value.as_buffer(), np.float64)
                total = array.copy() if total is None else total + array
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    few = parts.select("part").mapInArrow(add, "part binary")
    few = few.repartition(fan).mapInArrow(add, "part binary")
    out = np.zeros(shape)
    for row in few.toLocalIterator():
        out += np.frombuffer(row.part, np.float64).reshape(shape)
    return out


def bit_filter(hashes: DataFrame, bits: int = 25, fan: int = 8) -> np.ndarray:
    """A bit set of a fixed 2^bits bits of the long column `h`; it passes every hash it was given, and few others while it isn't full."""

    def place(h: np.ndarray) -> np.ndarray:
        return h.view(np.uint64) >> np.uint64(64 - bits)

    def fill(batches):
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            flags[place(batch.column(0).to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_pydict({"part": [np.packbits(flags).tobytes()]})

    def join(batches):
        total = None
        for batch in batches:
            for value in batch.column(0):
                part = np.frombuffer(value.as_buffer(), np.uint8)
                total = part.copy() if total is None else total | part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    out = np.zeros(1 << bits - 3, np.uint8)
    for row in hashes.select("h").mapInArrow(fill, "part binary").repartition(fan).mapInArrow(join, "part binary").toLocalIterator():
        out |= np.frombuffer(row.part, np.uint8)
    return out


def passes(filter_bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes pass a bit filter."""
    bits = int(len(filter_bits) * 8).bit_length() - 1
    at = h >> np.uint64(64 - bits)
    return (filter_bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
