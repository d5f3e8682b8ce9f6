"""Small shared pieces of the ``llm`` operators: stored intermediates and Arrow text access."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a numpy pass works on at once (one longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Byte -> lower-cased byte for A-Z, 0-9, a-z and all bytes of non-ASCII characters; else a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediates that every executor sees: ``spark.checkpoint.dir``.

    Where a session names none (tests, local runs), a folder of the warehouse is used, which Spark
    shares by definition; never a machine's temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/versio-shared"


def stored_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: later readers, and readers
    after a lost executor, take the stored rows instead of computing them again."""
    spark = df.sparkSession
    path = path or stored_path(spark, name)
    # Once the rows are stored, the shuffle files behind them are of no use: they go when the write ends.
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table once all that is read from it is stored itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts an object together with its class: executors need not have this package installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def taken(shared: Broadcast) -> object:
    return pickle.loads(shared.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows whose texts together hold about ``limit`` bytes."""
    raw, at = bytes_of(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
