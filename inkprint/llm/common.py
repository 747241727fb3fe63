"""Helpers shared by the corpus operators: shared storage, Arrow text access, ASCII tokenising."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from inkprint.sources.tables import shared_base


#: Drops the shuffle files of a query once its result is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage: a lost executor costs the reading stage only, and every later
    reader sees the one committed attempt of each task.
    """
    spark = df.sparkSession
    path = f"{shared_base(spark)}/inkprint/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing will read again."""
    for name in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def scan_partitions(df: DataFrame) -> int:
    """How many partitions a scan of ``df`` has; follows the size of the input."""
    return max(1, df.rdd.getNumPartitions())


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end, and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    data, offsets = utf8(column)
    view = memoryview(data)
    bounds = offsets.tolist()
    for a, b in zip(bounds, bounds[1:]):
        yield bytes(view[a:b])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batches``, so that what is made of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tokens(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is just that rule.
    """
    return text.lower().split()


class RecentCache:
    """A bounded mapping: the newer half of what was seen stays, older entries go."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size // 2, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
