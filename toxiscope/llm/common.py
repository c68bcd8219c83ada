"""Shared helpers of the operators: written intermediate tables and Arrow text access."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toxiscope.session import checkpoint_dir

#: Bytes of text that one numpy step handles; a longer document is one step of its own.
CHUNK_BYTES = 1 << 20


class Scratch:
    """Tables written as Parquet under the shared folder and read back.

    Cuts lineage: a lost executor re-reads files instead of re-running the
    steps before.  ``drop`` deletes a table that no later step reads; the
    tables that a lazy result still reads stay until the cluster clears the
    folder.
    """

    #: Where the scratches made now are noted, see :func:`noted`.
    _noted: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{name}-{uuid.uuid4().hex}"
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{self.folder}"
        if Scratch._noted is not None:
            Scratch._noted.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self._path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self._path(name))

    def drop_all(self) -> None:
        """Deletes the folder with all its tables; nothing may read them any more."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _path(self, name: str) -> str:
        return f"{self.root}/{re.sub('[^A-Za-z0-9_.-]+', '_', name)}"


@contextmanager
def noted() -> Iterator[list[Scratch]]:
    """The scratches that operators make inside the block, for a caller that knows when their results have been written."""
    before, Scratch._noted = Scratch._noted, []
    try:
        yield Scratch._noted
    finally:
        Scratch._noted = before


def tidy(run):
    """``run`` for ``mapInArrow``; at a task's end the worker, which waits for other work, gives memory that it no longer
    uses back to the system."""
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return wrapped


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` and ``row``, a number of its own for every row.

    ``row`` tells repeated rows and rows without an id apart.  It follows the
    scan's partitions, so a caller that needs it twice writes it first.
    """
    return docs.select(F.monotonically_increasing_id().alias("row"), *columns)


def crc_bucket(doc_id: Column | str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets`` (null id: null)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % buckets


def text_steps(batch: pa.RecordBatch, column: str = "text",
               limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of at most ``limit`` bytes.

    A null text counts as empty.
    """
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n), data[offsets[at]:offsets[min(end, n)]], offsets[at:min(end, n) + 1] - offsets[at]
        at = min(end, n)


def bit_table(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bytes of a table of ``bits`` bits with the bit of every key set (key modulo ``bits``).

    Its size is fixed, so it may be broadcast whatever the number of keys: a
    full table only lets more through.  At most ``bits`` / 64 rows reach the driver.
    """
    slot = F.pmod(F.col(column).cast("long"), F.lit(bits).cast("long"))
    rows = (keys.select(F.floor(slot / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, CAST(pmod({column}, 64) AS INT))").alias("b"))
            .groupBy("at").agg(F.bit_or("b").alias("bits")).collect())
    table = np.zeros(bits // 64, "<i8")
    for r in rows:
        table[r["at"]] = r["bits"]
    return table.view(np.uint8)


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """If each 64-bit key's bit is set in a table of :func:`bit_table`."""
    slot = (keys.astype(np.uint64) % np.uint64(8 * len(table))).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7)) & 1 == 1
