"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(column: Column | str) -> Column:
    """A-Z lower-cased; every other letter stays."""
    return F.translate(column, UPPER, LOWER)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset, as in tests on a local master, a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``rows``, so that a task holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str, rows: int = 512, size: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``rows`` and, single rows aside, ``size`` bytes of ``text``
    (or ``size`` items, if it is a list)."""
    for batch in slices(batches, rows):
        column = batch.column(text)
        measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
        lengths = pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = done = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, upto - at)
            at, done = upto, int(ends[upto - 1])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts or bytes, and where each row starts; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def column_of(data: np.ndarray, starts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Rows of bytes back as a column, of binaries or another ``kind``."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(data)]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers)
    return column if kind is None else column.cast(kind)


def gathered(begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items of stretches that begin at ``begin``, one stretch after the other,
    and where each stretch starts among them."""
    starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return np.repeat(begin - starts[:-1], lengths) + np.arange(starts[-1]), starts
