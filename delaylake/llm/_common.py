"""What the operators share: the shared folder, written tables, Arrow slices and word splitting."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.functions.tables import cut as _cut
from delaylake.functions.tables import shared_folder

__all__ = ["cut", "give_back", "partitions", "private", "release", "segment_sums", "shared_folder", "slices", "text_or_empty", "texts_bytes", "words_of"]

#: Bytes of text that a kernel works on at once.
SLICE_BYTES = 2 << 20
#: Bytes of rows that a written table's kernels get at once; a number of rows alone does not bound them.
BATCH_BYTES = 8 << 20


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, kernels getting ``BATCH_BYTES`` at once meanwhile."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name, None)
    conf.set(name, str(BATCH_BYTES))
    try:
        return _cut(df, label)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that no DataFrame needs any more; it does so when their references are collected.

    For operators whose rounds shuffle more than the input, so that rounds do not add up on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def private(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named columns, so that further ones with clashing names cannot interfere."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def slices(batch: pa.RecordBatch, text: int = 1, most: int = SLICE_BYTES):
    """Cut a batch where its text column passes ``most`` bytes; a longer text is a slice alone.

    After a batch the worker, which later tasks use again, gives free memory back: without that it keeps
    the most that any of its tasks has used (142 MB instead of 90 after the language kernel), and less
    than a hundredth of the kernels' time goes into it.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // most
    edges = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return free memory to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: offsets (n + 1) and the flat words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return before[offsets], flat.filter(full)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets; empty segments give 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), dtype=values.dtype), np.cumsum(values, axis=0)))
    return total[offsets[1:]] - total[offsets[:-1]]


def texts_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and offsets (n + 1)."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b"".join(texts.cast(pa.binary()).to_pylist())
    return np.frombuffer(joined, dtype=np.uint8), np.concatenate(([0], np.cumsum(sizes)))
