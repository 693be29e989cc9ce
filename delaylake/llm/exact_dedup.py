"""Exact dedup through an index of live digests behind a cuckoo filter.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Of
equal texts the row with the largest doc_id stays (null below all others; of repeated rows
with one doc_id, one). Each digest shard holds a cuckoo filter over its live digests: a miss is
proof that a digest is new, a hit is verified against the shard's bucketed content, a superseded
row is deleted and its successor inserted, and overflow doubles the table from the stored keys.
Copies within a task fold before the shuffle, so a hot text sends one row per task.
An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.llm._common import cut, give_back, partitions, private, slices

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLOTS, KICKS, KEYS_PER_SHARD = 4, 200, 500_000
_NONE = -(1 << 63)


class CuckooIndex:
    """Live keys (bytes of 16 or more, uniformly distributed) with payloads, behind a cuckoo filter."""

    def __init__(self, buckets: int = 1024):
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = [0] * (buckets * SLOTS)
        self.content: dict[int, dict[bytes, tuple]] = {}
        self.size = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def _slot(self, bucket: int, print_: int) -> int:
        for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.table[s] == print_:
                return s
        return -1

    def find(self, key: bytes) -> tuple | None:
        """The payload of a live key. The filter answers first; a hit is verified."""
        print_, a, b = self._places(key)
        if self._slot(a, print_) < 0 and self._slot(b, print_) < 0:
            return None
        return self.content.get(a, {}).get(key)

    def insert(self, key: bytes, payload: tuple) -> None:
        """Add a key that is not live."""
        print_, a, b = self._places(key)
        self.content.setdefault(a, {})[key] = payload
        self.size += 1
        if not (self._put(a, print_) or self._put(b, print_) or self._kick(b, print_)):
            self._resize()

    def _put(self, bucket: int, print_: int) -> bool:
        free = self._slot(bucket, 0)
        if free >= 0:
            self.table[free] = print_
        return free >= 0

    def _kick(self, bucket: int, print_: int) -> bool:
        for i in range(KICKS):
            s = bucket * SLOTS + (i * 7 + print_) % SLOTS
            print_, self.table[s] = self.table[s], print_
            bucket = self._other(bucket, print_)
            if self._put(bucket, print_):
                return True
        return False

    def update(self, key: bytes, payload: tuple) -> bool:
        """Give a live key a new payload; false where it is not live."""
        if self.find(key) is None:
            return False
        self.content[self._places(key)[1]][key] = payload
        return True

    def delete(self, key: bytes) -> bool:
        """Remove a live key; false where it is not live."""
        if self.find(key) is None:
            return False
        print_, a, b = self._places(key)
        s = self._slot(a, print_)
        self.table[s if s >= 0 else self._slot(b, print_)] = 0
        del self.content[a][key]
        if not self.content[a]:
            del self.content[a]
        self.size -= 1
        return True

    def items(self):
        for bucket in self.content.values():
            yield from bucket.items()

    def _resize(self) -> None:
        stored, buckets = list(self.items()), (self.mask + 1) * 2
        self._clear(buckets)
        self.resizes += 1
        for key, payload in stored:
            self.insert(key, payload)


def _digests(batches):
    """(doc_id, text) to (row, doc_id, digest)."""
    row = TaskContext.get().partitionId() << 40
    for whole in batches:
        for batch in slices(whole):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = [hashlib.sha256((t or b"").translate(LOWER)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(out)), pa.int64()), batch.column(0), pa.array(out, pa.binary())],
                names=["row", "doc_id", "digest"],
            )
            row += len(out)


def _fold(batches):
    """Rows of one task to one row for each digest: the last (doc_id, row) and the count."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 200_000:
            yield _folded(held)
            held, size = [], 0
    if size:
        yield _folded(held)
    give_back()


def _folded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    order = np.lexsort((rows.column("row").to_numpy(), rows.column("doc_id").to_numpy()))
    codes = rows.column("digest").combine_chunks().dictionary_encode()
    code = codes.indices.to_numpy()
    last = np.empty(len(codes.dictionary), np.int64)
    last[code[order]] = order  # of equal digests the last in order stays
    out = rows.take(pa.array(last))
    return pa.RecordBatch.from_arrays(
        [codes.dictionary, *[out.column(c).combine_chunks() for c in ("doc_id", "row")], pa.array(np.bincount(code, minlength=len(last)), pa.int64())],
        names=["digest", "doc_id", "row", "n"],
    )


def _index(batches):
    """The folded rows of one shard through its index: one row for each live digest."""
    index = CuckooIndex()
    for batch in batches:
        for key, doc, row, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            live = index.find(key)
            if live is None:
                index.insert(key, (doc, row, n))
            elif live[:2] < (doc, row):
                index.delete(key)
                index.insert(key, (doc, row, n + live[2]))
            else:
                index.update(key, (*live[:2], n + live[2]))
    live = list(index.items())
    for at in range(0, len(live), 50_000):
        part = live[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part], pa.binary()), *[pa.array([p[i] for _, p in part], pa.int64()) for i in range(3)]],
            names=["digest", "keep", "keep_row", "group_size"],
        )
    index, live = None, None
    give_back()


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = private(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    rows = cut(rows.mapInArrow(_digests, "row long, doc_id long, digest binary"), "digests")
    shards = max(partitions(rows.sparkSession), -(-rows.count() // KEYS_PER_SHARD))
    ranked = rows.select(F.coalesce("doc_id", F.lit(_NONE)).alias("doc_id"), "row", "digest")
    live = (
        ranked.mapInArrow(_fold, "digest binary, doc_id long, row long, n long")
        .repartition(shards, "digest")
        .mapInArrow(_index, "digest binary, keep long, keep_row long, group_size long")
    )
    live = cut(live, "live")
    return rows.join(live, "digest").select(
        "doc_id",
        F.when(F.col("keep") != _NONE, F.col("keep")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_last_copy(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, of whatever names.

    A null text counts as empty, a null id lies below all others. Where ids repeat (or are null more
    than once) a row is named by its place in a written copy of ``docs`` instead, so of repeated rows
    one stays. An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("whole"), F.col(doc_id).alias("id"), F.col(text).cast("string").alias("body"))
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        # the last of equal ids stays: places go by id, null first
        placed = cut(rows.orderBy(F.col("id").asc_nulls_first()).withColumn("place", F.monotonically_increasing_id()), "rows")
        rows = placed.select("whole", F.col("place").alias("id"), "body")
    kept = cut(exact_dedup(rows, "id", "body").filter("kept").select(F.col("doc_id").alias("kept_id")), "kept")
    # one plan at every size: what stays grows with the rows
    return rows.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("whole.*")
