"""Removal of repeated byte strings by distributed prefix doubling.

Every byte covered by a string of ``THRESHOLD`` bytes that also starts earlier (smaller doc_id,
or the same document at an earlier place) is removed. A *window* is such a string.

The suffixes that are ranked are sampled without loss: the *anchor* of a window is the place in
it whose prefix of the current length has the smallest fingerprint (the leftmost such), so equal
windows have equal anchors at equal distances. Neighbouring windows with one anchor form a
*context*, the row that is sorted. In each round Spark sorts the (anchor rank, context rank,
position) rows:

* an anchor rank that occurs once is unique, its windows stay and leave;
* rows of one context rank are copies as a whole: the first stays, the others' windows repeat;
* an anchor rank with different contexts goes to the next round, where the prefix is doubled
  (the new fingerprint is that of the pair at the old length's offset) and the contexts are finer.

Prefix lengths are 32, 64 and the threshold itself, at which a context is one window and every
row is decided. Ranks are 64-bit fingerprints; copies need equal anchor and context ranks (128
bits), which in the last round are two fingerprints of the window by different constants, and
before it the anchor's and a hash of the context's own bytes. Each task folds its own copies and sends one row at most for an anchor, so a string
that many documents share sends one row per task.

A null text is empty. Rows with a repeated or null doc_id are ordered by doc_id (null first) and
a hash of the text, and each is a document of its own. An empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.llm._common import cut, partitions, private, release, slices

THRESHOLD, PREFIXES = 100, (32, 64, 100)
BLOCK, CHUNK = 4 << 20, 1_000_000
#: Kinds of rows: windows that repeat; windows for the next round; a context; an anchor with several.
REPEATS, OPEN, CONTEXT, SEVERAL = 0, 1, 2, 3
ROWS = "anchor long, ctx long, doc long, base long, place long"
#: Odd constants of the two families of fingerprints.
_FAMILIES = tuple(
    tuple(map(np.uint64, f))
    for f in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
)


def _pair(a: np.ndarray, b: np.ndarray, family: tuple) -> np.ndarray:
    """The fingerprint of a string from those of its two (possibly overlapping) parts."""
    x = a * family[0] + (b ^ (b >> np.uint64(29))) * family[1]
    x ^= x >> np.uint64(32)
    x *= family[2]
    return x ^ (x >> np.uint64(32))


def prefix_ranks(data: np.ndarray, length: int, family: int = 0) -> np.ndarray:
    """Fingerprints of the prefixes of ``length`` bytes at all places, by doubling."""
    of = _FAMILIES[family]
    ranks, size = (data.astype(np.uint64) + np.uint64(1)) * of[0], 1
    while size < length:
        step = min(size, length - size)
        ranks, size = _pair(ranks[: len(ranks) - step], ranks[step:], of), size + step
    return ranks


def contexts(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of strings (a window or longer each) that lie end to end in ``data``.

    Anchor rank, first window (its place in ``data``) and number of windows. Windows reach over
    no string's end, and what is computed beyond one is not used.
    """
    ranks, wide = prefix_ranks(data, length), THRESHOLD - length + 1
    # fingerprint above, place below: the smallest is the leftmost of the smallest fingerprints
    low = np.uint64((1 << 24) - 1)
    least, size = (ranks & ~low) | np.arange(len(ranks), dtype=np.uint64), 1
    while size < wide:
        step = min(size, wide - size)
        least, size = np.minimum(least[: len(least) - step], least[step:]), size + step
    windows = np.diff(offsets) - (THRESHOLD - 1)
    starts = np.cumsum(windows) - windows
    valid = np.arange(windows.sum()) + np.repeat(offsets[:-1] - starts, windows)
    at = (least[valid] & low).astype(np.int64)
    new = np.concatenate(([True], at[1:] != at[:-1]))
    new[starts] = True
    first = np.flatnonzero(new)
    return ranks[at[first]].view(np.int64), valid[first], np.diff(np.concatenate((first, [len(at)])))


def _blocks(batches):
    """(doc, text) to (doc, base, data): texts with a window, cut into blocks whose windows are disjoint."""
    for whole in batches:
        for batch in slices(whole):
            out: tuple[list, ...] = ([], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for base in range(0, len(text or b"") - THRESHOLD + 1, BLOCK):
                    for column, x in zip(out, (doc, base, text[base : base + BLOCK + THRESHOLD - 1]), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc", "base", "data"])


def _ranked(length: int):
    """(doc, base, data) to rows, folded over chunks of ``CHUNK`` rows."""

    def kernel(batches):
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, 2, 1 << 20):
                data = b"".join(batch.column(2).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64))))
                anchor, first, number = contexts(np.frombuffer(data, np.uint8), offsets, length)
                if length == THRESHOLD:
                    # a context is one window: the anchor's own bytes, by the other family
                    ctx = prefix_ranks(np.frombuffer(data, np.uint8), length, 1)[first].view(np.int64)
                else:
                    ends = first + number + (THRESHOLD - 1)
                    ctx = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
                owner = np.searchsorted(offsets, first, side="right") - 1
                doc, base = (batch.column(i).to_numpy()[owner] for i in range(2))
                held.append((anchor, ctx, doc, base, ((first - offsets[owner]) << 16) | (number << 4)))
                size += len(first)
                if size > CHUNK:
                    yield from _fold(held)
                    held, size = [], 0
        if held:
            yield from _fold(held)

    return kernel


def _changes(*sorted_: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sorted_[0]), bool)
    out[:1] = True
    for x in sorted_:
        out[1:] |= x[1:] != x[:-1]
    return out


def _decide(rows: list[np.ndarray], several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by (anchor, ctx, doc, base, place): those that repeat, those that are first, and the latter's anchors with several contexts."""
    anchor, ctx = rows[0], rows[1]
    new_anchor, new_ctx = _changes(anchor), _changes(anchor, ctx)
    group = np.cumsum(new_anchor) - 1
    number = np.bincount(group[new_ctx], minlength=group[-1] + 1)
    mixed = number > 1
    if several is not None:
        mixed |= np.bincount(group[several], minlength=group[-1] + 1) > 0
    return ~new_ctx, new_ctx, mixed[group]


def _batches(columns: list[np.ndarray]):
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000], pa.int64()) for c in columns], names=["anchor", "ctx", "doc", "base", "place"])


def _fold(held: list[tuple]):
    """One task's contexts: its copies repeat, its anchors with several contexts are open, the others go on as one row."""
    rows = [np.concatenate([h[i] for h in held]) for i in range(5)]
    order = np.lexsort(rows[::-1])
    rows = [r[order] for r in rows]
    repeats, first, mixed = _decide(rows)
    # decided rows are dealt by place, so that no anchor's rows gather
    spread = (rows[2] * 1_000_003 + rows[4]).astype(np.int64)
    for kind, chosen in ((REPEATS, repeats), (OPEN, first & mixed)):
        yield from _batches([spread[chosen], np.zeros(int(chosen.sum()), np.int64), rows[2][chosen], rows[3][chosen], rows[4][chosen] | kind])
    whole = first & ~mixed
    yield from _batches([r[whole] if i < 4 else r[whole] | CONTEXT for i, r in enumerate(rows)])
    one = mixed & _changes(rows[0])
    number = int(one.sum())
    yield from _batches([rows[0][one], *[np.zeros(number, np.int64)] * 3, np.full(number, SEVERAL, np.int64)])


def _met(batches):
    """Sorted rows of whole anchors to decided rows."""
    rest = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        rest = [r[last:] for r in rows]
        yield from _judged([r[:last] for r in rows])
    if rest is not None:
        yield from _judged(rest)


def _judged(rows: list[np.ndarray]):
    if not len(rows[0]):
        return
    kind = rows[4] & 15
    done = kind <= OPEN
    yield from _batches([r[done] for r in rows])
    rows, kind = [r[~done] for r in rows], kind[~done]
    if not len(kind):
        return
    several = kind == SEVERAL
    repeats, first, mixed = _decide(rows, several)
    place = rows[4] & ~15
    for value, chosen in ((REPEATS, repeats & ~several), (OPEN, first & mixed & ~several)):
        yield from _batches([*[r[chosen] for r in rows[:4]], place[chosen] | value])


def _segments(batches):
    """(doc, base, data, places) to (doc, base, data): the bytes of open windows, neighbours together."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [])
        for doc, base, data, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            places = np.sort(np.array(places, np.int64))
            first, number = places >> 16, (places >> 4) & 0xFFF
            new = np.concatenate(([True], first[1:] != (first + number)[:-1]))
            begins, ends = first[new], (first + number)[np.concatenate((new[1:], [True]))]
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                for column, x in zip(out, (doc, base + a, data[a : b + THRESHOLD - 1]), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc", "base", "data"])


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, doc, text): ``doc`` is the id, or where ids repeat or are null a number in their order."""
    rows = private(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    bad = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if bad.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("doc"), "text")
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return cut(ordered.select("doc_id", F.monotonically_increasing_id().alias("doc"), "text"), "numbered")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, start, number) of the runs of windows that repeat, for rows (doc, text)."""
    whole = docs.select("doc", "text")
    source = whole.mapInArrow(_blocks, "doc long, base long, data binary")
    found, kind, place = None, F.col("place").bitwiseAND(15), F.shiftright("place", 16)
    for length in PREFIXES:
        # the first round cuts and ranks texts in one worker
        ranked = _ranked(length)
        rows = source.mapInArrow(ranked, ROWS) if found is not None else whole.mapInArrow(lambda b, f=ranked: f(_blocks(b)), ROWS)
        met = rows.repartition(_tasks(docs), "anchor").sortWithinPartitions("anchor", "ctx", "doc", "base", "place")
        decided = cut(met.mapInArrow(_met, ROWS).select("doc", "base", "place"), f"windows-{length}")
        release(docs.sparkSession)
        runs = decided.filter(kind == REPEATS).select("doc", (F.col("base") + place).alias("start"), F.shiftright("place", 4).bitwiseAND(0xFFF).alias("number"))
        found = runs if found is None else found.unionByName(runs)
        if length == THRESHOLD:
            return found
        open_ = decided.filter(kind == OPEN).groupBy("doc", "base").agg(F.collect_list("place").alias("places"))
        joined = source.join(open_, ["doc", "base"]).select("doc", "base", "data", "places")
        source = cut(joined.mapInArrow(_segments, "doc long, base long, data binary"), f"segments-{length}")


def _tasks(docs: DataFrame) -> int:
    return partitions(docs.sparkSession)


SPANS = "array<struct<start: long, end: long>>"


def _cut_out(batches):
    """(doc_id, text, runs) to the removed spans and what is left."""
    for whole in batches:
        for batch in slices(whole):
            spans, left, size = [], [], []
            runs = batch.column(2).to_pylist()
            for text, run in zip(batch.column(1).cast(pa.binary()).to_pylist(), runs, strict=True):
                text = text or b""
                size.append(len(text))
                if not run:
                    spans.append([])
                    left.append(text)
                    continue
                both = np.array([(r["start"], r["start"] + r["number"] + THRESHOLD - 1) for r in run], np.int64)
                both = both[np.argsort(both[:, 0], kind="stable")]
                reach = np.maximum.accumulate(both[:, 1])
                new = np.concatenate(([True], both[1:, 0] > reach[:-1]))
                merged = list(zip(both[new, 0].tolist(), reach[np.concatenate((new[1:], [True]))].tolist(), strict=True))
                spans.append([{"start": a, "end": b} for a, b in merged])
                edges = [0, *(x for m in merged for x in m), len(text)]
                left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
            )


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (byte runs that are removed) and kept (the other bytes)."""
    rows = numbered(docs, doc_id, text)
    runs = repeated_windows(rows).groupBy("doc").agg(F.collect_list(F.struct("start", "number")).alias("runs"))
    joined = rows.join(cut(runs, "runs"), "doc", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_cut_out, f"doc_id long, n_bytes long, spans {SPANS}, kept binary")
