"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two are linked at Jaccard similarity 0.8 or more. A
text of one to four words has one shingle, all its words; one without words has none and no link.

1. Equal shingle sets fold into one representative. Each has ``BANDS * ROWS`` MinHash values;
   representatives that agree in all values of a band are candidates (a pair at the threshold
   is missed with probability (1 - 0.8^ROWS)^BANDS, about 1e-7).
2. Candidates compare MinHash values ``STEP`` at a time. With m of k equal and a uniform prior
   the similarity is Beta(m + 1, k - m + 1) distributed; a pair leaves as soon as the posterior
   probability of reaching the threshold is below ``TOLERANCE``. What stays joins cells.
3. Inside a cell all pairs are verified exactly. Verified links give each document's number of
   links and, by connected components, its class.

Buckets and cells of any size are cut into blocks, and pairs of blocks are dealt over tasks;
a task emits a row for each document that it holds, never pairs. Blocks grow with the group (from
``BLOCK`` to ``MOST_BLOCK`` rows), so a row of a group of n goes to at most max(64, n / MOST_BLOCK)
pairs. Copies are counted, not expanded. Rows with a repeated or null doc_id are documents of their own. An empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.llm._common import cut, give_back, partitions, slices, words_of
from delaylake.llm._graph import components
from delaylake.llm.suffix_dedup import numbered

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 30, 4, 12, 1e-6
BLOCK, MOST_BLOCK, BLOCK_BYTES, PAIRS, TILE = 256, 1024, 8 << 20, 200_000, 512
HASHES = BANDS * ROWS
_SEEDS = np.random.default_rng(97).integers(0, 1 << 63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit shingle set of each text."""
    offsets, words = words_of(texts)
    coded = words.dictionary_encode()
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    flat = names[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    out = []
    runs = flat.copy()
    for k in range(1, min(SHINGLE, len(flat))):
        runs[: len(flat) - k] = _mixed(runs[: len(flat) - k] * _A + flat[k:] * _B)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    hold = np.empty_like(flat)
    for i in range(HASHES):
        np.bitwise_xor(flat, _SEEDS[0, i], out=hold)
        np.multiply(hold, _SEEDS[1, i], out=hold)
        out[:, i] = np.minimum.reduceat(hold, starts) >> np.uint64(32)
    return out


def _sketch(batches):
    """(doc, text) to (doc, set_a, set_b, bands, values); texts without words leave."""
    for whole in batches:
        for batch in slices(whole, most=1 << 20):
            found = [(d, s) for d, s in zip(batch.column(0).to_pylist(), shingles(batch.column(1)), strict=True) if len(s)]
            if not found:
                continue
            sets = [s for _, s in found]
            values = signatures(sets)
            wide = values.astype(np.uint64).reshape(len(sets), BANDS, ROWS)
            bands = np.arange(BANDS, dtype=np.uint64) * _B
            for i in range(ROWS):
                bands = _mixed(bands * _A + wide[:, :, i])
            names = [(int(_mixed(s).sum(dtype=np.uint64)), int(_mixed(s * _B).sum(dtype=np.uint64))) for s in sets]
            both = np.array(names, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in found], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                    pa.array(bands.view(np.int64).tolist(), pa.list_(pa.int64())), pa.array([v.tobytes() for v in values.astype(np.uint8)], pa.binary()),
                ],
                names=["doc", "set_a", "set_b", "bands", "values"],
            )


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For k = STEP, 2 STEP, ...: the fewest equal values of k with which a pair stays.

    P(Beta(m + 1, k - m + 1) >= t) = P(Binomial(k + 1, t) <= m).
    """
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def _pairs(bounds: np.ndarray, one: np.ndarray, side: np.ndarray):
    """Pairs of rows of each group, in portions: all pairs where a block meets itself (``one``), else those across."""
    first, second, held = [], [], 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rows = np.arange(a, b)
        left = rows if one[a] else rows[side[a:b] == 0]
        right = rows if one[a] else rows[side[a:b] == 1]
        step = max(1, PAIRS // max(1, len(right)))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            x, y = np.repeat(part, len(right)), np.tile(right, len(part))
            if one[a]:
                x, y = x[x < y], y[x < y]
            first.append(x)
            second.append(y)
            held += len(x)
            if held >= PAIRS:
                yield np.concatenate(first), np.concatenate(second)
                first, second, held = [], [], 0
    if held:
        yield np.concatenate(first), np.concatenate(second)


def _labels(number: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    label = np.arange(number)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def survivors(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that no step drops."""
    equal = np.zeros(len(x), np.int64)
    for step, least in enumerate(least_matches()):
        part = slice(step * STEP, (step + 1) * STEP)
        equal += (values[x, part] == values[y, part]).sum(1)
        stays = equal >= least
        x, y, equal = x[stays], y[stays], equal[stays]
    return x, y


def _groups(batches, keys: int):
    """Sorted rows as tables of whole groups (equal in the first ``keys`` columns), many groups at a time."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        new = _group_starts(table, keys)
        last = int(new[-1])
        if last:
            yield table.slice(0, last).combine_chunks(), new
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest, np.append(_group_starts(rest, keys), rest.num_rows)


def _group_starts(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for i in range(keys):
        column = table.column(i).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def _prune(batches):
    """(band, i, j, side, rep, values) to links (u, v) that span the surviving pairs."""
    for table, bounds in _groups(batches, 3):
        rep, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint8).reshape(-1, HASHES)
        one = table.column("i").to_numpy() == table.column("j").to_numpy()
        for x, y in _pairs(bounds, one, side):
            x, y = survivors(values, x, y)
            rows, inverse = np.unique(np.concatenate((x, y)), return_inverse=True)
            label = _labels(len(rows), inverse[: len(x)], inverse[len(x) :])
            u, v = rep[rows], rep[rows[label]]
            links = np.unique(np.stack((u[u != v], v[u != v])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], names=["u", "v"])
    give_back()


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists (of one with itself), as a product of incidence matrices."""
    sets = left if right is None else [*left, *right]
    sizes = [len(s) for s in sets]
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = times[code] > 1
    code, owner = code[shared], owner[shared]
    names, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(left), len(left if right is None else right)), np.int32)
    for at in range(0, len(names), TILE):
        a, b = np.searchsorted(code, (at, at + TILE))
        matrix = np.zeros((len(sizes), TILE), np.float32)
        matrix[owner[a:b], code[a:b] - at] = 1
        out += (matrix[: len(left)] @ (matrix if right is None else matrix[len(left) :]).T).astype(np.int32)
    return out


def _verify(batches):
    """(cell, i, j, side, rep, docs, text) to (u, v, links): links of the representative and a span of them."""
    for table, bounds in _groups(batches, 3):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = table.slice(a, b - a).combine_chunks()
            side, rep, docs = (part.column(c).to_numpy() for c in ("side", "rep", "docs"))
            sets = shingles(part.column("text").combine_chunks() if part.num_rows else pa.array([], pa.string()))
            lists = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
            one = part.column("i")[0] == part.column("j")[0]
            rows, columns = lists[0], lists[0] if one else lists[1]
            if not len(rows) or not len(columns):
                continue
            size = np.array([len(s) for s in sets])
            common = intersections([sets[r] for r in rows], None if one else [sets[c] for c in columns])
            linked = 5 * common >= 4 * (size[rows][:, None] + size[columns][None, :] - common)
            if one:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(rep), np.int64)
            links[rows] += linked @ docs[columns]
            if not one:
                links[columns] += linked.T @ docs[rows]
            x, y = np.nonzero(linked)
            label = _labels(len(rep), rows[x], columns[y])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(rep[label]), pa.array(links)], names=["u", "v", "links"])
    give_back()


def _blocks(n: Column) -> Column:
    """The number of blocks of a group of n rows."""
    return F.ceil(n / F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), n / 64)))


def _dealt(rows: DataFrame, key: str, blocks: Column, extra: list[str]) -> DataFrame:
    """Rows of each key in ``blocks`` blocks, sent to every pair of blocks (i <= j) with their own."""
    own = F.pmod(F.xxhash64("rep"), F.col("_blocks"))
    rows = rows.withColumn("_blocks", blocks).withColumn("_own", own)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.select(key, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("long").alias("side"), "rep", *extra)
    tasks = partitions(rows.sparkSession)
    return rows.repartition(tasks, key, "i", "j").sortWithinPartitions(key, "i", "j")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, doc, class_id, n_links.

    ``class_id`` is the smallest ``doc`` (the doc_id, see ``numbered``) reached over links;
    ``n_links`` counts the other documents at the threshold or above.
    """
    rows = numbered(docs, doc_id, text)
    sketch = cut(rows.select("doc", "text").mapInArrow(_sketch, "doc long, set_a long, set_b long, bands array<long>, values binary"), "sketch")
    sets = cut(sketch.groupBy("set_a", "set_b").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("docs")), "sets")
    reps = sketch.join(sets.select("rep", "docs"), sketch["doc"] == F.col("rep"))
    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = banded.join(buckets, "band")
    members = members.join(sketch.select(F.col("doc").alias("rep"), "values"), "rep")
    dealt = _dealt(members, "band", _blocks(F.col("n")), ["values"])
    cells = cut(components(cut(dealt.mapInArrow(_prune, "u long, v long"), "candidates")), "cells")
    # Exact verification: cells in blocks bounded in documents and bytes.
    texts = rows.select("doc", "text").join(cells.withColumnRenamed("node", "doc"), "doc").select(F.col("doc").alias("rep"), "text", F.col("label").alias("cell"))
    texts = cut(texts.join(sets.select("rep", "docs"), "rep"), "texts")
    size = cut(texts.groupBy("cell").agg(F.greatest(_blocks(F.count(F.lit(1))), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("b")), "size")
    dealt = _dealt(texts.join(size, "cell"), "cell", F.greatest("b", F.lit(1)).cast("long"), ["docs", "text"])
    found = cut(dealt.mapInArrow(_verify, "u long, v long, links long"), "verified")
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    classes = components(found.select("u", "v"))
    by_rep = sets.join(cut(links.withColumnRenamed("u", "rep"), "counts"), "rep", "left").join(cut(classes.withColumnRenamed("node", "rep"), "classes"), "rep", "left")
    by_set = cut(by_rep.select("set_a", "set_b", F.coalesce("label", "rep").alias("class_id"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "by_set")
    judged = cut(sketch.select("doc", "set_a", "set_b").join(by_set, ["set_a", "set_b"]).select("doc", "class_id", "n_links"), "judged")
    out = rows.select("doc_id", "doc").join(judged, "doc", "left")
    return out.select("doc_id", "doc", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that have a smaller document in their class, with all their columns, of whatever names.

    A text without words has no link, so its row stays. Where ids repeat or are null a row is named by
    its place in a written copy of ``docs`` instead, so of repeated rows one stays. An empty table gives
    an empty result.
    """
    rows = docs.select(F.struct("*").alias("whole"), F.col(doc_id).alias("id"), F.col(text).cast("string").alias("body"))
    if not rows.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
        placed = cut(rows.orderBy(F.col("id").asc_nulls_first()).withColumn("place", F.monotonically_increasing_id()), "rows")
        rows = placed.select("whole", F.col("place").alias("id"), "body")
    found = jaccard_classes(rows, "id", "body")
    dropped = cut(found.filter("doc <> class_id").select(F.col("doc_id").alias("dropped_id")), "dropped")
    return rows.join(dropped, F.col("id") == F.col("dropped_id"), "left_anti").select("whole.*")
