"""Mixing overlapping sources to target weights by min-cost flow.

Documents are folded by membership pattern (the set of sources that hold them). Source targets
come from weights: sources in code-point order, null last, take the weights in turn and share
the words of all documents; a target stops at ``max_repeat`` times its source's words and the
excess is reshared by weight until none is above. A flow routes word capacity of the patterns
to the source targets; the k-th repetition of a pattern costs 2k - 1 a word, so that repetition
is spread (convex costs). What a pattern gives is whole passes over its documents, and for the
rest documents in the order of a seeded hash; within the bucket of that order where the rest
ends, each next document that still fits is taken, and of the last ones the subset whose sum
comes nearest. Equal rows (id and text) are decided alike.

A null text has size 0; a document of no source (null or empty list) is never taken. Reruns
agree. An empty table gives an empty result. Only patterns and sources reach the driver, and
their number is checked.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.llm._common import cut

WEIGHTS, MAX_REPEAT, SEED, DOCS_PER_BUCKET, MAX_BUCKETS = (5, 2, 1), 3, 20_240, 256, 65_536
MAX_PATTERNS, BROADCAST_PATTERNS, SUBSET = 200_000, 10_000, 64
#: Sums of the last documents are told apart down to this part of the rest.
UNITS = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


class Plan(NamedTuple):
    patterns: DataFrame  # _pattern, _buckets, _passes, _edge (bucket where the rest ends)
    edge: DataFrame  # _pattern, _key of the documents taken in that bucket
    sources: DataFrame  # source, source_size, target, routed
    small: bool


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Targets that share ``sum(sizes)`` by weight, none above ``most`` times its size."""
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        share = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * share > most * sizes[i]]
        if not full:
            for i in free:
                targets[i] = weights[i] * share
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in set(full)]
    return targets


def route(capacity: list[int], members: list[list[int]], quota: list[int], most: int) -> dict[tuple[int, int], int]:
    """Words from pattern to source at least cost: as many as quotas allow, the k-th repetition at 2k - 1 a word.

    Nodes: start -> source (quota) -> pattern (any amount) -> end (``most`` edges of the pattern's
    capacity at costs 1, 3, 5, ...). Only the last edges cost, so a path costs what its last one
    does: cheapest paths first means all paths over first repetitions, then over second ones, and
    so on. Each of these steps is a maximal flow by blocking flows along shortest paths.
    """
    n, p = len(quota), len(capacity)
    holds: list[list[int]] = [[] for _ in range(n)]
    for i, sources in enumerate(members):
        for s in sources:
            holds[s].append(i)
    left, flow = list(quota), [dict.fromkeys(sources, 0) for sources in members]
    for _ in range(most):
        room = list(capacity)
        while True:
            # levels of sources and patterns from the sources with words left
            level_s, level_p = [-1] * n, [-1] * p
            front, depth, reached = [s for s in range(n) if left[s]], 0, False
            for s in front:
                level_s[s] = 0
            while front and not reached:
                touched = []
                for s in front:
                    for i in holds[s]:
                        if level_p[i] < 0:
                            level_p[i] = depth + 1
                            touched.append(i)
                            reached |= room[i] > 0
                depth += 2
                front = []
                if not reached:
                    for i in touched:
                        for s, words in flow[i].items():
                            if words and level_s[s] < 0:
                                level_s[s] = depth
                                front.append(s)
            if not reached:
                break
            at_s, back = [0] * n, [None] * p
            for first in range(n):
                while level_s[first] == 0 and left[first]:
                    path = _path(first, holds, flow, room, level_s, level_p, at_s, back)
                    if path is None:
                        break
                    # source, pattern, source, ..., pattern: words go in at even steps and come back at odd ones
                    amount = min(left[first], room[path[-1]], *(flow[path[j]][path[j + 1]] for j in range(1, len(path) - 1, 2)))
                    left[first] -= amount
                    room[path[-1]] -= amount
                    for j in range(0, len(path) - 1):
                        if j % 2 == 0:
                            flow[path[j + 1]][path[j]] += amount
                        else:
                            flow[path[j]][path[j + 1]] -= amount
    return {(i, s): words for i, to in enumerate(flow) for s, words in to.items() if words}


def _path(first: int, holds, flow, room, level_s, level_p, at_s, back) -> list[int] | None:
    """A path along levels from a source to a pattern with room, dead ends passed over for good."""
    path = [first]
    while path:
        here = path[-1]
        if len(path) % 2:  # a source
            step = next_ = None
            while at_s[here] < len(holds[here]):
                next_ = holds[here][at_s[here]]
                if level_p[next_] == level_s[here] + 1:
                    step = next_
                    break
                at_s[here] += 1
            if step is None:
                path.pop()
                if path:
                    back[path[-1]].pop()  # the way back to this source is spent
                continue
            path.append(step)
        else:
            if room[here]:
                return path
            if back[here] is None:
                back[here] = [s for s, _ in flow[here].items() if level_s[s] == level_p[here] + 1]
            while back[here] and not flow[here][back[here][-1]]:
                back[here].pop()
            if back[here]:
                path.append(back[here][-1])
            else:
                path.pop()
                at_s[path[-1]] += 1
    return None


def _components(members: list[list[int]]) -> list[list[int]]:
    """Patterns that share sources, directly or over others, together."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for sources in members:
        for s in sources[1:]:
            root[find(s)] = find(sources[0])
    out: dict[int, list[int]] = {}
    for i, sources in enumerate(members):
        if sources:
            out.setdefault(find(sources[0]), []).append(i)
    return list(out.values())


def sized(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with _sources, _pattern, _size (words) and _key (seeded hash)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))
    named = F.transform(F.array_sort(held), lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return docs.withColumns(
        {
            "_sources": F.array_sort(held),
            "_pattern": F.array_join(named, ","),
            "_size": F.regexp_count(whole, F.lit(WORD)).cast("long"),
            "_key": F.xxhash64(F.lit(seed), F.col(doc_id), whole),
        }
    )


def plan(rows: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> Plan:
    """The mix of rows (_sources, _pattern, _size, _key)."""
    spark = rows.sparkSession
    found = rows.groupBy("_pattern").agg(F.first("_sources").alias("s"), F.sum("_size").alias("n"), F.count(F.lit(1)).alias("docs"))
    found = cut(found, "patterns")
    if (n := found.count()) > MAX_PATTERNS:
        raise ValueError(f"{n} membership patterns; the flow is solved on the driver for {MAX_PATTERNS} at most")
    found = sorted(found.collect(), key=lambda r: r["_pattern"])
    names = sorted({x for r in found for x in r["s"]}, key=lambda x: (x is None, x or ""))
    place = {x: i for i, x in enumerate(names)}
    members = [[place[x] for x in r["s"]] for r in found]
    capacity = [r["n"] for r in found]
    source_size = [0] * len(names)
    for r, held in zip(found, members, strict=True):
        for s in held:
            source_size[s] += r["n"]
    # What several sources hold counts once among the words shared out.
    total, raw = sum(c for c, held in zip(capacity, members, strict=True) if held), sum(source_size) or 1
    share = [weights[i % len(weights)] for i in range(len(names))]
    scale = total / raw
    targets = [t * scale for t in water_fill(source_size, share, max_repeat / scale)] if scale else [0.0] * len(names)
    routed, given = [0] * len(names), [0] * len(found)
    for part in _components(members):
        own = sorted({s for i in part for s in members[i]})
        local = {s: j for j, s in enumerate(own)}
        flow = route([capacity[i] for i in part], [[local[s] for s in members[i]] for i in part], [round(targets[s]) for s in own], max_repeat)
        for (i, s), words in flow.items():
            given[part[i]] += words
            routed[own[s]] += words
    passes = [g // c if c else 0 for g, c in zip(given, capacity, strict=True)]
    rest = [g - q * c for g, q, c in zip(given, passes, capacity, strict=True)]
    buckets = [min(MAX_BUCKETS, max(1, r["docs"] // DOCS_PER_BUCKET)) for r in found]
    table = spark.createDataFrame(
        [(r["_pattern"], b, q, x) for r, b, q, x in zip(found, buckets, passes, rest, strict=True)], "_pattern string, _buckets long, _passes int, _rest long"
    )
    small = len(found) <= BROADCAST_PATTERNS
    placed = _with_patterns(rows.select("_pattern", "_size", "_key"), table, small)
    # Buckets are many small sums a pattern; the bucket where the rest ends comes from their running sum.
    sums = placed.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("n"))
    ends = _edges(sums, table)
    inside = placed.join(F.broadcast(ends) if small else ends, ["_pattern"]).filter(F.col("_bucket") == F.col("_edge"))
    inside = inside.groupBy("_pattern", "_key").agg(F.sum("_size").alias("n"), F.first("_left").alias("_left"))
    edge = cut(inside.groupBy("_pattern").applyInArrow(_fill, "_pattern string, _key long"), "edge")
    patterns = cut(table.join(ends.select("_pattern", "_edge"), "_pattern", "left"), "plan")
    sources = spark.createDataFrame([*zip(names, source_size, targets, routed)], "source string, source_size long, target double, routed long")
    return Plan(patterns, edge, sources, small)


def _with_patterns(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    out = rows.join(F.broadcast(table) if small else table, "_pattern")
    return out.withColumn("_bucket", F.pmod("_key", "_buckets"))


def _edges(sums: DataFrame, table: DataFrame) -> DataFrame:
    """For each pattern with a rest: the bucket where it ends and the words left there."""
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    running = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(table.select("_pattern", "_rest"), "_pattern")
    running = running.filter("_rest > 0 and before < _rest")
    return running.groupBy("_pattern").agg(F.max("_bucket").alias("_edge"), F.max_by(F.col("_rest") - F.col("before"), "_bucket").alias("_left"))


def _fill(rows):
    """Documents of the last bucket: in hash order each that still fits, and of the last ``SUBSET`` the nearest sum."""
    rows = rows.sort_by("_key")
    left, sizes = rows.column("_left")[0].as_py(), rows.column("n").to_pylist()
    taken = [False] * len(sizes)
    for i, size in enumerate(sizes[:-SUBSET]):
        taken[i] = 0 < size <= left
        left -= size if taken[i] else 0
    first = max(0, len(sizes) - SUBSET)
    for i in nearest_subset(sizes[first:], left):
        taken[first + i] = True
    return rows.select(["_pattern", "_key"]).filter(pa.array(taken))


def nearest_subset(sizes: list[int], goal: int) -> list[int]:
    """Places of a subset whose sum is nearest to ``goal``, the smaller sum on ties."""
    if goal >= sum(sizes):
        return [i for i, size in enumerate(sizes) if size]
    # sums are kept in units that bound the memory, whatever the sizes
    unit = 1 + min(goal, sum(sizes)) // UNITS
    if unit > 1:
        return nearest_subset([round(x / unit) for x in sizes], round(goal / unit))
    within = (1 << (2 * goal + 1)) - 1
    reach = [1]  # bit n: some subset of the first sizes sums to n
    for size in sizes:
        reach.append((reach[-1] | (reach[-1] << size)) & within)
    below = (reach[-1] & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> goal
    above = goal + (above & -above).bit_length() - 1 if above else None
    left = above if above is not None and above - goal < goal - below else below
    out = []
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> left & 1:
            out.append(i)
            left -= sizes[i]
    return out


def repeats(rows: DataFrame, made: Plan) -> DataFrame:
    """``rows`` (with the columns of ``sized``) and _repeats, the times that each is taken."""
    placed = rows.join(F.broadcast(made.patterns) if made.small else made.patterns, "_pattern").withColumn("_bucket", F.pmod("_key", "_buckets"))
    ahead = F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(False))
    at_edge = F.coalesce(F.col("_bucket") == F.col("_edge"), F.lit(False))
    sure = placed.filter(~at_edge).withColumn("_repeats", F.col("_passes") + ahead.cast("int"))
    edge = made.edge.withColumn("_in", F.lit(1))
    open_ = placed.filter(at_edge).join(edge, ["_pattern", "_key"], "left")
    open_ = open_.withColumn("_repeats", F.col("_passes") + F.coalesce("_in", F.lit(0))).drop("_in")
    return sure.unionByName(open_).drop("_buckets", "_passes", "_rest", "_edge", "_bucket")


def mix(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text", weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sources, size, taken) of each row, and (source, source_size, target, routed) of each source."""
    rows = sized(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), sources.alias("held")), F.col("held"), seed=seed)
    rows = cut(rows.select("doc_id", "_sources", "_pattern", "_size", "_key"), "sized")
    made = plan(rows, weights, max_repeat)
    out = repeats(rows, made).select("doc_id", F.col("_sources").alias("sources"), F.col("_size").alias("size"), (F.col("_size") * F.col("_repeats")).alias("taken"))
    return out, made.sources


def mixed_rows(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeated as often, with all their columns, of whatever names.

    Rows without words (null and empty texts) and rows of no source are not taken; equal rows (id and
    text) are taken equally often. An empty table gives an empty result.
    """
    whole = docs.select(F.struct("*").alias("whole"), F.col(doc_id).alias("id"), F.col(text).alias("body"), sources.alias("held"))
    rows = sized(whole, F.col("held"), "id", "body")
    made = plan(cut(rows.select("_sources", "_pattern", "_size", "_key"), "sized"))
    out = repeats(rows, made).filter("_repeats > 0 and _size > 0")
    return out.select("whole", F.explode(F.sequence(F.lit(1), F.col("_repeats"))).alias("_copy")).select("whole.*")
