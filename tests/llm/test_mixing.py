import itertools
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from delaylake.llm import mixing as op
from delaylake.llm.queries import op5_mixing_sources


def test_water_fill():
    assert op.water_fill([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    assert op.water_fill([10, 100, 100], [5, 2, 1], 3) == [30.0, 120.0, 60.0]
    assert op.water_fill([0, 10], [5, 2], 3) == [0.0, 10.0]
    assert op.water_fill([], [], 3) == []


@given(st.lists(st.integers(0, 9), max_size=7), st.integers(0, 30))
def test_nearest_subset(sizes, goal):
    places = op.nearest_subset(sizes, goal)
    assert len(set(places)) == len(places)
    sums = {sum(x for x, b in zip(sizes, bits, strict=True) if b) for bits in itertools.product((0, 1), repeat=len(sizes))}
    assert abs(sum(sizes[i] for i in places) - goal) == min(abs(x - goal) for x in sums)


def cheapest(capacity, members, quota, most):
    """Brute force over all integer routings."""
    arcs = [(i, s) for i, held in enumerate(members) for s in held]
    best = None
    for amounts in itertools.product(range(max(quota) + 1), repeat=len(arcs)):
        by_s, by_p = [0] * len(quota), [0] * len(capacity)
        for (i, s), a in zip(arcs, amounts, strict=True):
            by_s[s] += a
            by_p[i] += a
        if any(a > q for a, q in zip(by_s, quota, strict=True)) or any(a > most * c for a, c in zip(by_p, capacity, strict=True)):
            continue
        price = 0
        for a, c in zip(by_p, capacity, strict=True):
            for k in range(most):
                part = min(a, c)
                price += part * (2 * k + 1)
                a -= part
        best = min(best or (0, 0), (-sum(by_s), price))
    return best


@pytest.mark.parametrize(
    "capacity, members, quota",
    [([2, 1, 3], [[0], [0, 1], [1]], [4, 3]), ([1, 1], [[0, 1], [1]], [3, 4]), ([2, 2], [[0, 1], [0]], [3, 3]), ([1, 2], [[0], [0]], [5])],
)
def test_route_is_cheapest(capacity, members, quota):
    flow = op.route(capacity, members, quota, 3)
    price = 0
    for i, c in enumerate(capacity):
        a = sum(x for (j, _), x in flow.items() if j == i)
        for k in range(3):
            part = min(a, c)
            price += part * (2 * k + 1)
            a -= part
    assert (-sum(flow.values()), price) == (cheapest(capacity, members, quota, 3) or (0, 0))


def test_route_of_random_sources():
    rng = random.Random(4)
    for _ in range(80):
        sources = rng.randint(1, 2)
        members = [sorted(rng.sample(range(sources), rng.randint(1, sources))) for _ in range(rng.randint(1, 3))]
        test_route_is_cheapest([rng.randint(0, 3) for _ in members], members, [rng.randint(0, 4) for _ in range(sources)])


def test_route_of_many_patterns():
    rng = random.Random(1)
    members = [sorted(rng.sample(range(300), rng.randint(1, 6))) for _ in range(20_000)]
    capacity = [rng.randint(1, 10**6) for _ in members]
    quota = [sum(capacity) // 300] * 300
    flow = op.route(capacity, members, quota, 3)
    assert sum(flow.values()) == sum(quota) and min(flow.values()) > 0
    by = [0] * 300
    for (i, s), words in flow.items():
        assert s in members[i]
        by[s] += words
    assert by == quota


def test_subsets_of_large_sizes_stay_small():
    sizes = [10**8 + 7 * i for i in range(op.SUBSET)]
    goal = 30 * 10**8
    assert abs(sum(sizes[i] for i in op.nearest_subset(sizes, goal)) - goal) <= 10**-4 * goal
    assert op.nearest_subset([5, 0, 7], 10**12) == [0, 2]


def test_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 9), ["a"] if i % 3 else ["a", "b"]) for i in range(600)] + [(900, "x", None), (901, "y y", [None]), (902, None, ["b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held array<string>")
    out, sources = op.mix(docs, F.col("held"))
    got, again = (sorted(op.mix(docs.repartition(n), F.col("held"))[0].select("doc_id", "size", "taken").collect()) for n in (2, 5))
    assert got == again == sorted(out.select("doc_id", "size", "taken").collect())
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    want = sum(r["routed"] for r in sources.collect())
    assert abs(sum(r["taken"] for r in got) - want) <= 9
    assert {r["doc_id"]: r["taken"] for r in got}[900] == 0


def test_query(spark, sf):
    rows = op5_mixing_sources(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    names = sorted({d["source"] for d in docs.values()}, key=lambda x: (x is None, x or ""))
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for i, d in docs.items()}
    size = {s: sum(words[i] for i, d in docs.items() if d["source"] == s) for s in names}
    target = dict(zip(names, op.water_fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (words[r["doc_id"]], size[s])
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(5, 0.02 * target[s])


def test_rows_are_repeated(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 3, "a" if i < 90 else "b", i) for i in range(100)] + [(None, None, None, 1)], "doc_id long, text string, source string, taken int")
    out = op.mixed_rows(docs, F.array("source"))
    assert out.columns == docs.columns
    # 300 words at 5:2 (the null source has none): 214.3 and 85.7, in documents of 3
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert taken["b"] == 29 and taken["a"] == 71
    assert out.filter("source = 'b'").groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    out, sources = op.mix(docs, F.array("source"))
    assert out.count() == 0 and sources.count() == 0
