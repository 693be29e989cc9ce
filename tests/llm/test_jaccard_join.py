import random
import re

import numpy as np
import pytest

from delaylake.llm import jaccard_join as op
from delaylake.llm._graph import components
from delaylake.llm.queries import op6_jaccard_join


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """rows: (doc, text) to doc: (class, links)."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    links, root = dict.fromkeys((d for d, _ in rows), 0), {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for d, s in sets:
        for x in s:
            index.setdefault(x, []).append(d)
    by = dict(sets)
    seen = set()
    for owners in index.values():
        for i, a in enumerate(owners):
            for b in owners[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(by[a] & by[b])
                    if 5 * both >= 4 * (len(by[a]) + len(by[b]) - both):
                        links[a] += 1
                        links[b] += 1
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (find(d), links[d]) for d, _ in rows}


def corpus(n, seed=4):
    rng = random.Random(seed)
    prose = lambda k: [f"w{rng.randrange(500)}" for _ in range(k)]
    bases = [prose(rng.randint(5, 120)) for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases)) if rng.random() < 0.7 else prose(rng.randint(0, 60))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if words:
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("block", [256, 7, 2])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "PAIRS", 50)
    rows = corpus(220)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, values string, rep int").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op.jaccard_classes(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, "a b"), (4, "a  b"), (5, "a b c"), (5, "a b c d e f"), (6, "x " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_links"]) for r in op.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(None, 1), (1, 0), (2, 0), (3, 1), (4, 1), (5, 0), (5, 1), (6, 0)], key=str)
    assert op.jaccard_classes(docs.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op6_jaccard_join(spark, sf).collect()} == brute(rows)


def test_recall_against_exact_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op.jaccard_classes(docs).collect()}
    linked = sum(n for _, n in want.values())
    assert linked > 100 and sum(n for _, n in got.values()) == linked and got == want


def test_portions_of_pairs(monkeypatch):
    monkeypatch.setattr(op, "PAIRS", 7)
    one, side = np.array([True] * 6 + [False] * 9), np.array([0] * 6 + [0, 0, 1, 1, 1, 1, 1, 0, 1])
    made = [p for x, y in op._pairs(np.array([0, 6, 15]), one, side) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert sorted(made) == sorted([(a, b) for a in range(6) for b in range(a + 1, 6)] + [(a, b) for a in (6, 7, 13) for b in (8, 9, 10, 11, 12, 14)])


def test_one_of_each_class(spark):
    rows = corpus(80, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in op.one_of_each_class(docs).collect()) == sorted(d for d, (c, _) in brute(rows).items() if d == c)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(900, 900 - i) for i in range(1, 40)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in links if a != b for y in (a, b)}}


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(0)
    kept = 0
    for _ in range(300):
        base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        other = np.concatenate((base[:89], rng.integers(0, 1 << 63, 11, dtype=np.uint64)))  # 89 / 111 > 0.8
        values = op.signatures([np.unique(base), np.unique(other)]).astype(np.uint8)
        kept += len(op.survivors(values, np.array([0]), np.array([1]))[0])
    assert kept == 300
    far = op.signatures([np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(2)]).astype(np.uint8)
    assert not len(op.survivors(far, np.array([0]), np.array([1]))[0])
