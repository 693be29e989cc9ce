import hashlib
import random

import numpy as np
import pytest

from delaylake.llm import suffix_dedup as op
from delaylake.llm.queries import op9_suffix_dedup


def brute(rows):
    """rows: (doc_id, text) in their order."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            window = hashlib.blake2b(data[i : i + 100], digest_size=16).digest()
            if window in seen:
                gone[i : i + 100] = True
            seen.add(window)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def result(docs):
    got = []
    for r in op.suffix_dedup(docs).collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        got.append((r["doc_id"], r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return sorted(got, key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (20, 24, 30, 60, 200)]
    rows = []
    for i in range(120):
        kind = i % 6
        if kind == 0:
            text = prose(rng.randint(1, 80))
        elif kind == 1:
            text = prose(10) + rng.choice(passages) + prose(10) + rng.choice(passages)
        elif kind == 2:
            words = passages[4].split()
            for _ in range(3):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind == 3:
            text = rng.choice(passages)[rng.randrange(20) :]
        elif kind == 4:
            text = rng.choice(["ab", "x", "abcabd ", "é"]) * rng.randint(1, 300)
        else:
            text = rng.choice([passages[4], "", "y" * 99, "y" * 100, "y" * 101])
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(op, "CHUNK", 300)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, ctx string, base int").repartition(parts)
    assert result(docs) == sorted(brute(rows), key=str)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 150)
    rows = corpus()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == sorted(brute(rows), key=str)


def test_repeated_and_null_rows(spark):
    long = "some words that go on " * 3 + "and on " * 12
    rows = [(None, long), (3, None), (3, long), (3, long), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x[:3] for x in map(lambda r: r, result(docs)) if x[0] is None) == [x[:3] for x in brute(rows) if x[0] is None]
    assert sorted(x[1:] for x in result(docs)) == sorted(x[1:] for x in brute(rows))
    assert op.suffix_dedup(docs.limit(0)).count() == 0


def test_query(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op9_suffix_dedup(spark, sf).collect())
    assert got == brute(rows)
