import hashlib
import random

from delaylake.llm import exact_dedup as op

ROWS = [(1, "Abc"), (2, "abC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (9, "tie"), (9, "tie"), (None, "abc"), (None, "own"), (9, "other")]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(low(text), []).append(doc)
    return sorted(
        ((doc, max((d for d in groups[low(text)] if d is not None), default=None), len(groups[low(text)]), hashlib.sha256(low(text).encode()).hexdigest()) for doc, text in rows),
        key=str,
    )


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in ROWS], "doc_id long, text string, digest string, row int").repartition(3)
    rows = op.exact_dedup(docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == brute(ROWS)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in rows}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, kept int")
    rows = op.keep_last_copy(docs).collect()
    assert len(rows) == len({low(t) for _, t in ROWS})
    assert {low(r["text"]) for r in rows} == {low(t) for _, t in ROWS}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.exact_dedup(docs).count() == 0
    assert op.keep_last_copy(docs).count() == 0


def test_index_against_a_dict():
    index, live, rng = op.CuckooIndex(2), {}, random.Random(5)
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for step in range(20_000):
        key = rng.choice(keys)
        if key in live and rng.random() < 0.4:
            assert index.delete(key)
            del live[key]
        elif key in live and rng.random() < 0.5:
            live[key] = (step, "new")
            assert index.update(key, live[key])
        elif key not in live:
            assert not index.update(key, (step,))
            assert index.find(key) is None and not index.delete(key)
            index.insert(key, (step,))
            live[key] = (step,)
    assert dict(index.items()) == live and index.size == len(live)
    assert all(index.find(k) == v for k, v in live.items())
    assert index.resizes > 3
