import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from delaylake.llm import packing
from delaylake.llm.queries import vocabulary


def expected(texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    rows = []
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            rows.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(rows, key=str)


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


CASES = [
    (1, "Hello, world's  end"), (2, None), (3, ""), (4, " \t\n"), (5, "a" * 5000), (6, "x y z " * 3000), (7, "é é   ſ İ Σας ΣΑΣ"),
    (7, "é é   ſ İ Σας ΣΑΣ"), (8, "<|endoftext|> a <|startoftext|>b"), (9, "́ mark\x1cfs\x85nel"), (None, "no id"), (10, "日本語のテキスト🙂🙂"),
]


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(d, t, "clash", 5) for d, t in CASES], "doc_id long, text string, piece string, length int")
    rows = packing.pack_documents(docs, vocabulary(), 512).collect()
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str)
    assert got == expected(CASES, 512)
    check_places(rows, 512)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, vocabulary()).count() == 0


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_PART", 500)
    sizes, pack = [], packing._pack

    def spied(capacity, level):
        kernel = pack(capacity, level)

        def one(key, rows):
            assert len(rows) < 1000 or level
            return kernel(key, rows)

        sizes.append(level)
        return one

    monkeypatch.setattr(packing, "_pack", spied)
    pieces = spark.range(20_000).selectExpr("7L as doc_id", "0 as piece", "0L as start", "600L as length", "5L as ids_crc32")
    rows = packing.pack(pieces).collect()
    assert sizes and len(rows) == 20_000
    assert check_places(rows, 2048) <= -(-20_000 // 3) + len(sizes)


def test_other_vocabularies_code_whole_texts(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    made = json.load(open(vocabulary(), encoding="utf-8"))
    assert packing._by_words(Tokenizer.from_file(vocabulary()))
    made["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made), encoding="utf-8")
    assert not packing._by_words(Tokenizer.from_file(str(path)))
    docs = spark.createDataFrame([(1, "Some Words, HERE"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack_documents(docs, str(path)).collect()}
    for i, t in ((1, "Some Words, HERE"), (2, "")):
        ids = [*Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False).ids, 0]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_exchange_reaches_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_PART", 20)
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 900).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(pieces, 100).collect()
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    made, bound = check_places(rows, 100), packing.lower_bound(np.array(lengths), 100)
    assert bound <= made <= bound + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_bound_is_below_the_optimum(lengths):
    bins, offsets, made = packing.best_fit_decreasing(np.array(lengths), 12)
    assert len(set(bins)) == made

    def fits(rest, rooms):
        if not rest:
            return True
        return any(fits(rest[1:], [*rooms[:i], r - rest[0], *rooms[i + 1 :]]) for i, r in enumerate(rooms) if r >= rest[0])

    best = next(n for n in range(1, len(lengths) + 1) if fits(sorted(lengths)[::-1], [12] * n))
    assert packing.lower_bound(np.array(lengths), 12) <= best <= made


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, vocabulary()).collect()
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str)
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert check_places(rows, 2048) <= 1.01 * packing.lower_bound(np.array([r["length"] for r in rows])) + 1
