import hashlib

import corpus_pipeline
from test_exact_dedup import low
from test_jaccard_join import brute as near
from test_packing import check_places, expected

from delaylake.llm import language_id


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    rows, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.cut(stage(spark, rows, sf), "test")
        if name != "sequences":
            assert rows.columns == columns
        kept[name] = rows.collect()
    model = language_id.fit(docs)
    sure = {r["doc_id"] for r in language_id.identify(docs, model).filter("accepted").collect()}
    assert {r["doc_id"] for r in kept["language"]} == sure
    last = {}
    for r in kept["language"]:
        key = hashlib.sha256(low(r["text"]).encode()).digest()
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept["exact_copies"]) == sorted(last.values())
    classes = near([(r["doc_id"], r["text"]) for r in kept["exact_copies"]])
    assert sorted(r["doc_id"] for r in kept["near_copies"]) == sorted(d for d, (c, _) in classes.items() if c == d)
    times = {}
    for r in kept["mixture"]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= {r["doc_id"] for r in kept["near_copies"]} and max(times.values()) <= 3
    packed = kept["sequences"]
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed), key=str)
    assert got == expected([(r["doc_id"], r["text"]) for r in kept["mixture"]], 2048)
    check_places(packed, 2048)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
