"""Row-returning functions of the pipeline on awkward tables: names that could clash, nulls, empty and long texts, repeated ids."""

import pytest
from pyspark.sql import functions as F
from test_exact_dedup import low
from test_jaccard_join import shingle_set

import corpus_pipeline
from delaylake.llm import exact_dedup, jaccard_join, language_id, mixing

NAMES = ("_digest", "_row", "_size", "_sources", "_pattern", "_key", "_copy", "_repeats", "_bucket", "_edge", "_passes", "_id", "whole", "id", "body", "held", "place", "kept_id", "dropped_id", "doc", "class_id", "rep", "kept", "label")
TEXTS = ("the of and to in the of and to", "der die und nicht ein der die und", "THE of and to in the of and to", "", None, "12 34", "alone here with words", "the of and to in " * 30_000)


def table(spark, ids):
    rows = [(i, t, "en" if n % 2 == 0 else "de", "ab"[n % 2] if n else None, *(100 * n + k for k in range(len(NAMES)))) for n, (i, t) in enumerate(zip(ids, TEXTS * 2, strict=False))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in NAMES))


IDS = {"unique": range(16), "repeated": [i // 2 for i in range(16)], "null": [None if i % 3 else i for i in range(16)]}


@pytest.mark.parametrize("ids", IDS)
def test_rows_come_back_whole(spark, ids):
    docs = table(spark, IDS[ids])
    given = {tuple(r) for r in docs.collect()}
    model = language_id.fit(spark.createDataFrame([(4 * i, TEXTS[i % 2], "de" if i % 2 else "en") for i in range(80)], "doc_id long, text string, lang string"))
    made = {
        "language": language_id.accepted_rows(docs, model),
        "exact": exact_dedup.keep_last_copy(docs),
        "near": jaccard_join.one_of_each_class(docs),
        "mix": mixing.mixed_rows(docs, F.array("source")),
    }
    for name, out in made.items():
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert rows and set(rows) <= given, name
        if name != "mix":
            assert len(rows) == len(set(rows)), name
        made[name] = rows
    assert {r[1] for r in made["language"]} == {TEXTS[i] for i in (0, 1, 2, 7)}
    # one row of each text without regard to the case of A-Z, null as empty
    assert sorted(low(r[1]) for r in made["exact"]) == sorted({low(t) for t in TEXTS})
    # one row of each class; texts without words have no link
    texts = [r[1] for r in made["near"]]
    assert sum(not shingle_set(t) for t in texts) == 4 and len([t for t in texts if shingle_set(t)]) == len({frozenset(shingle_set(t)) for t in TEXTS if shingle_set(t)})
    # nothing without words is taken
    assert all((r[1] or "").split() for r in made["mix"])


def test_the_largest_id_stays(spark):
    docs = table(spark, IDS["unique"])
    assert {r["doc_id"] for r in exact_dedup.keep_last_copy(docs).collect()} == {9, 10, 12, 13, 14, 15}
    repeated = spark.createDataFrame([(1, "a"), (3, "A"), (3, "a"), (None, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"], low(r["text"])) for r in exact_dedup.keep_last_copy(repeated).collect()) == [(2, "b"), (3, "a")]


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0, name
        if name != "sequences":
            assert out.columns == docs.columns


def test_stages_take_awkward_tables(spark, sf):
    rows = table(spark, IDS["null"])
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.cut(stage(spark, rows, sf), f"awkward-{name}")
    assert rows.count() > 0
