import zlib

import numpy as np
import pyarrow as pa

from delaylake.llm import language_id as op
from delaylake.llm.queries import op3_language_id


def test_held_out_accuracy(spark, sf):
    rows = {r["doc_id"]: r for r in op3_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    right = total = 0
    for d in docs:
        r = rows[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["held_out"] and d["lang"] and len(d["text"].split()) >= 20:
            total += 1
            right += r["lang_pred"] == d["lang"]
    assert right >= 0.95 * total


def test_subwords_do_not_depend_on_the_slice():
    words = [w.lower().encode() for w in ("the", "Été", "a", "x" * 500, "the", "日本")]
    buckets, bounds = op._hashed(pa.array(words, pa.binary()))
    for i, w in enumerate(words):
        alone, _ = op._hashed(pa.array([w], pa.binary()))
        assert alone.tolist() == buckets[bounds[i] : bounds[i + 1]].tolist()
        assert len(alone) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in op.GRAMS)
    assert op._hashed(pa.array([], pa.binary()))[1].tolist() == [0]


def test_portions_hold_every_word_once():
    words = ["short", "B" * (3 * op.LONG + 7), *(f"w{i}" for i in range(40_000)), "y" * (2 * op.PORTION + 1)]
    met = {}
    for owner, rows in op._portions(pa.array(words)):
        assert sum(map(len, rows.to_pylist())) <= op.PORTION + op.LONG
        for i, row in zip(owner.tolist(), rows.to_pylist(), strict=True):
            met[i] = met.get(i, b"") + row
    assert [met[i].decode() for i in range(len(words))] == [w.lower() for w in words]


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    weights, embed, out, bias, labels = rng.random((4, 7)), rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), np.array([0, 2, 1, 2])

    def loss():
        return -np.log(op._softmax(weights @ embed @ out + bias)[np.arange(4), labels]).mean()

    by_mean, by_out, by_bias = op._gradients(weights, embed, out, bias, labels)
    for of, by in ((embed, weights.T @ by_mean), (out, by_out), (bias, by_bias)):
        for at in np.ndindex(of.shape):
            old, found = of[at], []
            for step in (1e-5, -1e-5):
                of[at] = old + step
                found.append(loss())
            of[at] = old
            assert abs((found[0] - found[1]) / 2e-5 - by[at]) < 1e-6


def _calibration(pairs):
    """Expected calibration error over ten bins of the score."""
    score, right = (np.array(x, float) for x in zip(*pairs, strict=True))
    bins = np.minimum((score * 10).astype(int), 9)
    return sum(abs(score[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))


def test_known_languages_are_kept_and_others_rejected(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    model = op.fit(docs)
    assert 0.01 < model.temperature < 100 and 0 < model.usual < model.foreign
    found = {r["doc_id"]: r for r in op.identify(docs, model).collect()}
    known = [d for d in docs.filter(op.held_out()).collect() if d["lang"] and any(c.isalpha() for c in d["text"] or "")]
    assert sum(found[d["doc_id"]]["accepted"] for d in known) >= 0.99 * len(known)
    # the score is a probability: short documents included, it is right as often as it says
    assert _calibration([(found[d["doc_id"]]["score"], found[d["doc_id"]]["lang_pred"] == d["lang"]) for d in known]) < 0.05
    rng = np.random.default_rng(3)
    noise = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(3, 10))) for _ in range(n)) for n in (5, 40, 400)]
    strange = ["これは日本語の文章です。とても長い文章ではありません。", "Это простое предложение на русском языке, и оно довольно короткое.", "Ez egy egyszerű magyar mondat, amelyet senki sem tanított meg ennek a modellnek.", "Tämä on tavallinen suomenkielinen lause, jota malli ei ole koskaan nähnyt.", *noise]
    rows = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    got = op.identify(rows, model).collect()
    assert not [r for r in got if r["accepted"]], got


def test_the_sample_is_bounded_and_the_same_in_every_order(spark):
    rows = [(None if i % 3 else 7, f"the of and {i % 50} to in" if i % 2 else f"der die {i % 50} und", "en" if i % 2 else "de") for i in range(600)]
    schema = "doc_id long, text string, lang string"
    one = op.fit(spark.createDataFrame(rows, schema), most=60, most_bytes=700)
    two = op.fit(spark.createDataFrame(rows[::-1], schema).repartition(3), most=60, most_bytes=700)
    assert one.langs == two.langs == ["de", "en"]
    assert (one.table == two.table).all() and (one.row == two.row).all() and one.threshold == two.threshold


def test_edges(spark):
    train = [(4 * i, "der die und nicht ein" if i % 2 else "the of and to in", "de" if i % 2 else "en") for i in range(80)]
    rows = [(1, None, "en"), (2, "", None), (3, "1234 %% 77", "de"), (4, "the of the", None), (None, "und nicht", None), (4, "the of the", None), (5, "der die und " * 50_000, "en")]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in train + rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = op.fit(docs)
    got = op.identify(docs, model).collect()
    assert len(got) == len(train) + len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert by[1]["score"] == by[3]["score"] == 0 and not by[1]["accepted"]
    kept = op.accepted_rows(docs, model)
    assert kept.schema == docs.schema
    assert kept.filter("text is null or text = ''").count() == 0
    empty = docs.limit(0)
    assert op.fit(empty) is None
    assert op.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in op.identify(docs, None).collect()} == {"und"}


def test_the_temperature_is_the_best_and_inside_its_range():
    rng = np.random.default_rng(2)
    truth = np.arange(300) % 3
    for scale in (0.2, 1.0, 30.0):
        logits = rng.normal(size=(300, 3)) + 4 * np.eye(3)[truth]
        t = op.calibrated(logits * scale, truth)
        assert 0.02 < t < 90
        assert abs(np.log(t / op.calibrated(logits, truth) / scale)) < 0.05
    # separable data: sure, but not certain
    sure = op._softmax(20 * np.eye(3)[truth] / op.calibrated(20 * np.eye(3)[truth], truth)).max()
    assert abs(sure - 101 / 102) < 1e-3


def test_long_texts_are_kept_whole(spark):
    langs = ["the of and to in ", "der die und nicht ein "]
    train = [(4 * i, langs[i % 2], "en" if i % 2 == 0 else "de") for i in range(40)]
    long = [(1001 + i, langs[i % 2] * 80_000 if i != 3 else "123 " * 300_000, None) for i in range(8)]
    docs = spark.createDataFrame(train + long, "doc_id long, text string, lang string").coalesce(1)
    kept = op.accepted_rows(docs, op.fit(docs))
    assert kept.filter("doc_id > 1000").count() == 7
    assert {r["n"] for r in kept.filter("doc_id > 1000").selectExpr("length(text) as n").collect()} == {len(x) * 80_000 for x in langs}
