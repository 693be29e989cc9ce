import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from delaylake.llm import quality as op
from delaylake.llm._common import words_of
from delaylake.llm.queries import op2_quality_rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == base(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    assert sum(r["kept"] for r in rows) > 0.6 * len(rows)


def js(p, q):
    out = 0
    for k in set(p) | set(q):
        a, b = p.get(k, 0), q.get(k, 0)
        m = (a + b) / 2
        out += sum(x * math.log2(x / m) for x in (a, b) if x) / 2
    return math.sqrt(max(0, out))


def test_distances_against_brute_force(spark):
    text = {"en": "the cat and the dog of the house, to be or not to be. ", "de": "der Hund und die Katze in dem Haus, ach so ist es eben. "}
    rows = [(i, text["en" if i % 2 else "de"] * 4 + f"w{i % 3}", "en" if i % 2 else "de") for i in range(20)]
    rows += [(30, "#### $$$ %%% |||| " * 20, None), (31, "kurz", None), (32, None, "en"), (33, "", "de"), (34, "the of # " * 40, None), (None, text["en"], None), (34, "the of # " * 40, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n_words int, word string").repartition(4)
    got = op.judge(docs, op.references(docs)).collect()
    assert len(got) == len(rows)

    def words(t):
        return Counter(op._folded(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    def classes(t):
        table = op._class_table()
        return Counter(int(c) for c in table[list((t or "").encode())] if c >= 0)

    def share(c):
        n = sum(c.values())
        return {k: v / n for k, v in c.items()}

    all_words, all_classes = {}, {}
    for _, t, lang in rows:
        if lang and t is not None:
            all_words.setdefault(lang, Counter()).update(words(t))
            all_classes.setdefault(lang, Counter()).update(classes(t))
    common = {w for c in all_words.values() for w, n in c.items() if n >= op.COMMON * sum(c.values()) and w}

    def binned(c):
        out = Counter()
        for w, n in c.items():
            out[w if w in common else None] += n
        return share(out)

    by = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        if words(t):
            pairs = {x: (js(share(classes(t)), share(all_classes[x])), js(binned(words(t)), binned(all_words[x]))) for x in all_words}
            want = min(pairs.values(), key=sum)
            assert np.allclose((by[i]["class_distance"], by[i]["word_distance"]), want, atol=1e-6)
            far = len(t) >= op.MIN_CHARS and want[0] > op.limit(op.CLASS_LIMIT, len(t)) or sum(words(t).values()) >= op.MIN_COMMON_WORDS and want[1] > op.limit(op.WORD_LIMIT, sum(words(t).values()))
            assert by[i]["kept"] == (not base(t)[5] and not far)
        else:
            assert by[i]["nearest"] is None


def test_without_reference(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t u v", None)], "doc_id long, text string, lang string")
    assert op.references(docs) is None and op.references(docs.limit(0)) is None
    assert op.judge(docs, None).first()["kept"]
    assert op.judge(docs.limit(0), None).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t é#", max_size=60), min_size=1, max_size=4))
def test_kernels(texts):
    column = pa.array(texts, pa.string())
    offsets, words = words_of(column)
    codes = words.dictionary_encode().indices.to_numpy()
    want = [base(t) for t in texts]
    assert np.diff(offsets).tolist() == [w[0] for w in want]
    assert op.repeated_words(codes, offsets).tolist() == [w[4] for w in want]
    assert op.repeated_lines(column).tolist() == [w[3] for w in want]


def small_language(rows=100):
    """Many English documents and three of a language with less than COMMON of all words; the last names none."""
    draw = np.random.default_rng(7)
    text = lambda letter, n: " ".join(f"{letter}{w}" for w in draw.zipf(1.5, n) % 400)
    small = [(i, text("s", 60), "sw" if i < 2 else None) for i in range(3)]
    return small + [(10 + i, text("e", 1500), "en") for i in range(rows)]


def test_small_language_has_a_reference(spark):
    rows = small_language()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = op.references(docs)
    assert found.langs == ["en", "sw"] and found.few == {"sw"} and "s1" in found.words
    by = {r["doc_id"]: r for r in op.judge(docs, found).collect()}
    assert not any(by[i]["base_failed"] for i in range(3))
    assert [(by[i]["nearest"], by[i]["kept"]) for i in range(3)] == [("sw", True)] * 3
    # as many documents of another language leave the verdict as it is
    alone = docs.filter("doc_id < 12")
    assert all(r["kept"] for r in op.judge(alone, op.references(alone)).filter("doc_id < 3").collect())


def test_language_of_few_words_is_not_failed(spark):
    docs = spark.createDataFrame(small_language(8) + [(500, " ".join(f"s{i}" for i in range(10_500)), "sw"), (501, "# $ % & " + " ".join(f"!{i}" for i in range(60)), "xx")], "doc_id long, text string, lang string")
    found = op.references(docs)
    assert found.few == {"xx"}
    far = found._replace(rest_share=found.rest_share[:2], class_share=found.class_share[:2], langs=found.langs[:2], word_lang=found.word_lang[found.word_lang < 2], word_share=found.word_share[found.word_lang < 2])
    at = np.concatenate(([0], np.cumsum([(found.word_lang[a:b] < 2).sum() for a, b in zip(found.word_at[:-1], found.word_at[1:], strict=True)])))
    far = far._replace(word_at=at)
    junk = docs.filter("doc_id = 501")
    assert op.judge(junk, far).first()["kept"] and not op.judge(junk, far._replace(few=frozenset())).first()["kept"]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([3, 1 << 20]))
def test_word_distances(seed, pairs):
    draw = np.random.default_rng(seed)
    langs, words, number = 4, 6, 5
    dense = draw.integers(0, 3, (langs, words + 1)) * 1.0
    dense[:, -1] += 1
    dense /= dense.sum(1, keepdims=True)
    bins, owner = np.nonzero(dense[:, :-1].T)
    at = np.concatenate(([0], np.cumsum(np.bincount(bins, minlength=words))))
    found = op.Reference(list("abcd"), {str(i): i for i in range(words)}, at, owner, dense.T[bins, owner], dense[:, -1], None, frozenset())
    counts = draw.integers(0, 3, (number, words + 1))
    who, what = np.nonzero(counts)
    share = counts[who, what] / counts.sum(1)[who]
    before, op.PAIRS = op.PAIRS, pairs
    try:
        got = op.word_distances(who, what, share, number, found)
    finally:
        op.PAIRS = before
    full = counts.sum(1) > 0
    assert np.allclose(got[full], op.js_distances(who, what, share, number, dense)[full], atol=1e-6)
