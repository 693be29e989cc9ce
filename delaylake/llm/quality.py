"""Quality rules with distribution divergence from language references.

Base rules count words, symbols, repeated lines and repeated 8-word windows; ``base_failed`` is
n_words < 20 or more than 30 % of the words in repeated windows. The method then compares two
histograms of a document - character classes, and common words with one bin for the rest - to
the same histograms of every language, gathered over all documents with a language. Distances
are Jensen-Shannon distances (base 2, 0 to 1); the nearest language by their sum counts. A
common word is one that makes up at least ``COMMON`` of a language's words, so there are at most
1 / COMMON for each. Every language with a word gives a reference, however small its share of all
words. A document fails where a distance passes its threshold, which narrows with the document's
length, and the document has the minimum length of that histogram; a shorter one is not judged by
it. Nor is a document that names a language of fewer than ``STABLE`` words: too few for a histogram
to fail it by.

A null text has no words. Without any reference only the base rules judge. Repeated rows are
judged alike. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.llm._common import cut, private, segment_sums, slices, texts_bytes, words_of

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 0.30, 8
COMMON, FLUSH = 0.001, 100_000
#: Words from which a language's histogram is stable: its rarest common word is then seen ten times.
STABLE = 10_000
#: Pairs of a filled bin and a language that are worked on at once.
PAIRS = 1 << 20
#: Shortest documents that each histogram judges, in characters and words.
MIN_CHARS, MIN_COMMON_WORDS = 150, 30
#: Largest distance a + b / sqrt(n): a histogram of n draws strays from its source by about 1 / sqrt(n).
CLASS_LIMIT, WORD_LIMIT = (0.20, 1.8), (0.31, 1.6)
EDGES = " \t\n\v\f\r.,;:!?\"'()[]{}<>*#$%&|=-_+/\\~`@^"
#: Character classes of ASCII (lower, upper, digit, blank, line end, sentence mark, symbol, control), then
#: beyond it by the block that a UTF-8 lead byte opens: Latin letters, Greek, Cyrillic and Armenian, Hebrew
#: and Arabic, the scripts of U+0800 to U+1FFF, marks and symbols, kana, ideographs, Hangul, all further planes.
CLASSES = 18
BLOCKS = ((0xC3, 0xCB, 8), (0xCC, 0xCF, 9), (0xD0, 0xD5, 10), (0xD6, 0xDF, 11), (0xE0, 0xE1, 12), (0xE2, 0xE2, 13), (0xE3, 0xE3, 14), (0xE4, 0xE9, 15), (0xEA, 0xED, 16), (0xEE, 0xFF, 17))
SCORED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, nearest string, class_distance double, word_distance double"
)


def _class_table() -> np.ndarray:
    """The class of each UTF-8 byte; -1 for bytes that continue a character."""
    table = np.full(256, 6, np.int8)
    table[:32] = 7
    table[127] = 7
    table[[32, 9, 11, 12]] = 3
    table[[10, 13]] = 4
    table[list(b".,;:!?'\"()-")] = 5
    table[48:58], table[65:91], table[97:123] = 2, 1, 0
    table[128:192], table[192:0xC3] = -1, 13
    for first, last, k in BLOCKS:
        table[first : last + 1] = k
    return table


class Reference(NamedTuple):
    langs: list[str]
    words: dict[str, int]
    word_at: np.ndarray  # words + 1 offsets into word_lang and word_share
    word_lang: np.ndarray  # languages that hold the word, and its share of theirs
    word_share: np.ndarray
    rest_share: np.ndarray  # langs
    class_share: np.ndarray  # langs x CLASSES
    few: frozenset[str]  # languages of fewer than STABLE words


def class_counts(texts: pa.Array) -> np.ndarray:
    data, offsets = texts_bytes(texts)
    classes = _class_table()[data]
    seen = classes >= 0
    owner = np.repeat(np.arange(len(offsets) - 1) * CLASSES, np.diff(offsets))
    return np.bincount(owner[seen] + classes[seen], minlength=(len(offsets) - 1) * CLASSES).reshape(-1, CLASSES)


def _folded(word: str) -> str:
    return word.strip(EDGES).lower()


def _counts(batches):
    """(lang, text) to (lang, word, n); the name of a class is its number after a blank."""
    held: dict[tuple[str, str], int] = {}
    for whole in batches:
        for batch in slices(whole):
            offsets, words = words_of(batch.column(1))
            coded = words.dictionary_encode()
            names = [_folded(w) for w in coded.dictionary.to_pylist()]
            codes, classes = coded.indices.to_numpy(), class_counts(batch.column(1))
            langs = batch.column(0).dictionary_encode()
            owner = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.repeat(owner == i, np.diff(offsets))
                for word, n in zip(names, np.bincount(codes[mine], minlength=len(names)).tolist(), strict=True):
                    if n:
                        held[lang, word] = held.get((lang, word), 0) + n
                for k, n in enumerate(classes[owner == i].sum(0).tolist()):
                    held[lang, f" {k}"] = held.get((lang, f" {k}"), 0) + n
            if len(held) > FLUSH:
                yield _as_batch(held)
                held = {}
    if held:
        yield _as_batch(held)


def _as_batch(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in held]), pa.array([k[1] for k in held]), pa.array(held.values(), pa.int64())], names=["lang", "word", "n"]
    )


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> Reference | None:
    """Histograms of every language over all documents that name one; none without such documents."""
    rows = private(docs, lang=F.col(lang).cast("string"), text=F.col(text).cast("string")).filter("lang is not null and text is not null")
    counts = cut(rows.mapInArrow(_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    is_class = F.col("word").startswith(" ")
    totals = counts.filter(~is_class).groupBy("lang").agg(F.sum("n").alias("total"))
    total = {r["lang"]: r["total"] for r in cut(totals, "totals").collect()}  # one row a language
    if not total:
        return None
    common = counts.filter(~is_class & (F.col("word") != "")).join(F.broadcast(totals), "lang").filter(F.col("n") >= COMMON * F.col("total")).select("word").distinct()
    # at most 1 / COMMON words a language; only the pairs that occur
    shares = counts.filter(~is_class).join(F.broadcast(common), "word").select("lang", "word", "n").toArrow()
    classes = counts.filter(is_class).collect()
    langs = sorted(total)
    row, size = {x: i for i, x in enumerate(langs)}, np.array([total[x] for x in langs], float)
    coded = [shares.column(c).combine_chunks().dictionary_encode() for c in ("lang", "word")]
    words = sorted(coded[1].dictionary.to_pylist())
    place = {w: i for i, w in enumerate(words)}
    owner, bins = (
        np.array([of[x] for x in c.dictionary.to_pylist()], np.int64)[c.indices.to_numpy()] for of, c in zip((row, place), coded, strict=True)
    )
    share = shares.column("n").to_numpy() / size[owner]
    order = np.lexsort((owner, bins))
    word_at = np.concatenate(([0], np.cumsum(np.bincount(bins, minlength=len(words)))))
    rest_share = np.maximum(0, 1 - np.bincount(owner, share, len(langs)))
    class_share = np.zeros((len(langs), CLASSES))
    for r in classes:
        if r["lang"] in row:
            class_share[row[r["lang"]], int(r["word"])] = r["n"]
    class_share /= np.maximum(class_share.sum(1, keepdims=True), 1)
    few = frozenset(x for x, n in total.items() if n < STABLE)
    return Reference(langs, place, word_at, owner[order].astype(np.int32), share[order], rest_share, class_share, few)


def word_distances(owner: np.ndarray, bins: np.ndarray, share: np.ndarray, number: int, reference: Reference) -> np.ndarray:
    """``js_distances`` to the word histograms, over the languages that hold each bin only."""
    langs, rest = len(reference.langs), len(reference.words)
    inside = bins < rest
    # a bin that one side alone fills adds half of that side's share
    out = np.full(number * langs, 2.0)
    p, q = np.bincount(owner[~inside], share[~inside], number)[:, None], reference.rest_share[None, :]
    out += _common_part(p, q).ravel()
    owner, bins, share = owner[inside], bins[inside], share[inside]
    times = reference.word_at[bins + 1] - reference.word_at[bins]
    edges = np.unique(np.concatenate(([0], np.searchsorted(np.cumsum(times), np.arange(PAIRS, int(times.sum()), PAIRS)) + 1, [len(times)])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        few = times[a:b]
        first = np.repeat(reference.word_at[bins[a:b]] - (np.cumsum(few) - few), few)
        pair = first + np.arange(len(first))
        part = _common_part(np.repeat(share[a:b], few), reference.word_share[pair])
        out += np.bincount(np.repeat(owner[a:b], few) * langs + reference.word_lang[pair], part, number * langs)
    return np.sqrt(np.clip(out / 2, 0, 1)).reshape(number, langs)


def _common_part(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """p log(p / m) + q log(q / m) - p - q, which is 0 where one of them is."""
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = (p + q) / 2
        return np.where((p > 0) & (q > 0), p * np.log2(p / middle) + q * np.log2(q / middle) - p - q, 0)


def js_distances(owner: np.ndarray, bins: np.ndarray, share: np.ndarray, number: int, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (number x languages) of sparse histograms: owner, bin, share of each filled bin."""
    out = np.empty((number, len(reference)))
    for i, q in enumerate(reference):
        other = q[bins]
        middle = (share + other) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            part = share * np.log2(share / middle) + np.where(other > 0, other * np.log2(other / middle), 0)
        # bins that the document leaves empty add half of the reference's share each
        out[:, i] = (np.bincount(owner, part, number) + 1 - np.bincount(owner, other, number)) / 2
    return np.sqrt(np.clip(out, 0, 1))


def limit(of: tuple[float, float], n: np.ndarray) -> np.ndarray:
    return of[0] + of[1] / np.sqrt(np.maximum(n, 1))


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text: its words inside windows that occur there twice or more."""
    number, out = len(codes), np.zeros(len(offsets) - 1, np.int64)
    if number < window:
        return out
    # names of runs of 1, 2, 4 and 8 words: a pair of names gets a name of its own
    names, size = codes.astype(np.int64), 1
    while size < window:
        step = min(size, window - size)
        pair = names[: len(names) - step] * (int(names.max()) + 1) + names[step:]
        names, size = np.unique(pair, return_inverse=True)[1], size + step
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(len(names))
    starts = starts[starts + window <= offsets[1:][owner[: len(names)]]]
    key = owner[starts] * (int(names.max()) + 1) + names[starts]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = starts[times[inverse] > 1]
    cover = np.zeros(number + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return segment_sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), offsets)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """For each text: its lines with a word that equal an earlier line."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = lines.flatten()
    offsets = lines.offsets.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    key = (owner * (len(flat) + 1) + codes)[full]
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(owner[full][again], minlength=len(texts))


def _score(reference: Reference | None):
    symbols = np.zeros(256, np.int64)
    symbols[list(b"#*$%&|<>")] = 1

    def kernel(batches):
        for whole in batches:
            for batch in slices(whole):
                texts, number = pc.fill_null(batch.column(1), ""), batch.num_rows
                offsets, words = words_of(texts)
                coded = words.dictionary_encode()
                codes = coded.indices.to_numpy().astype(np.int64)
                n_words = np.diff(offsets)
                chars = segment_sums(pc.utf8_length(words).to_numpy().astype(np.int64), offsets)
                data, edges = texts_bytes(texts)
                n_symbols = segment_sums(symbols[data], edges)
                n_repeat = repeated_words(codes, offsets)
                failed = (n_words < MIN_WORDS) | (100 * n_repeat > 100 * MAX_REPEATED * n_words)
                kept, nearest, by_class, by_word = ~failed, [None] * number, [None] * number, [None] * number
                if reference is not None:
                    classes = class_counts(texts)
                    length = classes.sum(1)
                    owner, bins = np.nonzero(classes)
                    class_d = js_distances(owner, bins, classes[owner, bins] / length[owner], number, reference.class_share)
                    rest = len(reference.words)
                    place = np.array([reference.words.get(_folded(w), rest) for w in coded.dictionary.to_pylist()], np.int64)
                    key, times = np.unique(np.repeat(np.arange(number), n_words) * (rest + 1) + place[codes], return_counts=True)
                    owner = key // (rest + 1)
                    word_d = word_distances(owner, key % (rest + 1), times / n_words[owner], number, reference)
                    best = (class_d + word_d).argmin(1)
                    class_d, word_d = class_d[np.arange(number), best], word_d[np.arange(number), best]
                    far = ((length >= MIN_CHARS) & (class_d > limit(CLASS_LIMIT, length))) | ((n_words >= MIN_COMMON_WORDS) & (word_d > limit(WORD_LIMIT, n_words)))
                    kept &= ~far | np.array([x in reference.few for x in batch.column(2).to_pylist()], bool)
                    some = n_words > 0
                    nearest = np.where(some, np.array(reference.langs, object)[best], None)
                    by_class, by_word = np.where(some, class_d, None), np.where(some, word_d, None)
                counted = (n_words, chars, n_symbols, repeated_lines(texts), n_repeat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(x, pa.int64()) for x in counted], pa.array(failed), pa.array(kept), pa.array(nearest, pa.string()), pa.array(by_class, pa.float64()), pa.array(by_word, pa.float64())],
                    names=[x.split()[0] for x in SCORED.split(", ")],
                )

    return kernel


def judge(docs: DataFrame, reference: Reference | None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: the base counts, base_failed, kept, the nearest language and both distances."""
    rows = private(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"), lang=F.col(lang).cast("string"))
    return rows.mapInArrow(_score(reference), SCORED)
