"""Language identification: averaged hashed subword embeddings and a linear softmax.

A document is the average of the embeddings of all its subwords (byte 3- to 5-grams of each
lower-cased word between boundary marks, and the word itself; of a word longer than ``LONG``
bytes, those of its pieces), hashed into a fixed table; a linear softmax follows. Both are trained
together by minibatch gradient descent in numpy on a bounded sample of the labelled training
documents: the ones with the smallest seeded hash of id, text and language, at most ``MAX_SAMPLE``
of ``MAX_SAMPLE_BYTES`` together (rows equal in all three count once).

A quarter of the sample is kept from the descent and calibrates the verdict:

* The softmax temperature minimises the cross-entropy to targets smoothed as in Platt scaling
  (a language seen n times gets (n + 1) / (n + 2)), so separable data give no certainty of 1.
* A subword is *unseen* if its bucket is not met in training. Kept documents have a share of
  unseen subwords of at most q (the 1 - ``REJECT_RATE`` quantile); a text of none of the
  languages has about f, the share of empty buckets. Between both the score falls from the
  softmax probability to 0.
* Documents are accepted from the ``REJECT_RATE`` quantile of the rightly classified ones'
  scores on, or from one half where that is lower.

The text alone decides a prediction. A text that is null or has no letter is ``und`` with score
0 and rejected; without any labelled training text all are. Repeated rows are predicted alike,
ties go to the first language by code point. A null doc_id counts as the empty string in the
split. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.llm._common import give_back, private, segment_sums, slices, texts_bytes, words_of

BUCKET_BITS, WIDTH, GRAMS = 20, 16, (3, 4, 5)
BUCKETS = 1 << BUCKET_BITS
MAX_SAMPLE, MAX_SAMPLE_BYTES, STEPS, BATCH, RATE, SEED = 2000, 16 << 20, 1000, 24, 0.5, 11
REJECT_RATE = 0.002
#: Bytes of text, and of different words, that are worked on at once; longer words are cut.
SLICE, PORTION, LONG = 1 << 20, 64 << 10, 4096
#: Words whose sums are gathered at once.
GATHER = 1 << 16
_MIX, _STEP, _PLACE = np.uint32(0x9E3779B1), np.uint32(0x01000193), np.uint32(0xC2B2AE3D)


class Model(NamedTuple):
    langs: list[str]
    row: np.ndarray  # the table's row of each bucket, 0 for one not met in training
    table: np.ndarray  # rows x width: embeddings, or what they add to the logits where that is narrower
    out: np.ndarray  # width x langs
    bias: np.ndarray
    temperature: float
    threshold: float
    usual: float  # share of unseen subwords that is still usual
    foreign: float  # share of unseen subwords in a text of no language


def _hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of all words (binary, lower case) end to end, and offsets (n + 1)."""
    data, offsets = texts_bytes(pc.binary_join_element_wise(b"<", words, b">", b""))
    number, size = len(offsets) - 1, len(data)
    if not size:
        return np.zeros(0, np.int32), offsets
    data = data.astype(np.uint32) + np.uint32(1)
    sizes = np.diff(offsets)
    left = np.repeat(offsets[1:], sizes) - np.arange(size)  # bytes to the word's end
    # a row for each byte: the subwords that begin there, and at a word's first byte the word itself
    code, there = np.zeros((size, len(GRAMS) + 1), np.uint32), np.zeros((size, len(GRAMS) + 1), bool)
    rolled = np.zeros(size, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n <= size:
            rolled[: size - n + 1] = (rolled[: size - n + 1] * _STEP) ^ (data[n - 1 :] * _MIX)
        if n in GRAMS:
            code[:, GRAMS.index(n)], there[:, GRAMS.index(n)] = rolled, left >= n
    place = (np.repeat(sizes, sizes) - left).astype(np.uint32)
    total = np.concatenate((np.zeros(1, np.uint32), np.cumsum((data * _MIX) ^ (data * (place + np.uint32(3)) * _PLACE), dtype=np.uint32)))
    code[offsets[:-1], -1], there[offsets[:-1], -1] = total[offsets[1:]] - total[offsets[:-1]], True
    bounds = np.concatenate(([0], np.cumsum(there.sum(1))))[offsets]
    code = code[there]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        code = (code ^ (code >> np.uint32(shift))) * np.uint32(factor)
    return (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), bounds


def _portions(words: pa.Array):
    """(number of each row's word, rows in lower case) of about ``PORTION`` bytes; a long word is several rows."""
    words = pc.utf8_lower(words).cast(pa.binary())
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    long = np.flatnonzero(sizes > LONG)
    short = np.flatnonzero(sizes <= LONG)
    block = np.cumsum(sizes[short]) // PORTION
    for part in np.split(short, np.flatnonzero(np.diff(block)) + 1) if len(short) else ():
        yield part, words.take(pa.array(part))
    for i in long.tolist():
        word = words[i].as_py()
        for at in range(0, len(word), PORTION):
            part = word[at : at + PORTION]
            rows = [part[x : x + LONG] for x in range(0, len(part), LONG)]
            yield np.full(len(rows), i), pa.array(rows, pa.binary())


def _features(batches):
    """(lang, text) of the sample to (lang, buckets, counts), text by text."""
    for batch in batches:
        for i in range(batch.num_rows):
            _, words = words_of(batch.column(1).slice(i, 1))
            coded = words.dictionary_encode()
            times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            met = [(np.zeros(0, np.int32), np.zeros(0))]
            for owner, rows in _portions(coded.dictionary):
                buckets, bounds = _hashed(rows)
                which, inverse = np.unique(buckets, return_inverse=True)
                met.append((which, np.bincount(inverse, np.repeat(times[owner], np.diff(bounds)))))
            which, inverse = np.unique(np.concatenate([w for w, _ in met]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([n for _, n in met]), len(which))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([which.astype("<i4").tobytes()], pa.binary()), pa.array([counts.astype("<f4").tobytes()], pa.binary())],
                names=["lang", "buckets", "counts"],
            )


def _softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(1, keepdims=True))
    return grown / grown.sum(1, keepdims=True)


def _gradients(weights: np.ndarray, embed: np.ndarray, out: np.ndarray, bias: np.ndarray, labels: np.ndarray):
    """Of the mean cross-entropy of documents x subwords ``weights``: by each document's mean, by ``out`` and by ``bias``.

    The gradient by the embeddings is ``weights.T`` times the first.
    """
    mean = weights @ embed
    error = _softmax(mean @ out + bias)
    error[np.arange(len(labels)), labels] -= 1
    error /= len(labels)
    return error @ out.T, mean.T @ error, error.sum(0)


def _descend(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minibatch gradient descent of the embeddings and the softmax: the buckets met, their embeddings, out and bias."""
    rng = np.random.default_rng(SEED)
    met = np.zeros(BUCKETS, bool)
    for b, _ in docs:
        met[b] = True
    used = np.flatnonzero(met).astype(np.int32)
    docs = [(np.searchsorted(used, b).astype(np.int32), (c / c.sum(dtype=np.float64)).astype(np.float32)) for b, c in docs]
    embed = rng.normal(0, 0.1, (len(used), WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, langs)), np.zeros(langs)
    here, at = np.zeros(len(used), bool), np.zeros(len(used), np.int32)
    queue = np.zeros(0, np.int64)
    for step in range(STEPS):
        if len(queue) < BATCH:
            queue = np.concatenate((queue, rng.permutation(len(docs))))
        part, queue = queue[:BATCH], queue[BATCH:]
        rate = RATE * (1 - step / STEPS)
        # the batch over its own subwords only
        for i in part:
            here[docs[i][0]] = True
        own = np.flatnonzero(here)
        here[own], at[own] = False, np.arange(len(own))
        weights = np.zeros((len(part), len(own)), np.float32)
        for j, i in enumerate(part):
            weights[j, at[docs[i][0]]] = docs[i][1]
        by_mean, by_out, by_bias = _gradients(weights, embed[own], out, bias, labels[part])
        # a subword moves by its share of the average, relative to how concentrated the document's shares are
        weights /= np.einsum("ij,ij->i", weights, weights)[:, None]
        embed[own] -= weights.T @ (rate * by_mean).astype(np.float32)
        out -= rate * by_out
        bias -= rate * by_bias
    return used, embed, out, bias


def calibrated(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least cross-entropy to smoothed targets."""
    number, langs = logits.shape
    if langs < 2:
        return 1.0
    sure = (np.bincount(truth, minlength=langs) + 1) / (np.bincount(truth, minlength=langs) + 2)
    targets = np.repeat(((1 - sure) / (langs - 1))[truth][:, None], langs, axis=1)
    targets[np.arange(number), truth] = sure[truth]
    loss = lambda t: -(targets * np.log(_softmax(logits / t) + 1e-300)).sum()
    return float(min(np.geomspace(0.01, 100, 401), key=loss))


def train(rows: list[tuple[str, bytes, bytes]]) -> Model | None:
    """A model of (lang, buckets, counts) rows as little-endian int32 and float32; none without any."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    labels = np.array([langs.index(r[0]) for r in rows])
    docs = [(np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<f4")) for r in rows]
    held = np.arange(len(docs)) % 4 == 3
    seen = np.flatnonzero(~held)
    used, embed, out, bias = _descend([docs[i] for i in seen], labels[seen], len(langs))
    row = np.zeros(BUCKETS, np.int32)
    row[used] = np.arange(1, len(used) + 1)
    table = np.concatenate((np.zeros((1, WIDTH), np.float32), embed))
    if len(langs) <= WIDTH:
        table, out = (table @ out).astype(np.float32), np.eye(len(langs))
    check = np.flatnonzero(held) if held.any() else seen
    logits = np.array([(table[row[b]] * c[:, None]).sum(0) / c.sum() @ out + bias for b, c in (docs[i] for i in check)])
    unseen = np.array([c[row[b] == 0].sum() / c.sum() for b, c in (docs[i] for i in check)])
    truth, temperature = labels[check], calibrated(logits, labels[check])
    foreign = 1 - len(used) / BUCKETS
    usual = min(float(np.quantile(unseen, 1 - REJECT_RATE)), foreign / 2)
    chance = _softmax(logits / temperature)
    score = chance.max(1) * _known(unseen, usual, foreign)
    right = score[chance.argmax(1) == truth]
    threshold = float(np.quantile(right, REJECT_RATE)) if len(right) else 0.5
    return Model(langs, row, table, out, bias, temperature, min(threshold, 0.5), usual, foreign)


def _known(unseen: np.ndarray, usual: float, foreign: float) -> np.ndarray:
    """1 where the share of unseen subwords is usual, 0 from that of a foreign text on, a line between."""
    return np.clip((foreign - unseen) / max(foreign - usual, 1e-9), 0, 1)


def _gathered(by_word: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over each document's words, some words at a time."""
    out = np.zeros((len(offsets) - 1, by_word.shape[1]))
    for at in range(0, len(codes), GATHER):
        part = codes[at : at + GATHER]
        out += segment_sums(by_word[part], np.clip(offsets - at, 0, len(part)))
    return out


def scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The softmax probabilities of all languages, and how much of a text's subwords is known (0 to 1)."""
    offsets, words = words_of(texts)
    coded = words.dictionary_encode()
    # what a word adds: the table's rows, its subwords, and those not met in training
    width = model.table.shape[1]
    by_word = np.zeros((len(coded.dictionary), width + 2))
    for owner, rows in _portions(coded.dictionary):
        buckets, bounds = _hashed(rows)
        at = model.row[buckets]
        sums = np.concatenate((np.add.reduceat(model.table[at], bounds[:-1]), np.diff(bounds)[:, None], np.add.reduceat((at == 0).astype(np.int64), bounds[:-1])[:, None]), axis=1)
        np.add.at(by_word, owner, sums)
    total = _gathered(by_word, coded.indices.to_numpy(), offsets)
    number = np.maximum(total[:, width], 1)
    chance = _softmax(((total[:, :width] / number[:, None]) @ model.out + model.bias) / model.temperature)
    return chance, _known(total[:, width + 1] / number, model.usual, model.foreign)


def _verdicts(model: Model | None, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "")
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    chance, known = scores(model, texts)
    score = np.where(letters, chance.max(1) * known, 0.0)
    lang = np.where(letters, np.array(model.langs, object)[chance.argmax(1)], "und")
    return lang.tolist(), score, letters & (score >= model.threshold)


def _predict(model: Model | None):
    def kernel(batches):
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                lang, score, sure = _verdicts(model, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure)], names=["doc_id", "lang_pred", "score", "accepted"])

    return kernel


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MAX_SAMPLE, most_bytes: int = MAX_SAMPLE_BYTES) -> Model | None:
    """Train on a sample of the documents with a language that are not held out."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id))
    rows = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text), F.col(lang)).alias("key"))
    # the sample's edge first, from hashes and sizes; then its texts become features
    chosen = rows.select("key", F.octet_length("text").alias("size")).orderBy("key").limit(most).collect()
    edge, size = None, 0
    for i, r in enumerate(chosen):
        size += r["size"]
        if i and size > most_bytes:
            break
        edge = r["key"]
    if edge is None:
        return None
    sample = rows.filter(F.col("key") <= edge).groupBy("key").agg(F.min_by("lang", "lang").alias("lang"), F.first("text").alias("text"))
    made = sample.select("lang", "text").mapInArrow(_features, "lang string, buckets binary, counts binary")
    columns = made.toArrow()
    found = sorted(zip(*(columns.column(c).to_pylist() for c in ("lang", "buckets", "counts")), strict=True))
    del columns
    give_back()
    model = train(found)
    del found
    give_back()
    return model


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and accepted (the calibrated score reaches the model's threshold)."""
    rows = private(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, accepted boolean")


def accepted_rows(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns, of whatever names.

    Rows with a null, empty or letterless text go; repeated rows and ids are judged row by row. An empty
    table gives an empty result.
    """

    @F.arrow_udf("boolean")
    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            whole = pa.RecordBatch.from_arrays([batch], names=["text"])
            verdicts = [_verdicts(model, part.column(0))[2] for part in slices(whole, 0, SLICE)]
            yield pa.array(np.concatenate(verdicts) if verdicts else np.zeros(0, bool))

    return docs.filter(accepted(F.col(text).cast("string")))
