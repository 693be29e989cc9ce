"""Best-fit packing of token sequences, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut). Pieces are
dealt over partitions; each packs its own by best-fit decreasing and certifies its number of
bins with dual-feasible-function lower bounds. A partition with more bins than its bound gives
the documents of its emptiest bins to an exchange; one that meets its bound gives its emptiest
bins too, fewer of them, as the bound was rounded up. Exchanged documents of several partitions are packed
together by best-fit decreasing, certified again, and so on until no gap is left or all that is
left has met in one place. An exchange that would not save a bin is undone.

A null text counts as empty: it is the one token 0. Repeated rows are packed as they come, dealt
by their place in the written pieces, so that any number of equal rows is spread over all parts.
An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.llm._common import cut, give_back, private, slices, words_of

CAPACITY, PIECES_PER_PART, FAN_IN, CACHED_PARTS = 2048, 25_000, 8, 150_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, part long, released boolean"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes: printable Latin-1 ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The normalizer and pre-tokenizer that the word rules below are written for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _by_words(tokenizer) -> bool:
    """Whether a file's rules are the ones above, under which words can be coded one by one."""
    rules = [json.loads(part.__getstate__()) if part else None for part in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    added = all("<|" in t.content and not t.lstrip and not t.rstrip for t in tokenizer.get_added_tokens_decoder().values())
    return added and rules == [NORMALIZER, PRE_TOKENIZER]


#: Words of ASCII and Latin-1 letters, and what the pre-tokenizer splits them into once they are lower-cased.
PLAIN, PARTS = "^[!-~À-ÖØ-öø-ÿ]+$", r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+)"


class _Parts:
    """Parts that the file's model has coded, as arrays; past ``CACHED_PARTS`` only those of the slice at hand stay."""

    def __init__(self, tokenizer):
        self.model, self.letters = tokenizer.model, _byte_letters()
        self.known, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _code(self, part: str) -> list[int]:
        spelt = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
        return [t.id for t in self.model.tokenize(spelt)]

    def places(self, parts: pa.Array) -> np.ndarray:
        """The places of different parts among the known ones; new ones are coded and join them."""
        at = pc.index_in(parts, value_set=self.known)
        new = parts.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        if len(self.known) + len(new) > CACHED_PARTS:
            stay = at[at >= 0]
            self.known = self.known.take(pa.array(stay))
            self.flat, _ = _gathered(self.flat, np.cumsum(self.sizes) - self.sizes, self.sizes, stay)
            self.sizes = self.sizes[stay]
            at[at >= 0] = np.arange(len(stay))
        ids = [self._code(p) for p in new.to_pylist()]
        at[at < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))))
        return at


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` by their codes end to end, and offsets."""
    ends = np.concatenate(([0], np.cumsum(sizes[codes])))
    place = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], sizes[codes])
    return flat[place], ends


def _coded_words(tokenizer):
    """Texts to their little-endian ids end to end, and offsets (n + 1), by words.

    The different words of a slice are split into parts and their different parts coded by the
    model; a word of other letters, or with a mark of the file's special tokens, goes through the
    whole tokenizer.
    """
    known = _Parts(tokenizer)

    def code(texts: pa.Array) -> tuple[bytes, list[int]]:
        offsets, words = words_of(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        plain = pc.and_not(pc.match_substring_regex(distinct, PLAIN), pc.match_substring(distinct, "<|"))
        marked = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(plain, distinct, "")), PARTS, r"\1 ")
        at, parts = words_of(marked)
        parts = parts.dictionary_encode()
        strange = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        place = known.places(parts.dictionary)
        other = [tokenizer.encode(w, add_special_tokens=False).ids for w in distinct.take(pa.array(strange)).to_pylist()]
        sizes = np.concatenate((known.sizes, np.fromiter(map(len, other), np.int64, len(other))))
        flat, starts = np.concatenate((known.flat, np.fromiter(itertools.chain.from_iterable(other), np.uint32))), np.cumsum(sizes) - sizes
        # the runs that make up each different word: its parts, or the one of a strange word
        number = np.diff(at)
        number[strange] = 1
        ends = np.concatenate(([0], np.cumsum(number)))
        own = np.zeros(ends[-1], bool)
        own[ends[strange]] = True
        runs = np.empty(ends[-1], np.int64)
        runs[own], runs[~own] = len(known.sizes) + np.arange(len(strange)), place[parts.indices.to_numpy()]
        flat, bounds = _gathered(flat, starts, sizes, runs)
        bounds = bounds[ends]
        tokens, ends = _gathered(flat, bounds[:-1], np.diff(bounds), coded.indices.to_numpy())
        return tokens.astype("<u4", copy=False).tobytes(), ends[offsets].tolist()

    return code


def _coded_texts(tokenizer):
    """The same by whole texts."""

    def code(texts: pa.Array) -> tuple[bytes, list[int]]:
        ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
        return b"".join(x.tobytes() for x in ids), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(int).tolist()

    return code


def _pieces(path: str, capacity: int):
    """(doc_id, text) to pieces.

    Where no rule of the tokenizer reaches over white space, words are looked up; a file with other
    rules codes whole texts.
    """

    def kernel(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        code = _coded_words(tokenizer) if _by_words(tokenizer) else _coded_texts(tokenizer)
        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                tokens, bounds = code(batch.column(1))
                out: tuple[list, ...] = ([], [], [], [], [])
                for i, doc in enumerate(batch.column(0).to_pylist()):
                    text = tokens[4 * bounds[i] : 4 * bounds[i + 1]] + b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(text), 4 * capacity)):
                        part = text[at : at + 4 * capacity]
                        for column, x in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(out)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return kernel


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins that no packing of these lengths can undercut.

    The largest sum over two families of dual-feasible functions: ``u_k`` (round down to the
    k + 1 fractions of a bin, k = 1..20) and the threshold functions that drop lengths below e
    and count those above capacity - e as a whole bin.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    number, total = np.cumsum(count), np.cumsum(count * x)
    for e in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - e])
        middle = int(total[capacity - e] - total[e - 1])
        best = max(best, large - (-middle // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Ties go by position."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            room, at, made = capacity, made, made + 1
        bins[i], offsets[i] = at, capacity - room
        if room > size:
            open_[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins, offsets, made


def _pack(capacity: int, level: int):
    """Packs one partition of pieces; ``released`` marks the documents that it offers for exchange."""

    def kernel(key, rows):
        part = key[0].as_py()
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "sequence_id", "offset"))])
        lengths, before, places = (rows.column(c).to_numpy() for c in ("length", "sequence_id", "offset"))
        bins, offsets, made = best_fit_decreasing(lengths, capacity)
        names = ((level << 56) | (part << 28)) + np.arange(made)
        codes, old = np.unique(before, return_inverse=True)
        if level and made >= len(codes):
            bins, offsets, made, names = old, places, len(codes), codes
        gap = made - lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=made)
        released = np.zeros(made, bool)
        released[np.argsort(fill, kind="stable")[: 8 * (gap + 1)]] = True
        released &= fill < capacity
        own = {c: rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        out = pa.table(own | {"sequence_id": names[bins], "offset": offsets, "part": np.full(len(bins), part), "released": released[bins]})
        give_back()
        return out

    return kernel


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = cut(pieces, "pieces")
    parts = -(-pieces.count() // PIECES_PER_PART) or 1
    # the place in the written pieces parts equal rows, too
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts))
    packed = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "part": deal})
    packed = cut(packed.groupBy("part").applyInArrow(_pack(capacity, 0), PACKED), "packed")
    done, level = packed.filter("not released"), 0
    while True:
        offered = packed.filter("released")
        met = offered.agg(F.countDistinct("part").alias("n")).first()["n"]
        if not met or (level and met == 1):
            return done.unionByName(offered).drop("part", "released")
        level += 1
        dealt = offered.withColumn("part", F.floor(F.col("part") / FAN_IN))
        packed = cut(dealt.groupBy("part").applyInArrow(_pack(capacity, level), PACKED), "packed")
        done = done.unionByName(packed.filter("not released"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize whole texts, end each with id 0, cut what is longer than ``capacity``, and pack."""
    rows = private(docs, doc_id=F.col(doc_id).cast("long"), text=F.col(text).cast("string"))
    return pack(rows.mapInArrow(_pieces(path, capacity), PIECES), capacity)
