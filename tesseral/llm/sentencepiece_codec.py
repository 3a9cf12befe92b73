"""SentencePiece encoding and decoding by a batched numpy Viterbi pass.

Texts are cut into words (no piece has a word mark after another character, so no piece crosses a cut), and words that a
task hasn't met before are encoded together by length: all words of a length advance one character at a time. At each end
the hashes of the substrings that end there probe the sorted hashes of the pieces, and the best start is stored as the
backpointer. Words over LONG_WORD characters, such as whole texts without spaces, are cut further, between characters that
stand side by side in no piece; parts that are long still take the same pass, those of like length together.

What is best depends on the model. For unigram models it is the sum of scores. For BPE models that sum is not what
the library computes, so a step is weighed by whether BPE, given the two pieces side by side, would leave them so: exactly
one path has only such steps, and it is the library's. BPE merges in the order of scores, so what decides are the symbols that end
the left piece and begin the right one while these are put together: two of them that are there at the same time and make a piece of
a higher score than what either goes into next are merged across. Answers are remembered in a table of fixed size.

Characters without a piece become byte pieces, or the unknown piece in models that have none.

A worker holds the model (some 40 MB), WORDS words twice while a task runs, and a batch.

Defined cases: null texts have null ids; the empty text has no ids; "▁" (U+2581) in a text reads back as a space, as
it does in the library; columns that have the names of results give way to them, all others pass through; empty tables and
repeated rows need nothing special.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Texts and characters that a task takes together, and words (twice) that it remembers.
SLICE, SLICE_CHARS, WORDS = 1024, 1 << 21, 1 << 16
#: Ids that stand for no piece: the start of a word, a character without a piece, a place that no path reaches.
START, NO_PIECE, UNREACHED = -1, -2, -3
#: Words above this length are cut where no piece can cross.
LONG_WORD = 96
#: Characters of words that advance together, each word counted with as many more as a piece may have.
CELLS = 1 << 18
#: As a power of two, the pairs of pieces for which it is remembered whether BPE leaves them: 5 bytes each.
PAIR_BITS = 22
#: After the end of a word that is shorter than others of its batch.
PAD = 0x110000

_BASE = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Pieces, scores and kinds of a model, and its encoder. ``bpe`` chooses the weight of a step."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int], bpe: bool, prefix: bool = True, unknown: int = 0) -> None:
        self.pieces, self.bpe, self.prefix, self.unknown, self.bytes = pieces, bpe, prefix, unknown, byte_ids
        plain = [k for k in range(len(pieces)) if k not in special and pieces[k]]
        self.longest = max((len(pieces[k]) for k in plain), default=1)
        self.power = np.cumprod(np.full(self.longest + 1, _BASE, np.uint64)) * pow(int(_BASE), -1, 1 << 64)
        self.power = self.power.astype(np.uint64)
        keys = np.array([self.hashes(np.array([[ord(c) for c in pieces[k]]], np.uint64))[0, -1] for k in plain], np.uint64)
        #: By the high bits of a hash, whether any piece has it: most substrings are done with here.
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(keys >> np.uint64(44)).astype(np.int64)] = True
        #: The pairs of pieces that were asked for last, by their hash, and whether BPE leaves them.
        self.slots = np.full(1 << PAIR_BITS, -1, np.int32 if len(pieces) ** 2 < 1 << 31 else np.int64)
        self.fits = np.zeros(1 << PAIR_BITS, bool)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int64)[order]
        self.score = np.array(scores, np.float64)
        self.worst = float(self.score[plain].min() if plain else 0) - 10
        #: Pairs of characters that stand side by side in some piece.
        self.beside = np.unique(np.array([(ord(a) << 21) | ord(b) for k in plain for a, b in zip(pieces[k], pieces[k][1:])], np.int64))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.texts = [self._bytes(k, special) for k in range(len(pieces))]
        if bpe:
            self.learn_sides(plain)
        inner = any(MARK in pieces[k].lstrip(MARK) for k in plain)
        self.cut = re.compile("(?s:.+)" if inner else f"{MARK}*[^{MARK}]+|{MARK}+")

    def _bytes(self, k: int, special: set[int]) -> bytes:
        byte = {v: key for key, v in self.bytes.items()}.get(k) if k in special else None
        if byte is not None:
            return bytes([byte])
        return b" \xe2\x81\x87 " if k == self.unknown else b"" if k in special else self.pieces[k].replace(MARK, " ").encode()

    @staticmethod
    def hashes(chars: np.ndarray) -> np.ndarray:
        """Prefix hashes of rows of code points."""
        out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
        for k in range(chars.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + chars[:, k] + np.uint64(1)
        return out

    def find(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The pieces that stand from lo to hi in each row, or NO_PIECE. lo and hi: a column for each substring of a row."""
        rows = np.arange(len(sums))[:, None]
        size = hi - lo
        key = sums[rows, hi] - sums[rows, lo] * self.power[np.minimum(size, self.longest)]
        out = np.full(key.shape, NO_PIECE, np.int64)
        where = np.nonzero(self.gate[(key >> np.uint64(44)).astype(np.int64)] & (size <= self.longest) & (size > 0))
        key = key[where]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[where] = np.where(self.keys[at] == key, self.ids[at], NO_PIECE)
        return out

    def merged(self, chars: np.ndarray, last: np.ndarray | None = None) -> list[list[int]]:
        """Where the pieces of each row of code points end by BPE: the best pair is merged, the leftmost of equals, until none is left.

        ``last`` gets where the two pieces of a row met that were merged last.
        """
        n, length = chars.shape
        sums = self.hashes(chars)
        ends = np.tile(np.arange(length + 1), (n, 1))
        out: list[list[int]] = [[] for _ in range(n)]
        alive = np.arange(n)
        weigh = lambda lo, hi: np.where((ids := self.find(sums[alive], lo, hi)) >= 0, self.score[np.maximum(ids, 0)], -np.inf)
        score = weigh(ends[:, :-2], ends[:, 2:]) if length > 1 else np.full((n, 0), -np.inf)
        while len(alive):
            best = score.argmax(axis=1) if score.shape[1] else np.zeros(len(alive), np.int64)
            goes = score[np.arange(len(alive)), best] > -np.inf if score.shape[1] else np.zeros(len(alive), bool)
            for k in np.flatnonzero(~goes):
                out[alive[k]] = ends[k, 1:].tolist()
            alive, ends, score, best = alive[goes], ends[goes], score[goes], best[goes]
            if not len(alive):
                break
            if last is not None and ends.shape[1] == 3:
                last[alive] = ends[:, 1]
            left = np.ones(ends.shape, bool)
            left[np.arange(len(alive)), best + 1] = False
            ends = ends[left].reshape(len(alive), -1)
            score = score[left[:, 1:-1]].reshape(len(alive), -1)
            if score.shape[1]:
                for at in (best - 1, best):
                    k = np.flatnonzero((at >= 0) & (at < score.shape[1]))
                    if len(k):
                        part = sums[alive[k]]
                        ids = self.find(part, ends[k, at[k]][:, None], ends[k, at[k] + 2][:, None])[:, 0]
                        score[k, at[k]] = np.where(ids >= 0, self.score[np.maximum(ids, 0)], -np.inf)
        return out

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves pieces as they are when they stand side by side."""
        key = left * np.int64(len(self.pieces)) + right
        slot = ((key.astype(np.uint64) * _BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.fits[slot]
        new = np.flatnonzero(self.slots[slot] != key)
        if len(new):
            out[new] = self._together(key[new])
            self.slots[slot[new]] = key[new]
            self.fits[slot[new]] = out[new]
        return out

    def _together(self, key: np.ndarray) -> np.ndarray:
        each, back = np.unique(key, return_inverse=True)
        a, b = each // len(self.pieces), each % len(self.pieces)
        fits, direct = np.zeros(len(each), bool), self.direct[a] & self.direct[b]
        fits[direct] = self.apart(a[direct], b[direct])
        fits[~direct] = self.apart_by_merging(a[~direct], b[~direct])
        return fits[back]

    def apart_by_merging(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves two pieces side by side, by doing it."""
        fits = np.zeros(len(left), bool)
        by_length: dict[int, list[tuple[int, str, int]]] = defaultdict(list)
        for at, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            text = self.pieces[a] + self.pieces[b]
            by_length[len(text)].append((at, text, len(self.pieces[a])))
        for group in by_length.values():
            ends = self.merged(np.array([[ord(c) for c in text] for _, text, _ in group], np.uint64))
            for (at, text, n), e in zip(group, ends):
                fits[at] = e == [n, len(text)]
        return fits

    def learn_sides(self, plain: list[int]) -> None:
        """How BPE makes each piece: the symbols that are its last and its first one meanwhile, from a character up to the piece,
        each with its length, its hash and the score of what it goes into. ``direct``: whether its scores fall from parts to pieces
        and no other piece has its score, which ``apart`` builds on; runs of word marks are the exception."""
        splits, whole = np.zeros(len(self.pieces), np.int32), np.zeros(len(self.pieces), bool)
        by_length: dict[int, list[int]] = defaultdict(list)
        for k in plain:
            by_length[len(self.pieces[k])].append(k)
        for length, group in by_length.items():
            last = np.zeros(len(group), np.int32)
            ends = self.merged(np.array([[ord(c) for c in self.pieces[k]] for k in group], np.uint64), last)
            splits[group], whole[group] = last, [len(e) == 1 for e in ends]
        self.whole, number = whole, {self.pieces[k]: k for k in plain}
        _, which, often = np.unique(self.score[plain], return_inverse=True, return_counts=True)
        self.direct = np.ones(len(self.pieces), bool)
        self.direct[plain] = often[which] == 1
        sides: tuple[list, ...] = ([], [])
        for k in range(len(self.pieces)):
            for side, found in enumerate(sides):
                text, score, own = self.pieces[k], -np.inf, []
                while whole[k]:
                    own.append((len(text), score, text))
                    if len(text) == 1:
                        break
                    at, score = int(splits[number[text]]), float(self.score[number[text]])
                    text = text[:at] if side else text[at:]
                    other = number.get(text)
                    if len(text) > 1 and (other is None or not whole[other] or self.score[other] <= score):
                        self.direct[k] = False
                        break
                found.append(own[::-1])
        self.sides = []
        for found in sides:
            flat = [x for own in found for x in own]
            starts = np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32)
            hashes = np.zeros(len(flat), np.uint64)
            for length in {n for n, _, _ in flat}:
                at = [j for j, (n, _, _) in enumerate(flat) if n == length]
                hashes[at] = self.hashes(np.array([[ord(c) for c in flat[j][2]] for j in at], np.uint64))[:, -1]
            self.sides.append((starts, np.array([n for n, _, _ in flat], np.int32), np.array([x for _, x, _ in flat], np.float64), hashes))

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves two pieces side by side: no symbol that ends the left one is merged with one that begins the right one."""
        (a_start, a_size, a_next, a_hash), (b_start, b_size, b_next, b_hash) = self.sides
        fits = self.whole[left] & self.whole[right]
        at = np.flatnonzero(fits)
        i, j = a_start[left[at]].copy(), b_start[right[at]].copy()
        while len(at):
            size = a_size[i] + b_size[j]
            key = a_hash[i] * self.power[b_size[j]] + b_hash[j]
            score = np.full(len(at), -np.inf)
            some = np.flatnonzero((size <= self.longest) & self.gate[(key >> np.uint64(44)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
            met = self.keys[spot] == key[some]
            score[some[met]] = self.score[self.ids[spot[met]]]
            # of equal scores the leftmost pair comes first: what ends the left piece, then this pair, then what begins the right one
            x, y = a_next[i], b_next[j]
            across = (score > x) & (score >= y)
            fits[at[across]] = False
            on = ~across & ((x > -np.inf) | (y > -np.inf))
            step = x >= y
            at, i, j = at[on], (i + step)[on], (j + ~step)[on]
        return fits

    def viterbi(self, words: list[str]) -> list[bytes]:
        """The ids, as bytes, of words of one length, or of like lengths: the shorter ones go on through PAD."""
        sizes = [len(w) for w in words]
        n, length = len(words), max(sizes)
        chars = np.full((n, length), PAD, np.uint64)
        chars[np.arange(length) < np.array(sizes)[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sums = self.hashes(chars)
        back, last = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), UNREACHED, np.int32)
        last[:, 0] = START
        total = np.full((n, length + 1), -np.inf) if not self.bpe else None
        if total is not None:
            total[:, 0] = 0
        rows = np.arange(n)
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - self.longest), end)
            lo = np.tile(starts, (n, 1))
            ids = self.find(sums, lo, np.full_like(lo, end))
            before = last[:, starts].astype(np.int64)
            there = (before != UNREACHED) & (ids >= 0)
            there[:, -1] |= before[:, -1] != UNREACHED  # a character without a piece
            if total is None:
                asked = there & (ids >= 0) & (before >= 0)
                if asked.any():
                    there[asked] = self.together(before[asked], ids[asked])
                weight = np.where(there, 0.0, -np.inf)
            else:
                weight = np.where(there, total[:, starts] + np.where(ids >= 0, self.score[np.maximum(ids, 0)], self.worst), -np.inf)
            best = weight.argmax(axis=1)
            good = weight[rows, best] > -np.inf
            back[:, end] = starts[best]
            if total is not None:
                total[:, end] = weight[rows, best]
            last[:, end] = np.where(good, ids[rows, best], UNREACHED)
        return self.traced(chars, np.array(sizes), back, last)

    def traced(self, chars: np.ndarray, at: np.ndarray, back: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The ids along the backpointers, of all words a step at a time from their ends."""
        rows, steps = np.arange(len(at)), []
        while at.any():
            ids = last[rows, at]
            # START fills what is before a word's first piece; a character without a piece is its code, from UNREACHED down
            steps.append(np.where(at == 0, START, np.where(ids >= 0, ids, UNREACHED - chars[rows, at - 1].astype(np.int32))))
            at = back[rows, at]
        made = np.stack(steps[::-1], axis=1)
        there = made != START
        ids, ends = made[there].astype(np.int32), np.cumsum(there.sum(axis=1))
        bounds = [0, *ends.tolist()]
        data = ids.tobytes()
        out = [data[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]
        # only words that have such characters are spelt, whatever words share their batch
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), side="right")).tolist():
            out[k] = self.spelling(ids[bounds[k] : bounds[k + 1]].tolist())
        return out

    def spelling(self, ids: list[int]) -> bytes:
        """The ids of a word, as bytes, its characters without a piece spelt."""
        return np.array([x for k in ids for x in ([k] if k >= 0 else self.spelt(UNREACHED - k))], np.int32).tobytes()

    def parts(self, word: str) -> list[str]:
        """A word, cut where two characters stand side by side in no piece if it is long."""
        if len(word) <= LONG_WORD:
            return [word]
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = (chars[:-1] << 21) | chars[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), max(0, len(self.beside) - 1))
        free = self.beside[at] != pair if len(self.beside) else np.ones(len(pair), bool)
        ends = [*(np.flatnonzero(free) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip([0, *ends], ends)]

    def spelt(self, char: int) -> list[int]:
        return [self.bytes[b] for b in chr(char).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [self.cut.findall((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        cut = [c if not c or len(max(c, key=len)) <= LONG_WORD else [p for w in c for p in self.parts(w)] for c in cut]
        if len(self.words) > WORDS:
            self.words, self.older = {}, self.words
        new = []
        for word in {w for c in cut for w in c}:
            if word not in self.words:
                if word in self.older:
                    self.words[word] = self.older[word]
                else:
                    new.append(word)
        new.sort(key=len)
        lo = 0
        while lo < len(new):
            # equal lengths, or beyond LONG_WORD lengths that differ by an eighth at most, in so many cells
            longest = len(new[lo]) + (len(new[lo]) // 8 if len(new[lo]) > LONG_WORD else 0)
            most = max(1, CELLS // (longest + 16))
            hi = lo + 1
            while hi < len(new) and hi - lo < most and len(new[hi]) <= longest:
                hi += 1
            part = new[lo:hi]
            self.words.update(zip(part, self.viterbi(part)))
            lo = hi
        return [None if t is None else np.frombuffer(b"".join(map(self.words.__getitem__, c)), np.int32) for t, c in zip(texts, cut)]

    def forget(self) -> None:
        """Lets go of the words; workers live on after a task."""
        self.words, self.older = {}, {}

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return data[1 if self.prefix and data[:1] == b" " else 0 :].decode("utf-8", "replace")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message: an integer, or bytes of a string, message or float."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


#: Kinds of pieces, the type of a BPE model, and the numbers of fields in a model file.
NORMAL, UNKNOWN, USER_DEFINED, BYTE, BPE = 1, 2, 4, 6, 2
PIECE, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, KIND, MODEL_TYPE, RULE, PREFIX, TRIMS = 1, 2, 3, 3, 1, 3, 4


@cache
def load(path: str) -> Model:
    """The model in a file, read without the library, whose message classes would stay in every worker."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds = [], [], []
    trainer, normalizer = {MODEL_TYPE: 1}, {RULE: b"", PREFIX: 1, TRIMS: 1}
    for number, value in fields(data):
        if number == PIECE:
            piece = {TEXT: b"", SCORE: bytes(4), KIND: NORMAL} | dict(fields(value))
            pieces.append(piece[TEXT].decode())
            scores.append(struct.unpack("<f", piece[SCORE])[0])
            kinds.append(piece[KIND])
        elif number == TRAINER:
            trainer |= dict(fields(value))
        elif number == NORMALIZER:
            normalizer |= dict(fields(value))
    byte_ids = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(pieces, kinds)) if kind == BYTE}
    unknown = next((k for k, kind in enumerate(kinds) if kind == UNKNOWN), 0)
    special = {k for k, kind in enumerate(kinds) if kind not in (NORMAL, USER_DEFINED)}
    if normalizer[RULE] not in (b"identity", b"") or normalizer[TRIMS]:
        raise ValueError(f"normalization {normalizer[RULE].decode()!r} isn't supported")
    return Model(pieces, scores, byte_ids, special, trainer[MODEL_TYPE] == BPE, bool(normalizer[PREFIX]), unknown)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Half-open ranges of texts, of SLICE texts or about SLICE_CHARS characters."""
    lo = size = 0
    for k, n in enumerate(pa.compute.binary_length(texts).fill_null(0).to_pylist()):
        if k > lo and (k - lo == SLICE or size + n > SLICE_CHARS):
            yield lo, k
            lo, size = k, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL, decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of a text column in the place of that column; ``decoded`` names a column for the ids' text,
    made in the same pass. Columns of ``docs`` that have these names go."""
    place = docs.columns.index(text)
    rest = [k for k, c in enumerate(docs.columns) if k != place and c not in (ids, decoded)]
    schema = StructType([docs.schema[k] for k in rest]).add(ids, ArrayType(IntegerType()))
    if decoded:
        schema = schema.add(decoded, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model)
        try:
            for b in batches:
                for lo, hi in _slices(b.column(place)):
                    part = b.slice(lo, hi - lo)
                    found = coder.encode(part.column(place).to_pylist())
                    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in found])]).astype(np.int32)
                    values = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)])
                    mask = pa.array([x is None for x in found], pa.bool_())
                    made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)]
                    if decoded:
                        made.append(pa.array([None if x is None else coder.decode(x) for x in found], pa.string()))
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), *made], schema.names)
        finally:
            coder.forget()

    return docs.mapInArrow(tidy(run), schema)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with the text of an ids column beside it, in the place of a column that has its name."""
    place = docs.columns.index(ids)
    rest = [k for k, c in enumerate(docs.columns) if c != text]
    schema = StructType([docs.schema[k] for k in rest]).add(text, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                lists = [x.values for x in part.column(place)]
                texts = [None if x is None else coder.decode(x.to_numpy(zero_copy_only=False)) for x in lists]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array(texts, pa.string())], schema.names)

    return docs.mapInArrow(tidy(run), schema)
