"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Bytes covered by a SPAN-byte string that also starts in a document with a smaller doc_id are removed.

What is sorted. In each SPAN-byte window the smallest of its hashed GRAM-byte strings is its anchor. Equal windows have equal
anchors at equal places, so the suffixes that start at anchors (about one byte in fourteen), each with the bytes before it that
its windows may reach back to, decide every pair of equal windows: the suffix array is sparse, and complete for this purpose.
Suffixes are compared on their first SPAN bytes, as no window reaches further, and they are in the order of a hash of their
first GRAM bytes and only then of their bytes: that deals them evenly to ranges without samples, and strings that share a
window's part of GRAM bytes or more are neighbours in it as they are in an order of bytes alone.

Pruning. Hashes of anchors, not suffixes, go through the first exchange; suffixes whose anchor is in one document only
are never sent.

Sorting. Each task sorts its suffixes and combines equal ones, keeping the smallest document's: the others are covered.
Sorted runs travel front-coded (length of the prefix shared with the one before, and the rest). A loser tree merges the runs
of a range. Its players know the prefix they share with the last winner, from the front coding or from an earlier match, and
equality and order are read from the first byte beyond it that differs. The merge gives the order and the common prefixes
together; stretches of the order whose common prefix is long enough are equal windows' right parts. The left parts, the
reversed bytes before the anchors of a stretch, are put in order by columns in numpy, not by the merge.

Nothing is bounded by luck: a task sends one record for a hash or a suffix however many of its documents have it, so a
passage in a third of all documents sends a record a task. Ranges are as many as the input asks for, without a ceiling, and a
task, which may have several, holds one at a time.

Rows are told apart by doc_id and a hash of their text; texts are shuffled once to meet the tags of their anchors and once,
after those shuffle files are gone, to meet their spans.

Defined cases: null text is empty; texts shorter than SPAN bytes stay; matches never cross documents; rows that repeat a
doc_id, with whatever texts, are not each other's smaller document, and each loses what smaller doc_ids have of its own text;
rows without doc_id neither lose bytes nor make others lose any; any other doc_id, the least long too, is one as others are;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, temporary, tidy
from .shingles import mix

SPAN, GRAM = 50, 24
#: Anchors of a window start at one of so many places.
PLACES = SPAN - GRAM + 1
REACH = PLACES - 1
#: Bytes of text hashed together, anchors or suffixes that a task gathers before it sends a run, bytes of text a range.
CHUNK, GATHER, RUN, RANGE_BYTES = 1 << 20, 1 << 21, 1 << 18, 8 << 20
#: A range is a number of so many bits at most, which is 16 exabytes of text; tasks that take them, one or several each.
MOST_BITS, MOST_TASKS = 31, 1 << 17

_rng = np.random.default_rng(104729)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**62)) * 2 + 1
_power = np.cumprod(np.full(CHUNK + SPAN + 1, _BASE, np.uint64))
_inverse = np.cumprod(np.full(CHUNK + SPAN + 1, pow(_BASE, -1, 1 << 64), np.uint64))


def _slide(x: np.ndarray, least) -> np.ndarray:
    """``least`` (a ufunc) over each PLACES neighbours."""
    width = 1
    while 2 * width <= PLACES:
        x = least(x[:-width], x[width:])
        width *= 2
    rest = PLACES - width
    return least(x[:-rest], x[rest:]) if rest else x


def _anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in texts that stand in ``data`` one after the other, with these bounds."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power[:n], out=sums[1:])
    h = mix((sums[GRAM:] - sums[:-GRAM]) * _inverse[: n - GRAM + 1])
    least = _slide(h, np.minimum)
    good = np.zeros(n - SPAN + 1, bool)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= SPAN:
            good[lo : hi - SPAN + 1] = True
    least[~good] = 0
    most = _slide(np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)]), np.maximum)
    at = np.flatnonzero((most == h) & (h != 0))
    return at, mix(h[at])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of all anchors, by text and place."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        bounds = np.concatenate([[0], np.cumsum([len(x) for _, _, x in held])])
        at, h = _anchors(np.frombuffer(b"".join(x for _, _, x in held), np.uint8), bounds)
        k = np.searchsorted(bounds, at, "right") - 1
        out.append((np.array([t for t, _, _ in held])[k], at - bounds[k] + np.array([s for _, s, _ in held])[k], h))
        held.clear()

    size = 0
    for t, text in enumerate(texts):
        for lo in range(0, max(len(text) - SPAN + 1, 0), CHUNK - SPAN):
            piece = text[lo : lo + CHUNK - 1]
            if held and size + len(piece) > CHUNK:
                flush()
                size = 0
            held.append((t, lo, piece))
            size += len(piece)
    if held:
        flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, place, h = (np.concatenate(x) for x in zip(*out))
    new = np.ones(len(text), bool)  # pieces of a long text overlap
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    if not ((np.diff(text) > 0) | (np.diff(place) >= 0)).all():
        order = np.lexsort((place, text))
        text, place, h = text[order], place[order], h[order]
        new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    return text[new], place[new], h[new]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, each with its bytes in planes."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T if len(a) else a.view(np.uint8)
        parts += [np.array([len(a)], np.int64).tobytes(), a.dtype.str.ljust(4).encode(), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(data):
        n, kind = int(np.frombuffer(data, np.int64, 1, at)[0]), np.dtype(data[at + 8 : at + 12].decode().strip())
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at + 12)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += 12 + n * kind.itemsize
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [t.encode() if t else b"" for t in texts]


def _batches(columns: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _tag(h: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a hash below those that are its range."""
    return ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


#: Rows of an exchange: runs by range, and beside them rows of results that only pass through it.
_TAGS, _SPANS = ["doc_id", "a", "b"], ["doc_id", "text_h", "a", "b"]
_TAG_TYPES, _SPAN_TYPES = [pa.int64()] * 3, [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
TAGS, SPANS = "doc_id long, a long, b long", "doc_id long, text_h long, a int, b int"
SENT_TAGS, SENT_SPANS = (f"range int, {x}, run binary" for x in (TAGS, SPANS))


def _sent(names: list[str], types: list[pa.DataType], columns: Iterable) -> pa.RecordBatch:
    return _batches(columns, ["range", *names, "run"], [pa.int32(), *types, pa.binary()])


def _past(names: list[str], types: list[pa.DataType], bits: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Results as rows of an exchange, dealt to all ranges."""
    for lo in range(0, len(columns[0]), 1 << 16):
        part = [c[lo : lo + (1 << 16)] for c in columns]
        n = len(part[0])
        yield _sent(names, types, (np.arange(n) % (1 << bits), *part, [None] * n))


def _runs(names: list[str], types: list[pa.DataType], rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return _sent(names, types, ([r for r, _ in rows], *([None] * len(rows) for _ in names), [x for _, x in rows]))


def _cuts(spot: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each range of sorted ranges, and where it stands."""
    starts = np.flatnonzero(np.diff(spot, prepend=-1))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(spot)]):
        yield int(spot[lo]), slice(lo, hi)


def seen(bits: int):
    """Task over (doc_id, text): runs of anchor tags by range; and (doc_id, range a, tag b) of those in two of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            doc, h = np.concatenate(ids), np.concatenate(hashes)
            order = np.lexsort((doc, h))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc, h = doc[new], h[new]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            count = np.diff(np.append(np.flatnonzero(first), len(h)))
            many = np.repeat(count > 1, count)
            spot = (h >> np.uint64(64 - bits)).astype(np.int64)
            tag = _tag(h, bits)
            yield from _past(_TAGS, _TAG_TYPES, bits, doc[many], spot[many], tag[many].astype(np.int64))
            doc, tag, spot, told = doc[first], tag[first], spot[first], many[first]
            rows = []
            for r, x in _cuts(spot):
                own, at = np.unique(doc[x], return_inverse=True)
                rows.append((r, pack(deltas(tag[x]), at.astype(np.uint16 if len(own) < 65536 else np.uint32), deltas(own), told[x].astype(np.uint8))))
            if rows:
                yield _runs(_TAGS, _TAG_TYPES, rows)

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                t, _, h = anchors(_bytes(part.column(1).to_pylist()))
                ids.append(part.column(0).to_numpy(zero_copy_only=False)[t])
                hashes.append(h)
                held += len(h)
                if held >= GATHER:
                    yield from sent()
                    ids, hashes, held = [], [], 0
        if held:
            yield from sent()

    return run


def _by_range(batches: Iterator[pa.RecordBatch], names: list[str], types: list[pa.DataType], work) -> Iterator[pa.RecordBatch]:
    """Passes rows without a run through, and gives ``work`` the runs of one range after the other."""
    now, runs = None, []
    for x in batches:
        run = x.column(x.num_columns - 1)
        free = x.filter(pa.compute.is_null(run))
        if free.num_rows:
            yield pa.RecordBatch.from_arrays(free.columns[1:-1], names)
        bound = x.filter(pa.compute.is_valid(run))
        for r, value in zip(bound.column(0).to_pylist(), bound.column(x.num_columns - 1)):
            if r != now:
                if runs:
                    for out in work(now, runs):
                        yield _batches(out, names, types)
                now, runs = r, []
            runs.append(value.as_py())
    if runs:
        for out in work(now, runs):
            yield _batches(out, names, types)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over runs of tags: (doc_id, range a, tag b) of the tags in two runs or more, with what passes through."""

    def work(spot: int, runs: list[bytes]) -> Iterator[tuple]:
        parts = [unpack(r) for r in runs]
        tag = np.concatenate([np.cumsum(d, dtype=np.uint32) for d, _, _, _ in parts])
        doc = np.concatenate([np.cumsum(own)[at] for _, at, own, _ in parts])
        told = np.concatenate([t for _, _, _, t in parts]) > 0
        order = np.argsort(tag, kind="stable")
        tag, doc, told = tag[order], doc[order], told[order]
        twice = np.zeros(len(tag), bool)
        same = tag[1:] == tag[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        k = np.flatnonzero(twice & ~told)
        k = k[np.argsort(doc[k], kind="stable")]
        for lo in range(0, len(k), 1 << 16):
            x = k[lo : lo + (1 << 16)]
            yield doc[x], np.full(len(x), spot), tag[x].astype(np.int64)

    return _by_range(batches, _TAGS, _TAG_TYPES, work)


def merged_spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of half-open spans that overlap or touch, by document (small numbers) and place."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(doc * far + hi)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * far + lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[last] - doc[first] * far


def _by_row(doc: np.ndarray, text_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different (doc_id, text hash), and of all places the number of theirs."""
    order = np.lexsort((text_h, doc))
    d, h = doc[order], text_h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    number = np.empty(len(d), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of big-endian words, of which the first weighs most."""
    return [w.astype(np.uint64) for w in rows.view(">u8").T]


def _shared(rows: np.ndarray) -> np.ndarray:
    """Of each row of bytes, the length of the prefix shared with the row before."""
    differs = rows[1:] != rows[:-1]
    length = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], length]).astype(np.uint8)


def sorted_runs(bits: int):
    """Task over (doc_id, text_h, text, tags): front-coded runs of suffixes by range; and covered spans (doc_id, text_h, from a, to b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            doc, text_h, place, h, right, left, n_right, n_left = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, n_left, n_right, *_words(left)[::-1], *_words(right)[::-1], h))
            doc, text_h, place, h, right, left, n_right, n_left = (x[order] for x in (doc, text_h, place, h, right, left, n_right, n_left))
            new = np.ones(len(doc), bool)
            new[1:] = (h[1:] != h[:-1]) | (n_right[1:] != n_right[:-1]) | (n_left[1:] != n_left[:-1]) | (right[1:] != right[:-1]).any(axis=1) | (left[1:] != left[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            least = doc[first][np.cumsum(new) - 1]
            late = doc > least
            if late.any():
                own, k = _by_row(doc[late], text_h[late])
                lo = place[late] - np.minimum(n_left[late], REACH)
                hi = place[late] + np.minimum(n_right[late].astype(np.int64), SPAN)
                k, lo, hi = merged_spans(k, lo, hi)
                yield from _past(_SPANS, _SPAN_TYPES, bits, doc[late][own][k], text_h[late][own][k], lo, hi)
            stay = ~late
            doc, text_h, place, h, right, left, n_right, n_left = (x[stay] for x in (doc, text_h, place, h, right, left, n_right, n_left))
            text = np.concatenate([h.astype(">u8").view(np.uint8).reshape(-1, 8), right[:, :SPAN]], axis=1)
            rows = []
            for r, x in _cuts((h >> np.uint64(64 - bits)).astype(np.int64)):
                shared = _shared(text[x])
                rest = text[x][np.arange(text.shape[1]) >= shared[:, None]]
                own, at = _by_row(doc[x], text_h[x])
                rows.append((r, pack(shared, rest, left[x][:, :REACH].ravel(), n_right[x], n_left[x], deltas(doc[x][own]), text_h[x][own], at.astype(np.uint16 if len(own) < 65536 else np.uint32), place[x].astype(np.uint32))))
            if rows:
                yield _runs(_SPANS, _SPAN_TYPES, rows)

        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                texts = _bytes(part.column(2).to_pylist())
                t, place, h = anchors(texts)
                tags = part.column(3)
                spots = np.searchsorted(t, np.arange(len(texts) + 1))
                wanted = np.zeros(len(t), bool)
                key = ((h >> np.uint64(64 - bits)) << np.uint64(32)) | _tag(h, bits).astype(np.uint64)
                for k in range(len(texts)):
                    x = slice(spots[k], spots[k + 1])
                    if x.start < x.stop:
                        wanted[x] = np.isin(key[x], tags[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                t, place, h = t[wanted], place[wanted], h[wanted]
                if not len(t):
                    continue
                starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
                data = np.frombuffer(b"".join(texts), np.uint8)
                at, n_left = starts[t] + place, np.minimum(place, REACH)
                n_right = np.minimum(starts[t + 1] - at, SPAN)
                right, left = np.zeros((len(t), 56), np.uint8), np.zeros((len(t), 32), np.uint8)
                steps = np.arange(SPAN)
                right[:, :SPAN] = np.where(steps < n_right[:, None], data[np.minimum(at[:, None] + steps, len(data) - 1)], 0)
                steps = np.arange(REACH)
                left[:, :REACH] = np.where(steps < n_left[:, None], data[np.maximum(at[:, None] - 1 - steps, 0)], 0)
                held.append((*(part.column(k).to_numpy(zero_copy_only=False)[t] for k in (0, 1)), place, h, right, left, n_right.astype(np.uint8), n_left.astype(np.uint8)))
                size += len(t)
                if size >= RUN:
                    yield from sent()
                    held.clear()
                    size = 0
        if held:
            yield from sent()

    return run


class LoserTree:
    """Merges sorted runs of byte strings of one length. No comparison looks at bytes that are known to be shared.

    A player is a run with its next string and the length of the prefix that this shares with the string it last lost to,
    or with the last winner. Of two players who met the same winner, the one that shares more with it is smaller; only
    players that share equally much have bytes compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]) -> None:
        self.texts = [r[0] for r in runs]
        self.shared = [r[1] for r in runs]

    @staticmethod
    def compared(a: bytes, b: bytes, at: int) -> tuple[int, int]:
        """Two strings of one length that share ``at`` bytes: below 0, 0 or above 0 as the first is less, equal or greater, and their common prefix."""
        x, y = int.from_bytes(a[at:], "big"), int.from_bytes(b[at:], "big")
        return x - y, len(a) - ((x ^ y).bit_length() + 7) // 8

    def merge(self) -> tuple[list[int], list[int], list[int]]:
        """The run and the place in it of each string in order, and the prefix each shares with the one before."""
        texts, shared, compared = self.texts, self.shared, self.compared
        n = len(texts)
        width = 1 << max(n - 1, 0).bit_length()
        at = [0] * n
        know = [0] * width
        live = [k < n and bool(texts[k]) for k in range(width)]
        now = [texts[k][0] if live[k] else b"" for k in range(width)]

        def play(a: int, b: int) -> tuple[int, int]:
            """(winner, loser); the loser then knows what it shares with the winner."""
            if not live[b]:
                return a, b
            if not live[a]:
                return b, a
            x, y = know[a], know[b]
            if x != y:
                return (a, b) if x > y else (b, a)
            order, common = compared(now[a], now[b], x)
            if order < 0 or order == 0 and a < b:
                know[b] = common
                return a, b
            know[a] = common
            return b, a

        losers, winners = [0] * width, [0] * width + list(range(width))
        for node in range(width - 1, 0, -1):
            winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
        top = winners[1] if width > 1 else 0
        out_run, out_at, out_shared = [], [], []
        while live[top]:
            k = at[top]
            out_run.append(top)
            out_at.append(k)
            out_shared.append(know[top])
            k += 1
            at[top] = k
            if k < len(texts[top]):
                now[top], know[top] = texts[top][k], shared[top][k]
            else:
                live[top] = False
            node = (top + width) >> 1
            while node:
                rival = losers[node]
                if live[rival]:
                    if not live[top]:
                        losers[node], top = top, rival
                    else:
                        x, y = know[top], know[rival]
                        if x < y:
                            losers[node], top = top, rival
                        elif x == y:
                            top, losers[node] = play(top, rival)
                node >>= 1
        return out_run, out_at, out_shared


def front_decoded(shared: np.ndarray, rest: np.ndarray, width: int) -> list[bytes]:
    """The strings of a front-coded run."""
    data, ends, out, last = rest.tobytes(), np.cumsum(width - shared.astype(np.int64)).tolist(), [], b""
    lo = 0
    for n, hi in zip(shared.tolist(), ends):
        last = last[:n] + data[lo:hi]
        out.append(last)
        lo = hi
    return out


def covered(shared: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order: how far before and after its place each has bytes in a window that a smaller document has; 0, 0 if none.

    ``shared`` are the common right bytes with the suffix before, ``left`` the reversed bytes before the place.
    """
    n = len(doc)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort(_words(left)[::-1])
    in_left = _shared(left[order])
    for reach in range(PLACES):
        k = np.flatnonzero((n_left >= reach) & (n_right >= SPAN - reach))
        if not len(k):
            continue
        right_class = np.cumsum(shared < SPAN - reach)
        left_class = np.empty(n, np.int64)
        left_class[order] = np.cumsum(in_left < reach) if reach else 0
        key = right_class[k] * np.int64(n + 1) + left_class[k]
        by = np.argsort(key, kind="stable")
        k, key = k[by], key[by]
        new = np.ones(len(k), bool)
        new[1:] = key[1:] != key[:-1]
        least = np.minimum.reduceat(doc[k], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = k[doc[k] > least]
        before[hit] = reach
        after[hit] = np.maximum(after[hit], SPAN - reach)
    return before, after


def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over sorted runs of suffixes: covered spans (doc_id, text_h, from a, to b), with what passes through."""

    def work(_: int, runs: list[bytes]) -> Iterator[tuple]:
        parts = [unpack(r) for r in runs]
        width = 8 + SPAN
        texts = [(front_decoded(shared, rest, width), shared.tolist()) for shared, rest, *_ in parts]
        run_of, at, shared = (np.array(x, np.int64) for x in LoserTree(texts).merge())
        del texts
        starts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        order = starts[run_of] + at
        right = np.maximum(shared - 8, 0)
        # a suffix that shares less than GRAM bytes with both neighbours is alone
        near = right >= GRAM
        pair = near.copy()
        pair[:-1] |= near[1:]
        k = np.flatnonzero(pair)
        if not len(k):
            return
        chosen = order[k]
        left, n_right, n_left, place = (np.concatenate([p[j] if j > 2 else p[j].reshape(-1, REACH) for p in parts])[chosen] for j in (2, 3, 4, 8))
        doc, text_h = (np.concatenate([own[p[7]] for own, p in zip(each, parts)])[chosen] for each in ([np.cumsum(p[5]) for p in parts], [p[6] for p in parts]))
        padded = np.zeros((len(k), 32), np.uint8)
        padded[:, :REACH] = left
        before, after = covered(np.where(near, right, 0)[k], padded, n_right.astype(np.int64), n_left.astype(np.int64), doc)
        hit = np.flatnonzero(after)
        if not len(hit):
            return
        doc, text_h, place = doc[hit], text_h[hit], place[hit].astype(np.int64)
        own, which = _by_row(doc, text_h)
        which, lo, hi = merged_spans(which, place - before[hit], place + after[hit])
        for x in range(0, len(which), 1 << 16):
            y = slice(x, x + (1 << 16))
            yield doc[own[which[y]]], text_h[own[which[y]]], lo[y], hi[y]

    return _by_range(batches, _SPANS, _SPAN_TYPES, work)


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over (doc_id, text, spans): doc_id, the kept bytes, the text's length, and the number of maximal removed runs."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            texts = _bytes(part.column(1).to_pylist())
            out = []
            for text, of in zip(texts, part.column(2)):
                pairs = of.values
                if pairs is None or not len(pairs):
                    out.append((text, len(text), 0))
                    continue
                a, z = (pairs.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                _, a, z = merged_spans(np.zeros(len(a), np.int64), a, z)
                stay = [text[p:q] for p, q in zip([0, *z.tolist()], [*a.tolist(), len(text)])]
                out.append((b"".join(stay), len(text), len(a)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), [pa.binary(), pa.int64(), pa.int64()]))], ["doc_id", "kept", "n_bytes", "n_spans"])


def range_bits(size: int) -> int:
    """So many bits that a range has RANGE_BYTES of so many bytes of text, about."""
    return max(3, min(MOST_BITS, (size // RANGE_BYTES).bit_length()))


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_h, a, b): spans whose union in each row of (doc_id, text_h, text) is what is to be removed."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = range_bits(size)
    known = docs.where(f"doc_id is not null and octet_length(text) >= {SPAN}")
    by_range = lambda df: df.repartition(min(1 << bits, MOST_TASKS), "range").sortWithinPartitions("range")
    with temporary(docs.sparkSession):
        found = by_range(known.select("doc_id", "text").mapInArrow(tidy(seen(bits)), SENT_TAGS)).mapInArrow(tidy(repeated), TAGS)
        tags = cut(found.groupBy("doc_id").agg(F.collect_set(F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("tags")))
        met = known.hint("merge").join(tags.hint("merge"), "doc_id")
        runs = met.select("doc_id", "text_h", "text", "tags").mapInArrow(tidy(sorted_runs(bits)), SENT_SPANS)
        return cut(by_range(runs).mapInArrow(tidy(spans), SPANS), keep=True)


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_spans: one row per row of ``docs``."""
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_h"), body.alias("text"))
    by_row = removed_spans(rows).groupBy("doc_id", "text_h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return rows.join(by_row, ["doc_id", "text_h"], "left").select("doc_id", "text", "spans").mapInArrow(tidy(kept), "doc_id long, kept binary, n_bytes long, n_spans long")
