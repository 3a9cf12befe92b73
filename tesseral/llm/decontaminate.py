"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item is small and a document large, so signatures are made for containment, not for resemblance. An item's
signature is its bottom-k MinHash: the k smallest hashes of its distinct word 5-grams, k being one more than the number that a
document may lack. It has to be met at least once by a document with the asked containment, whatever the document's length, so
the search loses nothing. Items are partitioned by size (powers of two of their shingles), and a document is a candidate for an item only if it is
long enough for the item's class.

One scan of the documents does the search: each task hashes a document's shingles and holds them against two Bloom filters, one
of all signatures, one of all shingles of items. Of a document that meets a signature the shingles that pass are sent on, with
their words. They are joined with the table of the items' shingles by hash and words, and a candidate is verified by counting
distinct shingles, words and all: exact containment. Both sides of the join are plain tables, of which Spark splits hot keys.

What reaches the driver are the filters, of MAX_WORDS words of 64 bits at most (beyond some eight million shingles of items more
shingles pass by chance, and the join settles them), and the numbers of words that shingles have.

Defined cases: words are runs of ASCII letters and digits and characters beyond ASCII, in lower case; an item of fewer
than five words is one shingle of that many words; items and documents without words match nothing; empty tables give
empty results; repeated rows are each reported; null ids are kept. Columns other than those named are not read by
``contained`` and pass through ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_WORDS, cut, filter_words, temporary, tidy, without
from .shingles import grams, mix, word_hashes

GRAM = 5
CONTAINMENT = 0.8
#: Texts and characters that a task takes together, and rows that it sends at once.
SLICE, SLICE_CHARS, SENT = 256, 1 << 20, 1 << 14

_SPLIT = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_BITS = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split() if text else []


def fewest(size: int, containment: float) -> int:
    """The shared shingles that an item of this size asks for."""
    return int(np.ceil(containment * size - 1e-9))


def shingle_table(benchmark: DataFrame, containment: float, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item (a number for each row), item_id, n (words of a shingle), n_item, least (of the size class), h, words, signed: the distinct shingles of each item."""
    schema = "item long, item_id long, n int, n_item long, least long, h long, words binary, signed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, key, body in zip(*(c.to_pylist() for c in b.columns)):
                w = words(body)
                if not w:
                    continue
                n = min(GRAM, len(w))
                sets = list(dict.fromkeys(b" ".join(w[j : j + n]) for j in range(len(w) - n + 1)))
                h = grams(*word_hashes([s.split() for s in sets]), n)[0]
                size = len(sets)
                signed = np.zeros(size, bool)
                signed[np.argsort(h, kind="stable")[: size - fewest(size, containment) + 1]] = True
                least = fewest(1 << (size.bit_length() - 1), containment)
                one = lambda x, t: pa.array([x] * size, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [one(item, pa.int64()), one(key, pa.int64()), one(n, pa.int32()), one(size, pa.int64()), one(least, pa.int64()), pa.array(h.view(np.int64)), pa.array(sets, pa.binary()), pa.array(signed)],
                    ["item", "item_id", "n", "n_item", "least", "h", "words", "signed"],
                )

    rows = benchmark.where(F.length(text) > 0).select(F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return cut(rows.mapInArrow(tidy(run), schema))


class Gate:
    """A Bloom filter of hashes as numpy words: three bits of one word each."""

    def __init__(self, size: int) -> None:
        self.words = np.zeros(size, np.uint64)

    @staticmethod
    def bits(h: np.ndarray) -> np.ndarray:
        x = mix(h ^ _BITS)
        one = np.uint64(1)
        return (one << (x & np.uint64(63))) | (one << ((x >> np.uint64(6)) & np.uint64(63))) | (one << ((x >> np.uint64(12)) & np.uint64(63)))

    def at(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.words) - 1)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        bits = self.bits(h)
        return (self.words[self.at(h)] & bits) == bits

    @staticmethod
    def of(hashes: DataFrame, most: int = MAX_WORDS) -> Gate:
        """Of all rows (h): tasks make masks, which are combined by word; the driver gets the words."""
        size = min(most, filter_words(hashes.count()))
        gate = Gate(size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            empty = Gate(1)
            empty.words = np.broadcast_to(np.uint64(0), size)
            for b in batches:
                h = b.column(0).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(empty.at(h)), pa.array(Gate.bits(h).view(np.int64))], ["word", "bits"])

        made = hashes.mapInArrow(tidy(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("mask")).toArrow()
        gate.words[made.column(0).to_numpy()] = made.column(1).to_numpy().view(np.uint64)
        return gate


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and (k - lo == SLICE or size + len(t or "") > SLICE_CHARS):
            yield lo, k
            lo, size = k, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def met(rows: DataFrame, kinds: list[int], signed: Gate, known: Gate) -> DataFrame:
    """row, doc_id, text_key, size, n, h, words: of each row (doc_id, text_key, text) that meets a signature, the distinct shingles
    that items may have. size: the row's shingles of that many words."""
    names = ["row", "doc_id", "text_key", "size", "n", "h", "words"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 40, []
        for b in batches:
            ids, keys, texts = (c.to_pylist() for c in b.columns)
            for lo, hi in _slices(texts):
                split = [words(t) for t in texts[lo:hi]]
                hashed = word_hashes(split)
                for n in kinds:
                    h, starts = grams(*hashed, n)
                    near = np.flatnonzero(signed.has(h))
                    if not len(near):
                        continue
                    asked = np.unique(np.searchsorted(starts, near, "right") - 1)
                    for t in asked.tolist():
                        own = h[starts[t] : starts[t + 1]]
                        found = {}
                        for j in np.flatnonzero(known.has(own)).tolist():
                            found.setdefault(b" ".join(split[t][j : j + n]), int(own[j].view(np.int64)))
                        held += [(number + lo + t, ids[lo + t], keys[lo + t], len(own), n, x, w) for w, x in found.items()]
                        if len(held) >= SENT:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), types)], names)
                            held = []
            number += b.num_rows
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), types)], names)

    return rows.mapInArrow(tidy(run), "row long, doc_id long, text_key string, size long, n int, h long, words binary")


def search(rows: DataFrame, items: DataFrame, containment: float) -> DataFrame:
    """doc_id, text_key, item_id, n_shared, n_item: a row for each row of (doc_id, text_key, text) and item of which it holds enough."""
    kinds = sorted(r.n for r in items.select("n").distinct().collect())
    signed, known = (Gate.of(x.select("h").distinct()) for x in (items.where("signed"), items))
    shared = met(rows, kinds, signed, known).join(items, ["n", "h", "words"]).where("size >= least")
    counted = shared.groupBy("row", "item").agg(*[F.first(c).alias(c) for c in ("doc_id", "text_key", "item_id", "n_item")], F.count(F.lit(1)).alias("n_shared"), F.max("signed").alias("signed"))
    return counted.where(F.col("signed") & (F.col("n_shared") >= F.lit(containment) * F.col("n_item") - 1e-9)).select("doc_id", "text_key", "item_id", "n_shared", "n_item")


def contained(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: a row for each document and item of which it holds enough."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text_key"), F.col(text).cast("string").alias("text"))
    with temporary(docs.sparkSession):
        found = cut(search(rows, shingle_table(benchmark, containment, item_id, item_text), containment), slim=True, keep=True)
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows whose text holds enough of an item."""
    body = F.col(text).cast("string")
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.md5(body).alias("text_key"), body.alias("text"))
    with temporary(docs.sparkSession):
        bad = cut(search(rows, shingle_table(benchmark, containment, item_id, item_text), containment).select("text_key").distinct(), slim=True, keep=True)
    return without(docs, F.md5(body), bad, "text_key")
