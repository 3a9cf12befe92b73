"""Language identification by rank-order profiles.

A language's profile is the ranked list of the most frequent letter n-grams (one to three letters, with word edges) of
all its labelled texts; a document's list is made the same way and compared by out-of-place distance. Counts cover every
labelled row: tasks count their rows and send sums by n-gram, whose number is bounded by the alphabet, not by the corpus.
What reaches the driver is RANKS rows a language.

Defined cases: a null text or one without a letter is "und" with score 0, as is any text if nothing was learnt; ties of
counts go to the smaller n-gram code, ties of distance to the smaller language name; rows with a null language or text
teach nothing; empty tables and repeated rows need nothing special; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import tidy

RANKS = 300
UNKNOWN = "und"
#: Characters that a task takes together, and n-grams that it holds before it sends their counts on.
SLICE_CHARS = 1 << 17
HELD = 1 << 17

_EDGE = 0x110000
_BITS = np.int64(21)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Half-open ranges of texts with about SLICE_CHARS characters each; a longer text stands alone."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t or "") > SLICE_CHARS:
            yield lo, k
            lo, size = k, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By n = 1, 2, 3: the codes of all texts' n-grams, and where each text's begin (one more at the end)."""
    low = [(t or "").lower() for t in texts]
    chars = np.frombuffer("".join(f"{t}\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    chars = np.where(_letters()[chars], chars, _EDGE)
    edge = chars == _EDGE
    kept = ~edge
    kept[1:] |= ~edge[:-1]
    kept[:1] = True
    chars, of = chars[kept], of[kept]
    chars, of = np.concatenate([[_EDGE], chars]), np.concatenate([[0], of])
    edge = chars == _EDGE
    one = ~edge
    a, b = chars[:-1], chars[1:]
    two = one[:-1] | one[1:]
    three = one[1:-1]
    parts = [
        (chars[one], of[one]),
        (((a << _BITS) | b)[two], np.where(one[:-1], of[:-1], of[1:])[two]),
        (((chars[:-2] << (2 * _BITS)) | (chars[1:-1] << _BITS) | chars[2:])[three], of[1:-1][three]),
    ]
    bounds = [np.searchsorted(o, np.arange(len(low) + 1)) for _, o in parts]
    return [c for c, _ in parts], bounds


def ranked(codes: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent codes, in order."""
    found, count = np.unique(codes, return_counts=True)
    return found[np.argsort(-count, kind="stable")[:ranks]]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", ranks: int = RANKS) -> dict[str, list[int]]:
    """The profile of each language: its most frequent n-grams in order."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(sums)], ["lang", "gram", "n"])
            held.clear()

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                codes, bounds = ngrams(texts[lo:hi])
                own = names[lo:hi]
                for name in set(own):
                    rows_of = [k for k, x in enumerate(own) if x == name]
                    found, n = np.unique(np.concatenate([c[s[k] : s[k + 1]] for c, s in zip(codes, bounds) for k in rows_of]), return_counts=True)
                    held.setdefault(name, []).append((found, n))
                    size += len(found)
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    sums = rows.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = sums.withColumn("place", place).where(F.col("place") <= ranks).select("lang", "place", "gram").collect()
    out: dict[str, list[int]] = {}
    for name, _, code in sorted(found):
        out.setdefault(name, []).append(code)
    return out


class Judge:
    """Distances of texts to profiles."""

    def __init__(self, profiles: dict[str, list[int]], ranks: int = RANKS) -> None:
        self.names, self.ranks = sorted(profiles), ranks
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.places = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            self.places[k, np.searchsorted(self.codes, profiles[name])] = np.arange(len(profiles[name]))

    def best(self, codes: np.ndarray) -> tuple[str, float]:
        """The nearest language of a text's n-gram codes, and one less its distance as a part of the largest possible."""
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = ranked(codes, self.ranks)
        at = np.searchsorted(self.codes, top)
        at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        place = self.places[:, at]
        apart = np.where(place < 0, self.ranks, np.abs(place - np.arange(len(top)))).sum(axis=1)
        k = int(np.argmin(apart))
        return self.names[k], 1.0 - float(apart[k]) / (self.ranks * len(top))

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for lo, hi in slices(texts):
            codes, bounds = ngrams(texts[lo:hi])
            out += [self.best(np.concatenate([c[s[k] : s[k + 1]] for c, s in zip(codes, bounds)])) for k in range(hi - lo)]
        return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", ranks: int = RANKS, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, which take the place of columns that have these names."""
    place = docs.columns.index(text)
    rest = [k for k, c in enumerate(docs.columns) if c not in (lang_pred, score)]
    schema = StructType([docs.schema[k] for k in rest]).add(lang_pred, StringType()).add(score, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, ranks)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = judge.judge(part.column(place).to_pylist())
                columns = [part.column(k) for k in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema.names)

    return docs.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the labelled rows that aren't held out."""
    profiles = learn(docs.where(~held_out(doc_id)), text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))
    return predict(rows, profiles).drop("text")
