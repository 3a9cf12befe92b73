"""Line dedup over content-defined chunks of lines, extended line by line, in DataFrame operations only.

A text's lines are hashed and a rolling hash over each pair of neighbouring line hashes chooses the chunk boundaries (so a
line put in or taken out moves only the boundaries beside it); of boundaries that would leave a chunk of fewer than
MIN_LINES lines only the first counts. A chunk that occurs again anywhere goes from all places but the first (smallest
doc_id, then text hash, then place). What such chunks leave is looked at in windows of MIN_LINES lines, across chunk
boundaries: the lines of a window that occurs again go from all places but the first. As every run of MIN_LINES or more
shared lines consists of such windows, the result is that of windows alone, whatever the chunks: a run that stands at an
earlier place goes whole, and the first place of each line always stays. Chunks and windows are paired by MD5; before
anything is removed, grouping by the bytes themselves proves that all that a hash has are one text.

Defined cases: null and empty texts stay as they are and have no lines; empty tables give empty results; rows that repeat
doc_id and text share one decision; null doc_ids come first; an empty line is a line as any other; a text whose lines all
go is empty; chunks or windows of a hash with two texts would all stay. Other columns pass through as they are, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, join_groups, maybe_in, parted, temporary

#: One pair of neighbouring lines in DIVISOR ends a chunk.
DIVISOR = 3
MIN_LINES = 2


def chunks(text: str, min_lines: int = MIN_LINES) -> Column:
    """A struct of a text column's lines and the last lines of its chunks, from 1, in order; null for texts without lines."""
    lines = F.split(F.col(text), "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))
    both = F.struct(lines.alias("lines"), hashes.alias("hashes"))
    size = lambda x: F.size(x["lines"])
    met = lambda x, i: (i > 1) & (F.pmod(31 * F.get(x["hashes"], i - 2) + F.get(x["hashes"], i - 1), F.lit(DIVISOR)) == 0)
    alone = lambda x, i: reduce(lambda a, k: a & ~met(x, i - k), range(1, min_lines), met(x, i))
    ends = lambda x: F.filter(F.sequence(F.lit(1), size(x)), lambda i: (i == size(x)) | ((i >= min_lines) & (size(x) - i >= min_lines) & alone(x, i)))
    # a one-element array binds the arrays, so that they are made once a row
    made = F.transform(F.array(both), lambda x: F.struct(x["lines"].alias("lines"), ends(x).alias("ends")))
    return F.when(F.col(text) != "", made[0])


def _body(x: Column, lo: Column, n: Column) -> Column:
    return F.array_join(F.slice(x["lines"], lo, n), "\n")


def _chunks(x: Column) -> Column:
    """array<struct<pos, n, body>> of what ``chunks`` gives; pos is the first line, from 1."""
    starts = F.concat(F.array(F.lit(1)), F.transform(F.slice(x["ends"], 1, F.size(x["ends"]) - 1), lambda e: e + 1))
    return F.zip_with(starts, x["ends"], lambda lo, hi: F.struct(lo.alias("pos"), (hi - lo + 1).alias("n"), _body(x, lo, hi - lo + 1).alias("body")))


def _windows(x: Column, min_lines: int) -> Column:
    """array<struct<pos, n, body, chunk>>: each ``min_lines`` lines; chunk is the first line of the chunk that has them all, or null."""
    n = F.lit(min_lines)
    starts = F.concat(F.array(F.lit(1)), F.transform(x["ends"], lambda e: e + 1))
    spans = F.zip_with(F.slice(starts, 1, F.size(x["ends"])), x["ends"], lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    of = F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["lo"], s["hi"]), lambda i: F.when(i + n - 1 <= s["hi"], s["lo"]))))
    one = lambda i, c: F.struct(i.alias("pos"), n.alias("n"), _body(x, i, n).alias("body"), c.alias("chunk"))
    last = F.size(x["lines"]) - n + 1
    return F.when(last > 0, F.zip_with(F.sequence(F.lit(1), last), F.slice(of, 1, last), one))


def _again(places: DataFrame, each: DataFrame) -> DataFrame:
    """The rows of ``places`` (doc_id, text_h, pos, n, hash; written) whose text is at an earlier place; ``each`` has the bodies by hash."""
    repeated = cut(places.groupBy("hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), slim=True)
    # as at the end, only places that may be repeated are shuffled, at any size
    met = cut(join_groups(maybe_in(places, F.xxhash64("hash"), repeated, F.xxhash64("hash")), repeated, ["hash"]).drop("size"))

    # equal bodies of a task meet in the partial aggregation before anything is shuffled; what a hash has left are its texts
    likely = maybe_in(each.select("hash", "body"), F.xxhash64("hash"), repeated, F.xxhash64("hash"))
    texts = likely.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    bodies = texts.where("texts = 1 and n > 1").select("hash")
    first = met.groupBy("hash").agg(F.min(F.struct("doc_id", "text_h", "pos")).alias("first"))
    groups = cut(first.join(bodies, "hash"))
    again = join_groups(met, groups, ["hash"]).where(~F.struct("doc_id", "text_h", "pos").eqNullSafe(F.col("first")))
    return again.select("doc_id", "text_h", "pos", "n")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with what stays of the text, and the longs n_lines and n_removed (underscores keep clashing names apart)."""
    body = F.col(text).cast("string")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).withColumn("text_h", F.xxhash64("text"))

    def spans(made: Callable[[Column], Column]) -> DataFrame:
        bound = F.transform(F.array(chunks("text", min_lines)), made)[0]
        rows = keyed.where("text != ''").select("doc_id", "text_h", F.explode(bound).alias("c")).select("doc_id", "text_h", "c.*")
        return rows.withColumn("hash", F.md5("body"))

    with temporary(docs.sparkSession):
        whole = spans(_chunks).where(F.col("n") >= min_lines)
        gone = cut(_again(cut(whole.drop("body")), whole))
        windows = spans(lambda x: _windows(x, min_lines))
        # the windows of a chunk that goes are at an earlier place too, none of them is a first one
        inside = F.col("p.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("p.text_h") == F.col("g.text_h")) & (F.col("p.chunk") == F.col("g.pos"))
        with temporary(docs.sparkSession):
            maybe, sure = parted(cut(windows.drop("body")), F.xxhash64("doc_id", "text_h", "chunk"), gone, F.xxhash64("doc_id", "text_h", "pos"))
            rest = cut(maybe.alias("p").join(gone.alias("g"), inside, "left_anti").unionByName(sure).drop("chunk"), keep=True)
        lost = gone.unionByName(_again(rest, windows)).select("doc_id", "text_h", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("line"))
        drops = cut(lost.groupBy("doc_id", "text_h").agg(F.collect_set("line").alias("drops")), keep=True)

    n_lines, n_removed, h, d = free_names(docs, "n_lines", "n_removed", "text_h", "drops")
    hashed = docs.withColumn(h, F.xxhash64(body))
    # texts that lose nothing are not shuffled
    maybe, rest = parted(hashed, F.xxhash64(F.col(f"`{doc_id}`"), F.col(h)), drops, F.xxhash64("doc_id", "text_h"))
    right = drops.select(F.col("doc_id").alias("r_id"), F.col("text_h").alias("r_h"), F.col("drops").alias(d)).alias("r")
    met = maybe.alias("l").join(right, F.col(f"l.`{doc_id}`").eqNullSafe(F.col("r.r_id")) & (F.col(f"l.`{h}`") == F.col("r.r_h")), "left")
    out = met.select(*[F.col(f"l.`{x}`") for x in docs.columns], F.col(d)).unionByName(rest.select(*[f"`{x}`" for x in docs.columns], F.lit(None).cast("array<int>").alias(d)))
    lines = F.when(F.coalesce(body, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(body, "\n", -1)))
    both = F.struct(F.split(body, "\n", -1).alias("lines"), F.col(d).alias("drops"))
    staying = lambda x: F.array_except(F.sequence(F.lit(1), F.size(x["lines"])), x["drops"])
    kept = F.transform(F.array(both), lambda x: F.array_join(F.transform(staying(x), lambda i: F.get(x["lines"], i - 1)), "\n"))[0]
    done = {
        n_lines: lines.cast("long"),
        n_removed: F.when(F.col(d).isNull(), F.lit(0)).otherwise(F.size(d)).cast("long"),
        text: F.when(F.col(d).isNull(), F.col(f"`{text}`")).otherwise(kept),
    }
    return out.withColumns(done).select(*[f"`{x}`" for x in docs.columns], n_lines, n_removed)
