"""Exact dedup by two passes over a Bloom filter, in DataFrame operations only.

Pass one counts the rows of each cell of a counting filter (CELLS cells a row; counts are combined in the tasks before they
are shuffled) and makes a Bloom filter of the cells that two rows or more share. Pass two tests each row against it: a row
whose bits are not all set has no equal anywhere and passes straight through; only the others are shuffled, by SHA-256.

Cells and filter grow with the rows and with the repeated cells, so the share of rows that are shuffled does not depend on the
size of the corpus. The filter is broadcast up to MAX_WORDS words (some eight million repeated cells); beyond, it is joined
by its words, for which rows send what they are here, a doc_id and two hashes, never a text.

Defined cases: a null text counts as empty; an empty table gives an empty result; rows that repeat a doc_id are rows of
their own, and all of a group's rows with the largest doc_id are kept; null doc_ids lose against any other, and in a group
that has nothing else they are kept. Columns other than the two named are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_WORDS, bloom, cut, filter_mask, filter_words, join_groups, temporary

CELLS = 64


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("h"), F.sha2(body, 256).alias("text_sha256"))


def possibly_repeated(rows: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``rows`` (h; a written table) with maybe: whether another row may have the same h."""
    cell = F.pmod("h", F.lit(max(1, CELLS * rows.count())))
    shared = cut(rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell"), slim=True)
    key = F.xxhash64("cell")
    words = filter_words(shared.count())
    marks = bloom(shared, key, words)
    if words <= max_words:
        marks = F.broadcast(marks)
    tested = rows.withColumn("cell", cell).withColumns({"word": F.pmod(key, F.lit(words)), "bits": filter_mask(key)}).join(marks, "word", "left")
    return tested.select(*rows.columns, F.coalesce(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)).alias("maybe"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``; of equal texts the largest doc_id stays."""
    with temporary(docs.sparkSession):
        tested = cut(possibly_repeated(cut(digests(docs, text, doc_id)), max_words).select("doc_id", "text_sha256", "maybe"), keep=True)
        met = tested.where("maybe").select("doc_id", "text_sha256")
        groups = cut(met.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), keep=True)
    out = lambda df: df.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    alone = tested.where("not maybe").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return out(alone).unionByName(out(join_groups(met, groups, ["text_sha256"])))
