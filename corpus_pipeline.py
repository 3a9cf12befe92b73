"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Language profiles are learnt from the rows that the first stage judges; that stage asks how far a text is from every known language,
not which one it is in, so its own part in the profiles does not decide.

Defined cases, by stage. Language ID: a null or empty text and one without a letter go, as does every row if no row has a
language and a text to learn from; a null lang or doc_id is no reason to go. Line dedup: every row stays, a text may become empty; rows that
repeat doc_id and text get equal texts. Near-dedup: rows that repeat a doc_id stay or go together; those without doc_id stay.
Decontamination: null and empty texts stay; without items every row does. SentencePiece: null texts have null ids and no tokens.
Empty tables give empty tables; columns beyond COLUMNS are not read and do not come out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm.common import cut, temporary, without
from tesseral.llm.decontaminate import decontaminate
from tesseral.llm.language_id import UNKNOWN, learn, predict
from tesseral.llm.line_dedup import line_dedup
from tesseral.llm.near_dedup import near_dedup
from tesseral.llm.sentencepiece_codec import encode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts nearer to no profile than this are in no known language: with one language of sf0.1 left out of the profiles, 95 to
#: 97 % of its documents score less; with all learnt the least score is 0.384 there and 0.350 on 51,282 other documents.
LEAST_SCORE = 0.34
#: Percent of shared shingles that links near copies.
SIMILAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that are far from every language learnt from the stage's labels."""
    judged = predict(docs.select(*COLUMNS), learn(docs))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated chunks of lines out of the texts; every document stays, n_chars follows its text."""
    kept = line_dedup(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies."""
    with temporary(spark):
        gone = cut(near_dedup(docs, percent=SIMILAR).where("not kept").select("doc_id").distinct(), slim=True, keep=1)
    return without(docs.select(*COLUMNS), F.col("doc_id").cast("long"), gone, "doc_id")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and whether decoding the ids gives the text."""
    rows = docs.select("doc_id", "source", "text", F.sha2("text", 256).alias("text_sha256"))
    back = encode(rows, decoded="decoded")
    return back.select("doc_id", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.sha2("decoded", 256).eqNullSafe(F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Language profiles, min-max signatures and piece models have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark):  # what a stage leaves goes with the next one's end, its documents at the end of all
        for k, (_, stage) in enumerate(STAGES):
            with temporary(spark):
                docs = cut(stage(spark, docs, sf_dir), keep=2 if k == len(STAGES) - 1 else 1)
    return docs
