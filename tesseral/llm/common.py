"""What the operators of this package share: cutting lineage, letting go of tables and memory, joins that survive hot keys."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of tables that ``cut`` wrote, by the scopes that are open; the first list is of what no scope will delete.
_written: list[list[str]] = [[]]
#: Spark deletes a query's shuffle files when it ends, instead of when the driver next collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local folder is set, but only if executors are threads of the driver: what executors of a cluster
    wrote to their own disks would read back as nothing.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def cut(df: DataFrame, slim: bool = False, keep: int = 0) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: a lost executor costs nothing that is upstream.

    ``slim`` is for tables of ids, whose shuffle partitions are small: at most four tasks a core write them. ``keep``: so many
    scopes of ``temporary`` the table outlives, from the one in which it is written.
    """
    spark = df.sparkSession
    if slim:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _written[max(0, len(_written) - 1 - int(keep))].append(path)
    was = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # nothing but this query reads its shuffles
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    files, folder = _path(spark, path)
    if not any(f.getPath().getName().startswith("part-") for f in files.listStatus(folder)):  # even a table without rows has one
        raise RuntimeError(f"the driver can't see what the executors wrote to {path}: spark.checkpoint.dir isn't shared")
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        files, folder = _path(spark, paths.pop())
        files.delete(folder, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end the tables go that ``cut`` wrote in it, but for those to keep, which are the outer scope's then."""
    _written.append([])
    try:
        yield
    finally:
        _delete(spark, _written.pop())


def release(spark: SparkSession) -> None:
    """Deletes the tables that ``cut`` wrote and no scope deleted; results not yet computed can't be read afterwards."""
    _delete(spark, _written[0])


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task function, which gives its memory back to the machine when it ends; workers live on."""

    def run_and_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return run_and_trim


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with one row per key in ``groups``; null keys are equal.

    Both sides are to be plain tables (``cut``) or narrow over such: then each is one shuffle that goes into the join and
    nothing else, which is what lets Spark split a partition that a hot key has made large and read its group for each
    part (adaptive skew join), or broadcast ``groups`` where they measure below Spark's own threshold.
    """
    added = [c for c in groups.columns if c not in keys]
    on = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys])
    return rows.alias("r").join(groups.alias("g"), on).select("r.*", *[f"g.{c}" for c in added])


#: A filter that is broadcast has at most so many words of 64 bits: 2^27 bits, 32 MB as rows.
MAX_WORDS = 1 << 21
BITS_A_KEY = 16


def filter_words(keys: int) -> int:
    """The words of a filter over so many keys: a power of two, BITS_A_KEY bits for each or more, whatever their number."""
    return 1 << max(0, math.ceil(math.log2(max(1, keys) * BITS_A_KEY / 64)))


def filter_mask(h: Column) -> Column:
    """The bits of a hash in its word: three, each by a hash of its own."""
    bits = F.xxhash64(h, F.lit(1))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(3)])


def bloom(keys: DataFrame, h: Column, words: int) -> DataFrame:
    """(word, mask): a blocked Bloom filter of 64-bit hashes. Tasks combine the masks of a word before they are shuffled."""
    return keys.select(F.pmod(h, F.lit(words)).alias("word"), filter_mask(h).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("mask"))


def maybe_in(rows: DataFrame, h: Column, keys: DataFrame, key_h: Column) -> DataFrame:
    """The rows whose 64-bit hash ``h`` may be one of the hashes of ``keys`` (a written table), and few others.

    The filter grows with the keys and is broadcast up to MAX_WORDS. Beyond, rows come back as they are: an exact join by the
    same key follows wherever this is used, and it alone does the work then.
    """
    words = filter_words(keys.count())
    if words > MAX_WORDS:
        return rows
    marks = F.broadcast(bloom(keys, key_h, words).withColumnsRenamed({"word": "_word", "mask": "_mask"}))
    met = rows.withColumns({"_word": F.pmod(h, F.lit(words)), "_bits": filter_mask(h)}).join(marks, "_word")
    return met.where(F.col("_mask").bitwiseAND(F.col("_bits")) == F.col("_bits")).select(*rows.columns)


def parted(rows: DataFrame, h: Column, keys: DataFrame, key_h: Column) -> tuple[DataFrame, DataFrame]:
    """The rows whose 64-bit hash ``h`` may be one of the hashes of ``keys`` (a written table), and those that surely have another.

    A filter that is broadcast tells them apart; where there are too many keys for that, all rows may be of the first kind.
    """
    words = filter_words(keys.count())
    if words > MAX_WORDS:
        return rows, rows.where(F.lit(False))
    w, b, m = free_names(rows, "word", "bits", "mask")
    own = [F.col(f"`{c}`") for c in rows.columns]
    marks = F.broadcast(bloom(keys, key_h, words).withColumnsRenamed({"word": w, "mask": m}))
    tested = rows.withColumns({w: F.pmod(h, F.lit(words)), b: filter_mask(h)}).join(marks, w, "left")
    maybe = F.coalesce(F.col(m).bitwiseAND(F.col(b)) == F.col(b), F.lit(False))
    return tested.where(maybe).select(*own), tested.where(~maybe).select(*own)


def without(rows: DataFrame, key: Column, gone: DataFrame, name: str) -> DataFrame:
    """The rows whose ``key`` is not in the column ``name`` of ``gone`` (a written table); those with a null key stay. Only rows
    that may be gone are shuffled."""
    (k,) = free_names(rows, "key")
    maybe, rest = parted(rows.withColumn(k, key), F.xxhash64(key), gone, F.xxhash64(name))
    return maybe.join(gone.select(F.col(name).alias(k)), k, "left_anti").unionByName(rest).select(*[F.col(f"`{c}`") for c in rows.columns])
