"""Expression queries over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tesseral.engine import project
from tesseral.sources.files import Schema, csv_options, csv_schema


def csv_stream(spark: SparkSession, folder: str, expr: str, sample: str, schema: Schema = None, files_per_batch: int = 1) -> DataFrame:
    """``expr [WHERE cond]`` over the CSV files of a folder, a batch of files at a time. ``sample``: a file whose header names the columns."""
    kinds = csv_schema(spark, sample, schema)
    source = spark.readStream.schema(kinds).options(**csv_options(kinds), maxFilesPerTrigger=files_per_batch)
    return project(source.csv(folder), expr)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now as Parquet, exactly once however often it is called, and ends."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
