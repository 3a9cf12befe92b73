"""Runs a query: ``python -m tesseral "<expr> [WHERE cond] | SELECT ..." [file]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import QueryError


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tesseral", description="Runs an expression query or a SELECT statement over a table.")
    out.add_argument("query")
    out.add_argument("file", nargs="?", default="data/test.csv", help="CSV, JSON lines, Parquet, ORC or Arrow IPC; the table is named after it")
    out.add_argument("--schema", help="column types of a CSV or JSON file in order, such as float64,int32,string")
    out.add_argument("--table", action="append", default=[], metavar="NAME=FILE", help="another table for statements")
    out.add_argument("--partitions", type=int, help="deals the table to so many tasks; for expressions")
    out.add_argument("--rows-per-chunk", type=int, help="reads a CSV file larger than memory; for expressions")
    out.add_argument("--output", metavar="FOLDER", help="writes the result as Parquet instead of printing its first rows")
    return out


def main(args: list[str]) -> int:
    parser = arguments()
    try:
        given = parser.parse_intermixed_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.appName("tesseral").getOrCreate()
    schema = given.schema.split(",") if given.schema else None
    try:
        if given.rows_per_chunk is not None:
            df = Engine.query_csv_chunked(spark, given.file, given.query, given.rows_per_chunk, schema)
        else:
            engine = Engine(spark, given.file, schema)
            for name, _, path in (x.partition("=") for x in given.table):
                engine.register_table(name, path)
            if given.query.lstrip()[:6].upper() == "SELECT":
                df = engine.query_sql(given.query)
            else:
                df = engine.query(given.query) if given.partitions is None else engine.query_partitioned(given.query, given.partitions)
        df.write.parquet(given.output) if given.output else df.show(truncate=False)
    except QueryError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
