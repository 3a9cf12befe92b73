"""Tables from files, chosen by extension. Reading is lazy; pruning and pushdown are Spark's."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from tesseral.errors import QueryError

from .arrow_ipc import ArrowIpcSource

#: Names of column types that callers may give, beside Spark's own types.
TYPES: dict[str, DataType] = {"int32": IntegerType(), "int64": LongType(), "float32": FloatType(), "float64": DoubleType(), "string": StringType()}

#: Column types in order, or names and types.
Schema = Sequence[str | DataType] | StructType | str | None


def as_type(kind: str | DataType) -> DataType:
    if isinstance(kind, DataType):
        return kind
    if kind.lower() not in TYPES:
        raise QueryError(f"Unknown column type: {kind}")
    return TYPES[kind.lower()]


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The names in a CSV file's first line, which is all that is read."""
    try:
        names = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).columns
    except Exception as e:
        raise QueryError(f"Unable to open file: {path}") from e
    if not names:
        raise QueryError(f"Empty CSV file: {path}")
    return [x.lstrip("\ufeff").strip() for x in names]


def typed(names: list[str], types: Schema, default: DataType | None = None) -> StructType:
    """The caller's types in the order of the names; a StructType or a DDL string stands as it is."""
    if isinstance(types, StructType):
        return types
    if isinstance(types, str):
        return StructType.fromDDL(types)
    if types and len(types) != len(names):
        raise QueryError(f"Schema size does not match column count: {len(types)} and {len(names)}")
    kinds = [as_type(t) for t in types] if types else [default or DoubleType()] * len(names)
    return StructType([StructField(n, t) for n, t in zip(names, kinds)])


def csv_schema(spark: SparkSession, path: str, types: Schema) -> StructType:
    """Names from the header; the caller's types in order, or doubles."""
    names = csv_header(spark, path)
    schema = typed(names, types)
    if len(schema) != len(names):
        raise QueryError(f"Schema size does not match column count: {len(schema)} and {len(names)}")
    return schema


def csv_options(schema: StructType) -> dict[str, object]:
    """A bad, missing or surplus cell fails the query; blanks around a cell count only where there are columns of text."""
    trim = not any(isinstance(f.dataType, StringType) for f in schema)
    return {"header": True, "mode": "FAILFAST", "ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim}


def read_csv(spark: SparkSession, path: str, types: Schema = None, infer: bool = False) -> DataFrame:
    """A CSV table with a header; a row with a bad, missing or surplus cell fails the query."""
    if infer:
        return spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST")
    schema = csv_schema(spark, path, types)
    return spark.read.options(**csv_options(schema)).schema(schema).csv(path)


#: The columns of a JSON file for which the caller names no types.
JSON_COLUMNS = "price double, quantity int"


def json_names(spark: SparkSession, path: str) -> list[str]:
    """The keys of the first line that is a JSON object, in their order; only lines up to that one are read."""
    found = spark.read.text(path).select(F.json_object_keys("value").alias("keys")).where("keys is not null").first()
    return list(found.keys) if found else []


def read_json(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """JSON lines; a line that lacks a column, or that is no JSON, is skipped.

    ``schema``: column types in the order of the first object's keys, or names and types (a StructType or DDL). Without it the
    columns are JSON_COLUMNS if the first object has them, else all that Spark infers, which takes a scan. A file that has
    objects, but none with all columns, is an error; one without any is an empty table.
    """
    try:
        names = json_names(spark, path)
    except Exception as e:
        raise QueryError(f"Unable to open file: {path}") from e
    usual = StructType.fromDDL(JSON_COLUMNS)
    if schema is None and names and not {f.name for f in usual} <= set(names):
        own = spark.read.json(path)
        wanted = own.select(*[f"`{c}`" for c in names if c in own.columns], *[f"`{c}`" for c in own.columns if c not in names and c != "_corrupt_record"]).schema
    else:
        wanted = usual if schema is None else typed(names, schema) if names or isinstance(schema, str | StructType) else typed([f"c{k}" for k in range(len(schema))], schema)
    df = spark.read.schema(wanted).json(path)
    whole = df.na.drop(subset=df.columns)
    if names and whole.isEmpty():
        raise QueryError(f"No line of {path} has the columns {', '.join(df.columns)}")
    return whole


def read_arrow(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Arrow IPC, a file or a folder of such, a task for each record batch; ``columns``: those to read."""
    spark.dataSource.register(ArrowIpcSource)
    reader = spark.read.format(ArrowIpcSource.name())
    return (reader if columns is None else reader.option("columns", json.dumps(list(columns)))).load(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """Arrow IPC files in a folder, one from each task that has rows."""
    df.sparkSession.dataSource.register(ArrowIpcSource)
    df.write.format(ArrowIpcSource.name()).mode("append").save(path)


def extension(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower().lstrip(".")


def prunes(path: str) -> bool:
    """Whether Spark itself reads only the columns that a query needs."""
    return extension(path) not in ("arrow", "feather")


def open_table(spark: SparkSession, path: str, schema: Schema = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The table in a file or folder. ``schema``: the column types of a CSV or JSON file, in order. ``columns``: those to read, of Arrow IPC."""
    kind = extension(path)
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, schema)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind in ("arrow", "feather"):
        return read_arrow(spark, path, columns)
    raise QueryError(f"Unsupported file format: {path}")
