"""The engine: one table from a file, others beside it, and queries over them as lazy DataFrames."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .errors import QueryError
from .functions.registry import register_functions
from .operators import results
from .plans.dialect import Piece, quoted, read_query, read_select, whole_table
from .plans.stats import ColumnStats, classify_filter, column_stats
from .sources.files import Schema, open_table, prunes, read_csv


def _check(columns: Iterable[str], known: set[str], clause: str = "") -> None:
    for name in columns:
        if name.lower() not in known:
            raise QueryError(f"{clause}: Unknown column: {name}" if clause else f"Unknown column: {name}")


def _names(df: DataFrame, table: str | None = None) -> set[str]:
    own = {c.lower() for c in df.columns}
    return own | {f"{table.lower()}.{c}" for c in own} if table else own


def project(df: DataFrame, expr: str, mask: bool = False, ieee_division: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """``expr [WHERE cond]`` over a table, as the column result; with ``mask`` rows that fail keep their place as nulls.

    ``keys`` are columns that stand beside the result.
    """
    value, cond = read_query(expr, ieee_division)
    _check(value.columns, _names(df))
    if cond is not None:
        try:
            _check(cond.columns, _names(df))
        except QueryError as e:
            raise QueryError(f"Failed to parse WHERE clause: {e}") from e
    test = None if cond is None else F.expr(_condition(df, cond))
    if test is not None and not mask:
        df, test = df.where(test), None
    text, whole = whole_table(value.output)
    if whole:
        # one row of aggregates, not a window that brings all rows to one task
        df = df.crossJoin(F.broadcast(df.agg(*[F.expr(x).alias(f"whole{k}") for k, x in enumerate(whole)])))
    out = F.expr(text)
    if isinstance(df.select(out).schema[0].dataType, BooleanType):
        out = out.cast("int").cast("double")
    return df.select(*keys, (out if test is None else F.when(test, out)).alias(results.RESULT))


def _condition(df: DataFrame, cond: Piece) -> str:
    """A condition; a boolean column or function is one as it is, a number is one where it isn't zero."""
    return cond.sql if cond.boolean or isinstance(df.select(F.expr(cond.sql)).schema[0].dataType, BooleanType) else cond.condition


def table_name(path: str) -> str:
    """The name of the table in a file: its stem, with an underscore for what no name in a query can have."""
    name = re.sub(r"[^A-Za-z0-9_.]", "_", PurePosixPath(path.rstrip("/")).stem)
    return name if re.match("[A-Za-z_]", name) else f"_{name}"


class Engine:
    """Queries over the table in ``path`` (named by ``table_name``) and over tables registered later.

    Tables belong to the engine: others of the same session may have tables of the same names.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, schema: Schema = None, functions: str | None = None, ieee_division: bool = True) -> None:
        self.spark, self.ieee_division = spark, ieee_division
        self.tables: dict[str, DataFrame] = {}
        self.df: DataFrame | None = None
        self._first = ""
        self._files: dict[str, tuple[str, Schema]] = {}
        self._stats: dict[str, ColumnStats] | None = None
        register_functions(spark, functions)
        if path is not None:
            self.register_table(table_name(path), path, schema)

    def register_table(self, name: str, table: str | DataFrame, schema: Schema = None) -> DataFrame:
        """Makes a file or a DataFrame known to ``query_sql`` under a name."""
        key = name.lower()
        df = open_table(self.spark, table, schema) if isinstance(table, str) else table
        self._files.pop(key, None)
        if isinstance(table, str) and not prunes(table):
            self._files[key] = (table, schema)
        self.tables[key] = df
        if self.df is None:
            self.df, self._first = df, key
        return df

    def _own(self) -> DataFrame:
        if self.df is None:
            raise QueryError("No table is open")
        return self.df

    def _with(self, name: str, columns: Iterable[str]) -> DataFrame:
        """A table with the asked columns at least: of a source that can't prune by itself they alone are read."""
        df = self.tables[name]
        asked = {c.rsplit(".", 1)[-1].lower() for c in columns}
        wanted = [c for c in df.columns if c.lower() in asked]
        if name not in self._files or len(wanted) in (0, len(df.columns)):
            return df
        path, schema = self._files[name]
        return open_table(self.spark, path, schema, wanted)

    def query(self, expr: str, mask: bool = False, keys: Sequence[str] = ()) -> DataFrame:
        """``expr [WHERE cond]``: the column result, beside columns that ``keys`` names."""
        own = self._own()
        if self._first in self._files:
            value, cond = read_query(expr, self.ieee_division)
            _check(value.columns, _names(own))
            own = self._with(self._first, [*keys, *value.columns, *(cond.columns if cond else ())])
        return project(own, expr, mask, self.ieee_division, keys)

    def query_sql(self, sql: str) -> DataFrame:
        """A SELECT statement of the dialect over the registered tables."""
        parts = read_select(sql, self.ieee_division)
        named = [(parts.table, parts.alias), *((j.table, j.alias) for j in parts.joins)]
        known: set[str] = set()
        for table, alias in named:
            if table.lower() not in self.tables:
                raise QueryError(f"Unknown table: {table}")
            known |= _names(self.tables[table.lower()], alias)
        aliases = {i.name.lower() for i in parts.items}
        for clause, piece in parts.clauses():
            _check(piece.columns, known | aliases if clause in ("ORDER BY", "HAVING") else known, clause)
        asked = [c for _, piece in parts.clauses() for c in piece.columns]
        own = {table.lower(): self._with(table.lower(), asked) for table, _ in named}
        for j in parts.joins:
            if not j.on.equal:
                self._warn_of_pairs(own, [parts.table, j.table])
        numbered = {f"t{k}": table for k, table in enumerate(own)}
        return self.spark.sql(parts.to_sql({table: f"{{{k}}}" for k, table in numbered.items()}), **{k: own[table] for k, table in numbered.items()})

    def _warn_of_pairs(self, tables: dict[str, DataFrame], names: list[str]) -> None:
        """A join without an equality compares all pairs: one side is to be small enough for Spark to broadcast."""
        most = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        sizes = [int(str(tables[n.lower()]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for n in names]
        if min(sizes) > most:
            warnings.warn(f"JOIN of {names[0]} and {names[1]} has no equality and neither is below {most} bytes: all pairs of rows are compared", stacklevel=3)

    def sql(self, text: str) -> DataFrame:
        """Any Spark SQL over the registered tables, which hide views of the same names while it is read."""
        views = {n: self.spark.table(quoted(n)) for n in self.tables if self.spark.catalog._jcatalog.tableExists(quoted(n)) and self.spark._jsparkSession.sessionState().catalog().getTempView(n).isDefined()}
        try:
            for name, df in self.tables.items():
                df.createOrReplaceTempView(quoted(name))
            return self.spark.sql(text)
        finally:
            for name in self.tables:
                self.spark.catalog.dropTempView(name)
            for name, df in views.items():
                df.createOrReplaceTempView(quoted(name))

    def query_partitioned(self, expr: str, partitions: int | None = None) -> DataFrame:
        """``query`` over all executors; Spark's own split of the input unless a number of partitions is asked for."""
        own = self._own()
        return project(own if partitions is None else own.repartition(partitions), expr, ieee_division=self.ieee_division)

    query_multi_gpu = query_partitioned

    @staticmethod
    def query_csv_chunked(spark: SparkSession, path: str, expr: str, rows_per_chunk: int = 1_000_000, schema: Schema = None) -> DataFrame:
        """``query`` over a CSV file of any size. Spark reads it in byte ranges; the chunk size doesn't alter the result."""
        if rows_per_chunk < 1:
            raise QueryError("rows_per_chunk must be positive")
        register_functions(spark)
        return project(read_csv(spark, path, schema), expr)

    query_multi_gpu_csv = query_csv_chunked

    def query_arrow(self, expr: str, shared_memory: bool = False) -> pa.Array | results.SharedResult:
        """``query`` as one float32 Arrow array, or in shared memory."""
        df = self.query(expr)
        return results.SharedResult(df) if shared_memory else results.to_arrow(df)

    def query_floats(self, expr: str) -> list[float]:
        return results.to_floats(self.query(expr))

    def stats(self) -> dict[str, ColumnStats]:
        """Statistics of the table's numeric columns; computed once."""
        if self._stats is None:
            self._stats = column_stats(self._own())
        return self._stats

    def query_optimized(self, expr: str, where: str | None = None) -> DataFrame:
        """``query`` whose condition is dropped, or its rows, where statistics settle it."""
        verdict = None if where is None else classify_filter(where, self.stats())
        if verdict is None:
            return self.query(expr if where is None else f"{expr} WHERE {where}")
        project(self._own(), f"{expr} WHERE {where}")  # a bad condition is an error whatever the statistics say
        return self.query(expr) if verdict else self.query(expr).limit(0)
