"""Results at the edge: floats, Arrow arrays, shared memory. Each collects, so each is for results that fit a process."""

from __future__ import annotations

from multiprocessing import shared_memory

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "result"


def as_float32(df: DataFrame) -> DataFrame:
    """The first column as single precision, named result."""
    return df.select(F.col(f"`{df.columns[0]}`").cast("float").alias(RESULT))


def to_floats(df: DataFrame) -> list[float]:
    return as_float32(df).toArrow().column(0).to_pylist()


def to_arrow(df: DataFrame) -> pa.Array:
    """One float32 array."""
    column = as_float32(df).toArrow().column(0).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column if isinstance(column, pa.Array) else pa.array([], pa.float32())


class SharedResult:
    """A result as an Arrow IPC stream in POSIX shared memory, for another process to map by name."""

    def __init__(self, df: DataFrame, name: str | None = None) -> None:
        table = as_float32(df).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        data = sink.getvalue()
        self.memory = shared_memory.SharedMemory(name=name, create=True, size=max(1, data.size))
        self.memory.buf[: data.size] = data.to_pybytes()
        self.size = data.size

    @property
    def name(self) -> str:
        return self.memory.name

    @staticmethod
    def read(name: str) -> pa.Table:
        memory = shared_memory.SharedMemory(name=name)
        try:
            return pa.ipc.open_stream(pa.py_buffer(bytes(memory.buf))).read_all()
        finally:
            memory.close()

    def release(self) -> None:
        self.memory.close()
        self.memory.unlink()

    def __enter__(self) -> SharedResult:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()
