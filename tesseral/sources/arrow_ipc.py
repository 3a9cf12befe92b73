"""A Spark data source for Arrow IPC (Feather) files: a task for each record batch read, a file from each task that writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType


def resolved(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, of any kind that Arrow knows, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def files(path: str) -> list[str]:
    """The file at a path, or the files of a folder, without those that a writer has not committed."""
    fs, inner = resolved(path)
    if fs.get_file_info(inner).type != pyarrow.fs.FileType.Directory:
        return [inner]
    found = fs.get_file_info(pyarrow.fs.FileSelector(inner))
    return sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.base_name[0] not in "._")


def opened(path: str, inner: str, columns: list[str] | None = None) -> pa.ipc.RecordBatchFileReader:
    fs, _ = resolved(path)
    open_file = lambda: fs.open_input_file(inner)
    if columns is None:
        return pa.ipc.open_file(open_file())
    names = pa.ipc.open_file(open_file()).schema.names
    return pa.ipc.open_file(open_file(), options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns]))


@dataclass
class Batch(InputPartition):
    inner: str
    number: int


class ArrowIpcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str] | None) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> list[Batch]:
        return [Batch(f, k) for f in files(self.path) for k in range(opened(self.path, f).num_record_batches)]

    def read(self, partition: Batch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for when there are no partitions
            return
        batch = opened(self.path, partition.inner, self.columns).get_batch(partition.number)
        yield batch if self.columns is None else batch.select(self.columns)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ArrowIpcWriter(DataSourceArrowWriter):
    """Tasks write under a folder of the job's own; the files move to their places when all are done."""

    def __init__(self, path: str, schema: pa.Schema, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    @property
    def pending(self) -> str:
        return f"{resolved(self.path)[1].rstrip('/')}/_pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = resolved(self.path)
        name, sink = None, None
        for batch in iterator:
            if sink is None:
                fs.create_dir(self.pending, recursive=True)
                name = f"part-{uuid.uuid4().hex}.arrow"
                stream = fs.open_output_stream(f"{self.pending}/{name}")
                sink = pa.ipc.new_file(stream, self.schema)
            sink.write_batch(batch.cast(self.schema))
        if sink is not None:
            sink.close()
            stream.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = resolved(self.path)
        fs.create_dir(inner, recursive=True)
        old = files(self.path) if self.overwrite else []
        names = [m.name for m in messages if m and m.name]
        if not names:  # a table without rows still has columns
            fs.create_dir(self.pending, recursive=True)
            names = ["part-empty.arrow"]
            with fs.open_output_stream(f"{self.pending}/{names[0]}") as stream, pa.ipc.new_file(stream, self.schema):
                pass
        for f in old:
            fs.delete_file(f)
        for name in names:
            fs.move(f"{self.pending}/{name}", f"{inner.rstrip('/')}/{name}")
        fs.delete_dir(self.pending)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = resolved(self.path)
        if fs.get_file_info(self.pending).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(self.pending)


class ArrowIpcSource(DataSource):
    """``path``: a file or a folder of files with one schema. ``columns``: a JSON list of those to read."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _columns(self) -> list[str] | None:
        return json.loads(self.options["columns"]) if "columns" in self.options else None

    def schema(self) -> StructType:
        path, columns = self.options["path"], self._columns()
        whole = from_arrow_schema(opened(path, files(path)[0]).schema)
        return whole if columns is None else StructType([whole[c] for c in columns])

    def reader(self, schema: StructType) -> ArrowIpcReader:
        return ArrowIpcReader(self.options["path"], self._columns())

    def writer(self, schema: StructType, overwrite: bool) -> ArrowIpcWriter:
        return ArrowIpcWriter(self.options["path"], to_arrow_schema(schema), overwrite)
