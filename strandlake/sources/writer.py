"""The writer of the data source "fastx": text of records into part files, plain, in blocks that can be split, or in one stream.

Every task attempt writes files of its own in a staging folder, and the commit moves those of the attempts that count; so a task
that ran twice leaves its records once, and a job that fails leaves nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

from .codecs import make_encoder


@dataclass
class Written(WriterCommitMessage):
    """A part file of a task attempt, if it had any records."""

    name: str | None
    records: int
    size: int


def store_of(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def lines(column: pa.Array, end: bytes) -> bytes:
    """The values of a column, each with a line end behind it, as one byte string; nulls are left out."""
    column = column.drop_null().cast(pa.large_binary())
    joined = pc.binary_join_element_wise(column, pa.scalar(end, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    return joined.buffers()[2].to_pybytes()[: sum_bytes(joined)] if len(joined) else b""


def sum_bytes(column: pa.Array) -> int:
    return pc.sum(pc.binary_length(column)).as_py() or 0


class FastxWriter(DataSourceArrowWriter):
    """Options: compression (none, bgzf, zstd, gzip, bzip2, xz), blockBytes, lineSep, extension."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if len(schema.fields) != 1 or not isinstance(schema.fields[0].dataType, StringType | BinaryType):
            raise ValueError("fastx writes one column of text, see strandlake.sources.sink.write_fastx")
        self.path = options["path"]
        self.compression = options.get("compression")
        self.block = int(options.get("blockbytes", options.get("blockBytes", 0))) or None
        self.end = options.get("linesep", options.get("lineSep", "\n")).encode()
        self.extension = options.get("extension", ".fastx")
        self.overwrite = overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        make_encoder(self.compression, self.block)  # a wrong name fails here

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.path)
        encoder = make_encoder(self.compression, self.block)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.extension}{encoder.extension}"
        out, records, size = None, 0, 0
        try:
            for batch in iterator:
                if batch.num_rows == 0:
                    continue
                if out is None:
                    store.create_dir(f"{root}/{self.staging}", recursive=True)
                    out = store.open_output_stream(f"{root}/{self.staging}/{name}", compression=None)  # by default a name with .gz is compressed once more
                data = encoder.write(lines(batch.column(0), self.end))
                out.write(data)
                records, size = records + batch.num_rows, size + len(data)
            if out is not None:
                data = encoder.finish()
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, records, size)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = store_of(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                    store.delete_file(info.path)
        for message in messages:
            if message is not None and message.name:
                store.move(f"{root}/{self.staging}/{message.name}", f"{root}/{message.name}")
        self.clear(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*store_of(self.path))

    def clear(self, store, root: str) -> None:
        """Removes the staging folder of this job, which holds nothing but files of attempts that don't count."""
        from pyarrow import fs

        folder = f"{root}/{self.staging}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)
