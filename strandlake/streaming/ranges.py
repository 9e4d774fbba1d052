"""Sequence files as a stream of byte ranges: large files are read by many tasks, and growing ones from where they were left.

The offset of the stream says, for each file, up to where its records have been read. Files that appear whole (moved into the
folder) are read once, by byte ranges of theirs or, if compressed, of their blocks or frames. Files that are being written
(option `growing`) are read up to the end of their last whole record, which is looked for in their last bytes; once such a file
has been left alone for `idleSeconds`, its last record counts as whole. What a batch reads is fixed by its two offsets, so a batch
that is run again after a failure or a restart gives the same rows.

Offsets list the files in the folder: move away what is done with. Files must only ever grow.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSourceStreamReader
from pyspark.sql.types import StructType

from ..sources.codecs import compression_format, list_inputs, modified_at, open_input
from ..sources.fastx import SPLIT_BYTES, Bundle, FastxDataSource, FastxReader, FilePart, bundled, requested_schema
from ..sources.grammar import FastqScanner, find_record_start, format_of, is_crlf

TAIL = 1 << 20


def whole_records_end(file, size: int, done: int, tail: int = TAIL) -> int:
    """Where the last line feed before `size` stands that ends a whole record (for FASTA: that another follows), or `done`.

    Looks at the last bytes only, at more of them if they hold no record start.
    """
    file.seek(0)
    head = file.read(1 << 16)[:size]
    if b"\n" not in head:
        return done
    kind, crlf = format_of(head[0]), is_crlf(head)
    while True:
        start = max(done, size - tail)
        file.seek(start)
        data = file.read(size - start)
        if kind == "fasta":
            at = data.rfind(b"\n>")
            if at >= 0:
                return start + at
        else:
            first = 0 if start == 0 else find_record_start(kind, data, 0, crlf, final=False)
            if first is not None:
                records = FastqScanner(start + first, crlf, start + first == 0, True).feed(data[first:])
                if len(records):
                    return int(records.ends[-1]) - 1
        if start == done:
            return done
        tail *= 4


class FastxStreamReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.batch = FastxReader(schema, options)
        self.batch.whole_files = False
        if "record_index" in schema.names:
            raise ValueError("a stream of ranges has no record_index")
        self.growing = options.get("growing", "false").lower() == "true"
        self.idle = float(options.get("idleseconds", options.get("idleSeconds", 60)))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(32) as pool:
            ends = pool.map(lambda f: self.end_of(*f), list_inputs(self.batch.paths))
            return {"files": {path: end for path, end in ends if end}}

    def end_of(self, path: str, size: int) -> tuple[str, int]:
        """Up to where a file can be read now: the line feed behind its last record, or its end."""
        if size == 0:
            return path, 0
        with open_input(path) as file:
            head = file.read(18)
            if self.growing and time.time() - modified_at(path) < self.idle:
                return path, 0 if compression_format(head) else whole_records_end(file, size, 0)
            if compression_format(head):
                return path, size
            file.seek(size - 1)
            return path, size - (file.read(1) == b"\n") or size

    def partitions(self, start: dict, end: dict) -> list[FilePart | Bundle]:
        done = start["files"]
        new = [(path, upto) for path, upto in end["files"].items() if upto > done.get(path, 0) and (self.growing or path not in done)]
        with ThreadPoolExecutor(32) as pool:
            found = [part for parts in pool.map(lambda f: self.parts_of(f[0], done.get(f[0], 0), f[1]), new) for part in parts]
        tasks = bundled(found, self.batch.split, self.batch.parallelism) if self.batch.parallelism else found
        return tasks or [FilePart("", 0, 0, 0, None, "whole", None, False)]

    def parts_of(self, path: str, begin: int, upto: int) -> list[FilePart]:
        with open_input(path) as file:
            head = file.read(1 << 16)
        if compression_format(head):
            return [] if begin else self.batch.parts_of(path, upto)
        crlf = is_crlf(head)
        step = max(self.batch.split, 1)
        cuts = [*range(begin, upto, step), upto]
        size = upto + 1  # the line feed itself; a task reads no further
        if not head or head[:1] not in (b">", b"@") or b"\n" not in head:
            return [FilePart(path, size, 0, size, None, "whole", None, False)]
        kind = format_of(head[0])
        return [FilePart(path, size, a, b, None, "bytes", kind, crlf) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: FilePart | Bundle) -> Iterator[pa.RecordBatch]:
        return self.batch.read(partition)


class FastxStreamSource(FastxDataSource):
    """spark.readStream.format("fastx_stream").option("paths", folder).option("splitBytes", n).option("growing", "true")"""

    @classmethod
    def name(cls) -> str:
        return "fastx_stream"

    def streamReader(self, schema: StructType) -> FastxStreamReader:
        return FastxStreamReader(schema, dict(self.options))


def stream_ranges(spark: SparkSession, paths: str, *, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES, growing: bool = False, idle_seconds: float = 60, mode: str = "FAILFAST", binary: bool = False) -> DataFrame:
    """The records of the files in a folder, a streaming DataFrame with the columns of read_fastx but record_index."""
    spark.dataSource.register(FastxStreamSource)
    reader = spark.readStream.format("fastx_stream").schema(requested_schema(columns, binary))
    options = {"paths": paths, "splitBytes": split_bytes, "growing": str(growing).lower(), "idleSeconds": idle_seconds, "mode": mode, "parallelism": spark.sparkContext.defaultParallelism}
    return reader.options(**options).load()
