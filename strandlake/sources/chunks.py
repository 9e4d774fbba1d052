"""Files of one compressed stream, read by many tasks.

A gzip, bzip2, xz or single-frame zstd stream can only be decoded from its beginning. Decoding is cheap beside parsing, though:
one task decodes a file and cuts it before records into chunks of a given size, each with its ordinal, its offset and the
number of records before it; a shuffle deals the chunks evenly; and their records are parsed wherever they come to lie, with
offsets and numbers as in a scan of the whole file. The decoding task holds one chunk, one decoded piece and, if that is longer,
one record.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from ..errors import FastxError
from ..options import FastxOptions
from .codecs import compression_format, decoded_pieces, list_inputs, open_input
from .fastx import ERROR_TYPE, SPLIT_BYTES, FastxReader, FilePart, error_batch, read_fastx, record_batch, requested_schema
from .grammar import format_of, is_crlf, scanner

CHUNK_BYTES = 8 << 20

CHUNKS = "file string, ordinal int, byte_start long, first_record long, format string, crlf boolean, content binary, error struct<kind: string, byte: int, pos: long, message: string>"


@dataclass
class Chunk:
    """Whole records of an input: where they start, how many records are before them, and their bytes."""

    byte_start: int
    first_record: int
    content: bytes


class RecordCutter:
    """Takes an input in pieces of any size and finds, looking at each byte once, where its records end."""

    def __init__(self, format_: str, crlf: bool):
        self.format, self.crlf = format_, crlf
        self.held: list[bytes] = []
        self.size = self.base = 0  # of what is held: its length and offset
        self.cut = self.records = 0  # up to there whole records have come in, so many
        self.given = 0  # records in chunks before
        self.last = b""
        self.phase, self.line_start, self.line_head, self.blank, self.stopped = 0, 0, b"", False, False

    def feed(self, piece: bytes) -> None:
        if not piece or self.stopped:
            self.held.append(piece)
            self.size += len(piece)
            return
        at = self.base + self.size
        self.held.append(piece)
        self.size += len(piece)
        (self.fasta if self.format == "fasta" else self.fastq)(piece, at)
        self.last = piece[-1:]

    def fasta(self, piece: bytes, at: int) -> None:
        n = piece.count(b"\n>")
        if n:
            self.cut = at + piece.rfind(b"\n>") + 1
        if self.last == b"\n" and piece[:1] == b">":
            n += 1
            self.cut = max(self.cut, at)
        self.records += n

    def fastq(self, piece: bytes, at: int) -> None:
        """Counts lines in fours; only blank lines where a header is due, and what follows them, are looked at one by one."""
        feeds = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)
        if self.line_start == at:
            self.line_head = piece[:1]
        starts = np.concatenate([[self.line_start], at + feeds + 1])
        lengths = at + feeds - starts[:-1]
        i = 0
        while i < len(feeds) and not self.stopped:
            headers = np.arange(i + (-self.phase) % 4, len(feeds), 4)
            short = headers[lengths[headers] <= (1 if self.crlf else 0)]
            odd = next((int(h) for h in short if lengths[h] == 0 or self.head_of(piece, starts, h, at) == b"\r"), len(feeds))
            if self.blank and len(headers) and headers[0] == i and odd != i:
                self.stopped = self.head_of(piece, starts, i, at) != b"@"  # the scan of the rest will say so
                self.blank = False
                if self.stopped:
                    break
            whole = np.arange(i + (3 - self.phase) % 4, odd, 4)
            if len(whole):
                self.cut, self.records = int(starts[whole[-1] + 1]), self.records + len(whole)
            self.phase = 0 if odd < len(feeds) else (self.phase + len(feeds) - i) % 4
            self.blank = self.blank or odd < len(feeds)
            i = odd + 1
        self.line_start = int(starts[-1])
        if self.line_start < at + len(piece) and len(feeds):
            self.line_head = piece[feeds[-1] + 1 : feeds[-1] + 2]

    def head_of(self, piece: bytes, starts: np.ndarray, i: int, at: int) -> bytes:
        """The first byte of line i, which may have begun in an earlier piece."""
        begin = int(starts[i]) - at
        return piece[begin : begin + 1] if begin >= 0 else self.line_head

    def take(self, upto: int | None = None) -> Chunk:
        """What is held up to the end of its last whole record, or up to an offset."""
        whole = b"".join(self.held)
        n = (self.cut if upto is None else upto) - self.base
        chunk = Chunk(self.base, self.given, whole[:n])
        self.held, self.size, self.base, self.given = [whole[n:]], len(whole) - n, self.base + n, self.records
        return chunk


def chunks_of(pieces: Iterator[bytes], chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[str, bool, Chunk]]:
    """(format, crlf, chunk) of an input that comes in pieces. Each chunk but the last ends with a record; a chunk is at most
    twice chunk_bytes long, and a record. If the pieces end in an error, the whole records before it come first."""
    head, cutter = b"", None
    try:
        for piece in pieces:
            if cutter is None:
                head += piece
                if b"\n" not in head:
                    continue
                cutter, piece = RecordCutter(format_of(head[0]), is_crlf(head)), head
            for at in range(0, len(piece), chunk_bytes):
                cutter.feed(piece[at : at + chunk_bytes])
                if cutter.size >= chunk_bytes and cutter.cut > cutter.base:
                    yield cutter.format, cutter.crlf, cutter.take()
            if cutter.stopped:
                break
    except FastxError:
        if cutter is not None and cutter.cut > cutter.base:
            yield cutter.format, cutter.crlf, cutter.take()
        raise
    if cutter is None and head:
        cutter = RecordCutter(format_of(head[0]), False)
        cutter.feed(head)
    if cutter is not None and cutter.size:
        yield cutter.format, cutter.crlf, cutter.take(cutter.base + cutter.size)


class ChunkReader(DataSourceReader):
    """One task a file, a row for each of its chunks."""

    def __init__(self, options: dict):
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.chunk_bytes = int(options.get("chunkbytes", options.get("chunkBytes", CHUNK_BYTES)))

    def partitions(self) -> list[FilePart]:
        parts = [FilePart(path, size, 0, size, None, "whole", None, False) for path, size in list_inputs(self.paths)]
        return parts or [FilePart("", 0, 0, 0, None, "whole", None, False)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        ordinal = 0
        try:
            with open_input(partition.path) as file:
                codec = compression_format(file.read(18))
                file.seek(0)
                for format_, crlf, chunk in chunks_of(decoded_pieces(file, codec, 1 << 20), self.chunk_bytes):
                    yield chunk_row(partition.path, ordinal, chunk.byte_start, chunk.first_record, format_, crlf, chunk.content, None)
                    ordinal += 1
        except FastxError as error:
            if not self.permissive:
                raise
            yield chunk_row(partition.path, ordinal, None, None, None, None, None, error.row())


def chunk_row(*values) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), ERROR_TYPE]
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["file", "ordinal", "byte_start", "first_record", "format", "crlf", "content", "error"])


class ChunkSource(DataSource):
    """spark.read.format("fastx_chunks").option("chunkBytes", n).option("paths", ...)"""

    @classmethod
    def name(cls) -> str:
        return "fastx_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(dict(self.options))


def _parse_chunks(schema: StructType, permissive: bool):
    with_seqs = bool({"seq", "quality", "dna_len"} & set(schema.names))

    def failed(path: str, error: FastxError, format_: str, index: int) -> Iterator[pa.RecordBatch]:
        good = getattr(error, "records", None)
        if good is not None and len(good):
            yield record_batch(schema, good, format_, path, index)
        if "error" in schema.names:
            yield error_batch(schema, error, path)

    def parse(path: str, ordinal: int, start: int, index: int, format_: str, crlf: bool, content: bytes) -> Iterator[pa.RecordBatch]:
        scan = scanner(format_, start, crlf, ordinal == 0, with_seqs)
        try:
            for step in (lambda: scan.feed(content), scan.finish):
                records = step()
                if len(records):
                    yield record_batch(schema, records, format_, path, index)
                    index += len(records)
        except FastxError as error:
            if not permissive:
                raise
            yield from failed(path, error, format_, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                *values, error = (batch.column(i)[r].as_py() for i in range(8))
                if error is None:
                    yield from parse(*values)
                elif "error" in schema.names:
                    row = {"file": values[0], "error": error}
                    empty = error_batch(schema, FastxError(error["message"]), values[0])
                    yield pa.RecordBatch.from_arrays([pa.array([row[n]], c.type) if n in row else c for n, c in zip(schema.names, empty.columns, strict=True)], names=schema.names)

    return run


def read_chunked(spark: SparkSession, paths: str | list[str], *, columns: list[str] | None = None, options: FastxOptions | None = None, mode: str = "FAILFAST", chunk_bytes: int = CHUNK_BYTES, parts: int | None = None, binary: bool = False) -> DataFrame:
    """The records of files in any compression, each decoded by one task and parsed by up to `parts` (by default the
    session's shuffle partitions), with the columns of read_fastx; record_index is that in the file."""
    from ..operators.project import apply_options, source_columns

    spark.dataSource.register(ChunkSource)
    schema = requested_schema(columns or (source_columns(options) if options else None), binary)
    joined = paths if isinstance(paths, str) else "\n".join(paths)
    chunks = spark.read.format("fastx_chunks").option("paths", joined).option("mode", mode).option("chunkBytes", chunk_bytes).load()
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartitionById(n, F.pmod(F.hash("file") + F.col("ordinal"), F.lit(n)))
    out = dealt.mapInArrow(_parse_chunks(schema, mode.upper() == "PERMISSIVE"), schema)
    return apply_options(out, options) if options else out


def read_parallel(spark: SparkSession, paths: str | list[str], *, columns: list[str] | None = None, mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES, chunk_bytes: int = CHUNK_BYTES, binary: bool = False) -> DataFrame:
    """The records of files of all kinds, each in the way that gives it the most tasks: files that can be cut by ranges of
    theirs, larger ones of one stream by chunks, the rest whole."""
    reader = FastxReader(StructType([]), {"paths": paths if isinstance(paths, str) else "\n".join(paths), "splitbytes": split_bytes})
    whole = {p.path for p in reader.partitions() if p.cut_by == "whole" and p.codec and p.size > split_bytes}
    ranged = [path for path, _ in list_inputs(reader.paths) if path not in whole]
    found = []
    if ranged or not whole:
        found.append(read_fastx(spark, ranged, columns=columns, mode=mode, split_bytes=split_bytes, binary=binary))
    if whole:
        found.append(read_chunked(spark, sorted(whole), columns=columns, mode=mode, chunk_bytes=chunk_bytes, binary=binary))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
