"""The data source "fastx": FASTA and FASTQ files, plain or compressed, as rows.

A plain file is cut into byte ranges, BGZF into ranges of blocks and multi-frame zstd into ranges of frames; each task
finds the first record that begins behind a line feed in its range and reads on to the end of the last one. Other
compressed files are read whole (see chunks.py for large ones), and small files several to a task. Only the columns of the
requested schema are built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructType, _parse_datatype_string

from ..errors import FastxError, InputError
from ..options import FastxOptions
from .codecs import BGZF_END, PIECE, compression_format, decoded_pieces, find_inputs, gzip_pieces, list_inputs, next_bgzf_block, open_input, raw_pieces, zstd_frames
from .filters import chosen, column_of, keeps_file, split_filters, wanted
from .grammar import FastqSync, Records, format_of, irregular_record_start, is_crlf, scan_pieces, scanner
from .writer import FastxWriter

SCHEMA = "file string, record_index long, format string, header string, seq string, quality string, dna_len long, byte_start long, byte_end long, error struct<kind: string, byte: int, pos: long, message: string>"

ERROR_TYPE = pa.struct([("kind", pa.string()), ("byte", pa.int32()), ("pos", pa.int64()), ("message", pa.string())])

SPLIT_BYTES = 64 << 20

#: How much of what is behind a range is read at first, to the end of its last record.
BEHIND = 1 << 12

#: The codec of a file that its task finds out.
UNKNOWN = "unknown"


@dataclass
class FilePart(InputPartition):
    """A range of a file as it is stored; cut_by says in what units: bytes, bgzf, zstd, or whole."""

    path: str
    size: int
    start: int
    end: int
    codec: str | None
    cut_by: str
    format: str | None
    crlf: bool
    #: The number of records before the range in its file, where known, and what is wrong with the file.
    first_index: int | None = None
    error: str | None = None


@dataclass
class Bundle(InputPartition):
    """Small files, or neighbouring small ranges of a file, that one task reads, one after another."""

    parts: list[FilePart]


#: What opening a file costs, in bytes read, when small files are bundled, and what a task costs when ranges are.
OPEN_COST = 4 << 20
TASK_COST = 1 << 20


def bundled(parts: list[FilePart], most: int, parallelism: int) -> list[InputPartition]:
    """Whole files put together to about `most` bytes a task, or less where that leaves tasks idle; ranges as neighbours."""
    whole = [p for p in parts if p.cut_by == "whole"]
    total = sum(p.size + OPEN_COST for p in parts)
    room = min(most, max(OPEN_COST, total // max(parallelism, 1)))
    out = neighbours([p for p in parts if p.cut_by != "whole"], parallelism)
    held, size = [], 0
    for part in whole:
        if held and size + part.size + OPEN_COST > room:
            out.append(held[0] if len(held) == 1 else Bundle(held))
            held, size = [], 0
        held.append(part)
        size += part.size + OPEN_COST
    if held:
        out.append(held[0] if len(held) == 1 else Bundle(held))
    return out


def neighbours(ranges: list[FilePart], parallelism: int) -> list[InputPartition]:
    """Small ranges put together with those that follow them in their file, each still read by itself: about four tasks for each
    that can run at once, so that the number of tasks doesn't grow with that of ranges."""
    room = min(SPLIT_BYTES, max(TASK_COST, sum(p.end - p.start for p in ranges) // (4 * max(parallelism, 1))))
    groups: list[list[FilePart]] = []
    for part in ranges:
        last = groups[-1] if groups else None
        if last and last[-1].path == part.path and last[-1].end == part.start and part.end - last[0].start <= room:
            last.append(part)
        else:
            groups.append([part])
    return [g[0] if len(g) == 1 else Bundle(g) for g in groups]


def texts(values: list[bytes] | pa.Array, binary: bool) -> pa.Array:
    """Strings of byte strings; bytes that aren't UTF-8 become replacement characters unless binary is asked for."""
    out = values.cast(pa.binary()) if isinstance(values, pa.Array) else pa.array(values, pa.binary())
    if binary:
        return out
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in out.to_pylist()], pa.string())


def record_batch(schema: StructType, records: Records, format_: str, path: str | None, first_index: int | np.ndarray | None) -> pa.RecordBatch:
    """The requested columns of some records, whose numbers are consecutive from first_index on or given one by one."""
    n, columns = len(records), []
    for field in schema.fields:
        binary = isinstance(field.dataType, BinaryType)
        if field.name == "file":
            columns.append(pa.array([path] * n, pa.string()))
        elif field.name == "record_index":
            numbers = range(first_index, first_index + n) if isinstance(first_index, int) else first_index
            columns.append(pa.nulls(n, pa.int64()) if numbers is None else pa.array(numbers, pa.int64()))
        elif field.name == "format":
            columns.append(pa.array([format_] * n, pa.string()))
        elif field.name == "header":
            columns.append(texts(records.headers, binary))
        elif field.name == "seq":
            columns.append(texts(records.seqs, binary))
        elif field.name == "quality":
            columns.append(pa.nulls(n, pa.binary() if binary else pa.string()) if records.quals is None else texts(records.quals, binary))
        elif field.name == "dna_len":
            sizes = pc.binary_length(records.seqs) if isinstance(records.seqs, pa.Array) else pa.array([len(s) for s in records.seqs])
            columns.append(sizes.cast(pa.int64()))
        elif field.name == "byte_start":
            columns.append(pa.array(records.starts, pa.int64()))
        elif field.name == "byte_end":
            columns.append(pa.array(records.ends, pa.int64()))
        elif field.name == "error":
            columns.append(pa.nulls(n, ERROR_TYPE))
        else:
            raise ValueError(f"no such column: {field.name}")
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def error_batch(schema: StructType, error: FastxError, path: str | None) -> pa.RecordBatch:
    """One row that has only the file and the error."""
    row = {"file": path, "error": error.row()}
    kinds = {"file": pa.string(), "format": pa.string(), "error": ERROR_TYPE}
    columns = []
    for field in schema.fields:
        text = pa.binary() if isinstance(field.dataType, BinaryType) else pa.string()
        kind = kinds.get(field.name, text if field.name in ("header", "seq", "quality") else pa.int64())
        columns.append(pa.array([row.get(field.name)], kind))
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


class FastxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        paths = options.get("paths") or options.get("path") or ""
        self.paths = [p for p in paths.split("\n") if p]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        # A record's number in its file is known only to a task that has read all before it, or is told (see read_numbered).
        self.bases = json.loads(options["bases"]) if "bases" in options else None
        self.whole_files = "record_index" in schema.names and self.bases is None
        self.with_seqs = bool({"seq", "quality", "dna_len"} & set(schema.names))
        self.filters: list = []
        self.parallelism = int(options.get("parallelism", 0))

    def partitions(self) -> list[InputPartition]:
        found = find_inputs(self.paths) if self.permissive else list_inputs(self.paths)
        found = [f for f in found if keeps_file(self.filters, f[0])]
        with ThreadPoolExecutor(32) as pool:  # looking into files waits for the store
            parts = [part for parts in pool.map(lambda f: self.safe_parts_of(*f), found) for part in parts]
        tasks = bundled(parts, self.split, self.parallelism) if self.parallelism else parts
        if self.bases is not None:
            for part in parts:
                part.first_index = self.bases.get(part.path, {}).get(str(part.start))
            self.bases = {}  # tasks have theirs
        return tasks or [FilePart("", 0, 0, 0, None, "whole", None, False)]

    def safe_parts_of(self, path: str, size: int | None) -> list[FilePart]:
        """A file that can't be looked into is one part with an error."""
        try:
            if size is None:
                raise FileNotFoundError(f"no such file or folder: {path}")
            return self.parts_of(path, size)
        except OSError as error:
            if not self.permissive:
                raise
            return [FilePart(path, 0, 0, 0, None, "whole", None, False, None, str(error))]

    def parts_of(self, path: str, size: int) -> list[FilePart]:
        """The ranges of a file. One that isn't cut is looked into by its task; only larger ones are opened here."""
        if self.whole_files or size <= self.split:
            return [FilePart(path, size, 0, size, UNKNOWN, "whole", None, False)]
        with open_input(path) as file:
            head = file.read(1 << 16)
            codec = compression_format(head)
            whole = [FilePart(path, size, 0, size, codec, "whole", None, False)]
            if codec is None:
                if head[0] not in b">@" or b"\n" not in head:
                    return whole
                cut_by, first = "bytes", head
                cuts = list(range(0, size, self.split))
            elif codec == "bgzf":
                file.seek(size - len(BGZF_END))
                if file.read() != BGZF_END:
                    return whole
                cut_by, first = "bgzf", next(gzip_pieces(iter([head])), b"")
                cuts = list(range(0, size, self.split))
            elif codec in ("zstd", "pzstd"):
                frames = zstd_frames(file, size)
                if not frames or len(frames) < 2:
                    return whole
                file.seek(0)
                cut_by, first = "zstd", next(decoded_pieces(file, codec, 1 << 16), b"")
                cuts = [0]
                for at in frames[1:]:
                    if at - cuts[-1] >= self.split:
                        cuts.append(at)
            else:
                return whole
            if b"\n" not in first or first[0] not in b">@":
                return whole
            return [FilePart(path, size, a, b, codec, cut_by, format_of(first[0]), is_crlf(first)) for a, b in zip(cuts, [*cuts[1:], size], strict=True)]

    def read(self, partition: FilePart | Bundle) -> Iterator[pa.RecordBatch]:
        path, index = "", None
        for part in partition.parts if isinstance(partition, Bundle) else [partition]:
            if part.path != path:  # the ranges behind it are numbered on
                path, index = part.path, part.first_index if self.bases is not None else 0 if part.cut_by == "whole" else None
            if path:
                index = yield from self.read_part(part, index)

    def read_part(self, partition: FilePart, index: int | None) -> Iterator[pa.RecordBatch]:
        """The batches of a part whose first record has the number index; returns that of the one behind its last."""
        try:
            for format_, records in self.scan(partition):
                if len(records):
                    yield from self.batches(records, format_, partition.path, index)
                    index = None if index is None else index + len(records)
        except (FastxError, OSError) as error:
            if not self.permissive:
                raise
            good = getattr(error, "records", None)
            if good is not None and len(good):
                yield from self.batches(good, "fasta" if good.quals is None else "fastq", partition.path, index)
            if "error" in self.schema.names and all(column_of(f) == "file" for f in self.filters):
                yield error_batch(self.schema, error if isinstance(error, FastxError) else InputError(str(error)), partition.path)
        return index

    def batches(self, records: Records, format_: str, path: str, index: int | None) -> Iterator[pa.RecordBatch]:
        """The batch of some records that are wanted."""
        keep = wanted(self.filters, records, format_) if self.filters else None
        if keep is None:
            yield record_batch(self.schema, records, format_, path, index)
        elif keep.any():
            yield record_batch(self.schema, chosen(records, keep), format_, path, None if index is None else index + np.flatnonzero(keep))

    def scan(self, part: FilePart) -> Iterator[tuple[str, Records]]:
        if part.error is not None:
            raise InputError(part.error)
        with open_input(part.path) as file:
            if part.cut_by == "whole":
                codec = part.codec
                if codec == UNKNOWN:
                    codec = compression_format(file.read(18))
                    file.seek(0)
                yield from scan_pieces(decoded_pieces(file, codec), self.with_seqs)
            else:
                own = Own(part.end - part.start if part.cut_by == "bytes" else None)
                yield from owned(part, self.plain(file, part) if part.cut_by == "bytes" else self.framed(file, part, own), own, self.with_seqs)

    @staticmethod
    def plain(file, part: FilePart) -> Iterator[bytes]:
        """From the range's start to the size that the file had when it was cut; it may have grown since. What is behind the range
        comes in small pieces first, as its last record mostly ends there."""
        file.seek(part.start)
        yield from raw_pieces(Stretch(file, part.end - part.start))
        rest, size = Stretch(file, part.size - part.end), BEHIND
        while piece := rest.read(size):
            yield piece
            size = min(2 * size, PIECE)

    @staticmethod
    def framed(file, part: FilePart, own: Own) -> Iterator[bytes]:
        """The decompressed bytes from the range's first block or frame on, each decoded once. How many are of the range is
        known, and told, once those behind it are asked for."""
        start, end = part.start, part.end
        if part.cut_by == "bgzf":
            start = next_bgzf_block(file, part.start, part.size) if part.start else 0
            end = next_bgzf_block(file, part.end, part.size) if part.end < part.size else part.size
            end = part.size if end is None else end
        total = 0
        if start is not None and start != end:
            file.seek(start)
            for piece in decoded_pieces(Stretch(file, end - start), part.codec):
                total += len(piece)
                yield piece
        own.n = total
        if total and end < part.size:
            file.seek(end)
            yield from decoded_pieces(file, part.codec, BEHIND)


class FilteringReader(FastxReader):
    """A reader that tests what it can of a query's filters itself."""

    def pushFilters(self, filters: list) -> list:
        self.filters, rest = split_filters(filters)
        return rest


class Counter(FastxReader):
    """Instead of records: how many there are in the ranges of a file that a task reads, as (file, byte_start of the first range,
    record_index: their number)."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.whole_files = False

    def read(self, partition: FilePart | Bundle) -> Iterator[pa.RecordBatch]:
        parts = partition.parts if isinstance(partition, Bundle) else [partition]
        for path, found in groupby(parts, lambda part: part.path):
            ranges = list(found)
            if path:
                n = sum(len(records) for part in ranges for _, records in self.scan(part))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ranges[0].start], pa.int64()), pa.array([n], pa.int64())], names=self.schema.names)


class Stretch:
    """The next n bytes of a file, as a file."""

    def __init__(self, file, n: int):
        self.file, self.left = file, n

    def read(self, n: int = -1) -> bytes:
        data = self.file.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(data)
        return data


@dataclass
class Own:
    """How many bytes of what a task reads are of its range; None while not known yet."""

    n: int | None


def first_record(part: FilePart, pieces: Iterator[bytes], own: Own) -> tuple[int, bytes] | None:
    """Where the first record starts whose line feed lies in the task's own bytes, and what was read from there on."""
    found = (first_fasta if part.format == "fasta" else first_fastq)(pieces, own, part.crlf)
    return found if found is not None and (own.n is None or found[0] <= own.n) else None


def first_fasta(pieces: Iterator[bytes], own: Own, crlf: bool) -> tuple[int, bytes] | None:
    """Looks at each byte once and keeps none before the record."""
    last, base = b"", 0
    for piece in pieces:
        piece = last + piece
        at = piece.find(b"\n>")
        if at >= 0:
            return base + at + 1, piece[at + 1 :]
        base, last = base + len(piece) - 1, piece[-1:]
        if own.n is not None and base >= own.n:
            return None
    return None


def first_fastq(pieces: Iterator[bytes], own: Own, crlf: bool) -> tuple[int, bytes] | None:
    """Keeps what follows the first line feed until one reading of its lines is left; a range without a line feed, or with none
    behind which a record could start, is given up at its end."""
    sync, held, base, begin, seen = None, bytearray(), 0, 0, 0
    for piece in pieces:
        if sync is None:
            at = piece.find(b"\n")
            base += len(piece) if at < 0 else at + 1
            if at < 0:
                if own.n is not None and base >= own.n:
                    return None
                continue
            sync, piece = FastqSync(crlf), piece[at + 1 :]
        held += piece
        while not sync.lost and (end := held.find(b"\n", seen)) >= 0:
            sync.line(base + begin, bytes(held[begin:end]))
            begin = seen = end + 1
            if sync.start is not None:
                return sync.start, bytes(held[sync.start - base :])
        if sync.lost:
            at = irregular_record_start(b"\n" + held)
            if at is not None:
                return base + at - 1, bytes(held[at - 1 :])
            continue
        seen = len(held)
        earliest = sync.earliest(base + begin, bytes(held[begin : begin + 1]))
        if own.n is not None and base + seen > own.n and (earliest is None or earliest > own.n):
            return None
    if sync is not None and not sync.lost:
        sync.end(bytes(held[begin:]))
        if sync.start is not None:
            return sync.start, bytes(held[sync.start - base :])
    return None


def owned(part: FilePart, pieces: Iterator[bytes], own: Own, with_seqs: bool = True) -> Iterator[tuple[str, Records]]:
    """The records whose line feed before them lies in the task's own bytes; the file's first record needs none."""
    base = part.start if part.cut_by == "bytes" else 0
    first = next(((0, p) for p in pieces), None) if part.start == 0 else first_record(part, pieces, own)
    if first is None:
        return
    scan = scanner(part.format, base + first[0], part.crlf, part.start == 0, with_seqs)
    for piece in chain([first[1]], pieces):
        records = scan.feed(piece)
        if own.n is not None:
            done = len(records) and records.starts[-1] > base + own.n
            if done:
                records = records.cut(int(np.searchsorted(records.starts, base + own.n, "right")))
            yield part.format, records
            if done or scan.offset > base + own.n:
                return
        else:
            yield part.format, records
    records = scan.finish()
    yield part.format, records if own.n is None else records.cut(int(np.searchsorted(records.starts, base + own.n, "right")))


class FastxDataSource(DataSource):
    """spark.read.format("fastx").option("splitBytes", n).option("mode", "PERMISSIVE").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return ", ".join(c for c in SCHEMA.split(", ", 9) if not c.startswith(("record_index", "error")))

    def reader(self, schema: StructType) -> FastxReader:
        options = dict(self.options)
        if options.get("countonly", options.get("countOnly")) == "true":
            return Counter(schema, options)
        pushes = options.get("pushfilters", options.get("pushFilters")) == "true"
        return (FilteringReader if pushes else FastxReader)(schema, options)

    def writer(self, schema: StructType, overwrite: bool) -> FastxWriter:
        return FastxWriter(schema, dict(self.options), overwrite)


def requested_schema(columns: list[str] | None, binary: bool) -> StructType:
    """The columns asked for, in their order, or the usual ones."""
    names = columns or ["file", "format", "header", "seq", "quality", "dna_len"]
    full = {f.name: f for f in _parse_datatype_string(SCHEMA).fields}
    schema = StructType([full[n] for n in names])
    if binary:
        for f in schema.fields:
            if f.name in ("header", "seq", "quality"):
                f.dataType = BinaryType()
    return schema


def read_fastx(spark: SparkSession, paths: str | list[str], *, columns: list[str] | None = None, options: FastxOptions | None = None, mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES, binary: bool = False, push_filters: bool = False) -> DataFrame:
    """Records of files, folders or patterns, with only the columns asked for.

    columns: some of file, record_index (files aren't cut then), format, header, seq, quality, dna_len, byte_start,
    byte_end, error (mode PERMISSIVE: good records first, then a row with the error; files that aren't there or can't be read are
    such rows, too). options: fields and residue policy, see strandlake.operators.project. binary: header, seq and quality as
    bytes. push_filters: the scan tests a query's filters itself where it can, see filters.py; turns on the session's setting
    spark.sql.python.filterPushdown.enabled.
    """
    from ..operators.project import apply_options, source_columns

    spark.dataSource.register(FastxDataSource)
    schema = requested_schema(columns or (source_columns(options) if options else None), binary)
    joined = paths if isinstance(paths, str) else "\n".join(paths)
    reader = spark.read.format("fastx").schema(schema).option("paths", joined).option("mode", mode).option("splitBytes", split_bytes).option("parallelism", spark.sparkContext.defaultParallelism)
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = reader.option("pushFilters", "true")
    out = reader.load()
    return apply_options(out, options) if options else out


def read_numbered(spark: SparkSession, paths: str | list[str], *, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES, binary: bool = False) -> DataFrame:
    """As read_fastx, with record_index although files are cut: a first scan, without columns, counts the records of each
    task's ranges; their sums tell each task the number of its first record. Files are read twice and nothing is shuffled; the
    driver sees a row for each task and file."""
    spark.dataSource.register(FastxDataSource)
    joined = paths if isinstance(paths, str) else "\n".join(paths)
    reader = spark.read.format("fastx").option("paths", joined).option("splitBytes", split_bytes).option("parallelism", spark.sparkContext.defaultParallelism)
    counts = reader.schema("file string, byte_start long, record_index long").option("countOnly", "true").load().collect()
    bases: dict[str, dict[int, int]] = {}
    for path, start, n in sorted(tuple(r) for r in counts):
        starts = bases.setdefault(path, {"end": 0})
        starts[start], starts["end"] = starts["end"], starts["end"] + n
    schema = requested_schema(columns or ["file", "record_index", "format", "header", "seq", "quality", "dna_len"], binary)
    return reader.schema(schema).option("countOnly", "false").option("bases", json.dumps(bases)).load()
