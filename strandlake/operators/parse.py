"""FASTA and FASTQ that is held in a column."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..errors import FastxError
from ..sources.codecs import compression_format, decoded_pieces
from ..sources.fastx import SCHEMA, error_batch, record_batch
from ..sources.grammar import Records, concatenated_records, scan_bytes, scan_pieces

#: How much text of a batch's contents is parsed before its records are given on.
HELD_BYTES = 1 << 20

COLUMNS = ("record_index", "format", "header", "seq", "quality", "dna_len")


def parse_fastx(df: DataFrame, content: str, *, keys: tuple[str, ...] = (), columns: tuple[str, ...] = COLUMNS, mode: str = "FAILFAST", decompress: bool = False, binary: bool = False) -> DataFrame:
    """The records of each row's content (string or binary), a whole input each, with the row's key columns.

    columns as in read_fastx, but file; in mode PERMISSIVE with `error` among them a bad input gives its good records and
    a row with the error. decompress: gzip, zstd, bzip2 and xz are told by their magic bytes. A null or empty content has
    no records; extra columns of df are ignored, and a key may have any name that no wanted column has.
    """
    full = {f.name: f for f in _parse_datatype_string(SCHEMA).fields}
    schema = StructType([full[c] for c in columns])
    if binary:
        schema = StructType.fromJson(schema.jsonValue())
        from pyspark.sql.types import BinaryType

        for f in schema.fields:
            if f.name in ("header", "seq", "quality"):
                f.dataType = BinaryType()
    clash = set(keys) & set(columns)
    if clash:
        raise ValueError(f"keys named like columns: {sorted(clash)}")

    def scanned(data: bytes) -> Iterator[tuple[str, Records, int, FastxError | None]]:
        """(format, records, number of the first) of an input, the error that it ends in with no records."""
        index = 0
        pieces = decoded_pieces(io.BytesIO(data), compression_format(data)) if decompress else None
        try:
            for format_, records in scan_pieces(pieces) if pieces is not None else scan_bytes(data):
                if len(records):
                    yield format_, records, index, None
                    index += len(records)
        except FastxError as error:
            if mode.upper() != "PERMISSIVE":
                raise
            good = getattr(error, "records", None) or Records()
            if len(good):
                yield "fasta" if good.quals is None else "fastq", good, index, None
            if "error" in columns:
                yield "", Records(), 0, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[tuple[Records, int, int]]] = {}
            size = 0
            contents = batch.column(len(keys))
            for r in range(len(batch)):
                data = contents[r].as_py()
                size += len(data or b"")
                for format_, records, index, error in scanned(data.encode() if isinstance(data, str) else data or b""):
                    if error is not None:
                        yield keyed(batch, error_batch(schema, error, None), np.array([r]))
                        continue
                    held.setdefault(format_, []).append((records, index, r))
                    if decompress:  # what counts is how long the records are, not how short their content was
                        size += int(records.ends[-1]) - int(records.starts[0])
                    if size > HELD_BYTES:
                        yield from joined(batch, held)
                        held, size = {}, 0
                if size > HELD_BYTES:
                    yield from joined(batch, held)
                    held, size = {}, 0
            yield from joined(batch, held)

    def joined(batch: pa.RecordBatch, held: dict[str, list[tuple[Records, int, int]]]) -> Iterator[pa.RecordBatch]:
        """What several contents gave, as one batch for each format."""
        for format_, found in held.items():
            n = [len(records) for records, _, _ in found]
            numbers = np.concatenate([np.arange(index, index + k) for (_, index, _), k in zip(found, n, strict=True)])
            rows = record_batch(schema, concatenated_records([records for records, _, _ in found]), format_, None, numbers)
            yield keyed(batch, rows, np.repeat([r for _, _, r in found], n))

    def keyed(batch: pa.RecordBatch, rows: pa.RecordBatch, at: np.ndarray) -> pa.RecordBatch:
        own = [batch.column(i).take(pa.array(at)) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*own, *rows.columns], [*keys, *columns])

    source = df.select(*keys, F.col(content).alias("content_"))
    out = StructType([*[source.schema[k] for k in keys], *schema.fields])
    return source.mapInArrow(run, out)


def split_input(data: bytes, parts: int) -> list[bytes]:
    """An uncompressed input cut before records into at most `parts` inputs of about equal size."""
    from ..sources.grammar import find_record_start, format_of, is_crlf

    if not data:
        return []
    kind = format_of(data[0])
    cuts = [0]
    for i in range(1, parts):
        at = find_record_start(kind, data, max(cuts[-1], len(data) * i // parts), is_crlf(data))
        if at is not None and at > cuts[-1]:
            cuts.append(at)
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def parse_in_parallel(spark: SparkSession, data: bytes, parts: int, **options) -> DataFrame:
    """The records of an input in the driver's memory, `parts` tasks to it; compressed data is decompressed first.

    Columns as in parse_fastx, with part for record_index's scope: records are numbered within their part.
    """
    if compression_format(data):
        data = b"".join(decoded_pieces(io.BytesIO(data), compression_format(data)))
    rows = spark.createDataFrame(list(enumerate(split_input(data, parts))), "part int, content binary")
    return parse_fastx(rows.repartition(max(parts, 1), "part"), "content", keys=("part",), **options)


def parse_files(files: DataFrame, **options) -> DataFrame:
    """The records of a binaryFile DataFrame (path, content): for stores that only Spark's readers reach, and streams."""
    return parse_fastx(files.withColumnRenamed("path", "file"), "content", keys=("file",), decompress=True, **options)
