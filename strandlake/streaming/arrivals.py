"""Sequence files as a stream: files that arrive in a folder are parsed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import parse_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_fastx(spark: SparkSession, folder: str, *, pattern: str = "*", max_files: int = 64, **options) -> DataFrame:
    """The records of every file that arrives in folder, a streaming DataFrame; see parse_files.

    A file is parsed whole, in one task, and must fit its memory; deliver large inputs in parts.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)
    return parse_files(files, **options)


def windowed_totals(spark: SparkSession, folder: str, *, window: str = "10 minutes", watermark: str = "1 hour", **options) -> DataFrame:
    """Records and residues by arrival window and format, for append-mode sinks."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    from ..operators.parse import parse_fastx

    rows = parse_fastx(files, "content", keys=("modificationTime",), columns=("format", "dna_len"), decompress=True, **options)
    return rows.withWatermark("modificationTime", watermark).groupBy(F.window("modificationTime", window), "format").agg(F.count("*").alias("n_records"), F.sum("dna_len").alias("n_bases"))
