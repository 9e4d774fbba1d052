"""Writers: FASTA and FASTQ text in any store that Spark writes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrapped(seq: Column, width: int, end: str = "\n") -> Column:
    """A sequence in lines of `width` residues; width 0 leaves it on one line."""
    return F.regexp_replace(seq, "(.{%d})(?=.)" % width, "$1" + end) if width else seq


def fasta_text(header: str = "header", seq: str = "seq", *, width: int = 0, crlf: bool = False) -> Column:
    """A record's lines without the last line end."""
    end = "\r\n" if crlf else "\n"
    return F.concat(F.lit(">"), F.coalesce(F.col(header), F.lit("")), F.lit(end), wrapped(F.coalesce(F.col(seq), F.lit("")), width, end))


def fastq_text(header: str = "header", seq: str = "seq", quality: str = "quality", *, crlf: bool = False) -> Column:
    """A record's four lines without the last line end. A null quality becomes one of I for each residue."""
    end = F.lit("\r\n" if crlf else "\n")
    text = F.coalesce(F.col(seq), F.lit(""))
    scores = F.coalesce(F.col(quality), F.repeat(F.lit("I"), F.octet_length(text)))
    return F.concat(F.lit("@"), F.coalesce(F.col(header), F.lit("")), end, text, end, F.lit("+"), end, scores)


def _ordered(records: DataFrame) -> DataFrame:
    order = [c for c in ("file", "byte_start") if c in records.columns]
    return records.sortWithinPartitions(*order) if "byte_start" in order else records


def write_fasta(records: DataFrame, path: str, *, width: int = 0, crlf: bool = False, compression: str | None = None, mode: str = "errorifexists") -> None:
    """Part files of FASTA; in each, records of a file stand in their order. Qualities are dropped, headers kept."""
    lines = _ordered(records).select(fasta_text(width=width, crlf=crlf).alias("value"))
    _write(lines, path, crlf, compression, mode)


def write_fastq(records: DataFrame, path: str, *, crlf: bool = False, compression: str | None = None, mode: str = "errorifexists") -> None:
    """Part files of FASTQ."""
    lines = _ordered(records).select(fastq_text(crlf=crlf).alias("value"))
    _write(lines, path, crlf, compression, mode)


def _write(lines: DataFrame, path: str, crlf: bool, compression: str | None, mode: str) -> None:
    writer = lines.write.mode(mode).option("lineSep", "\r\n" if crlf else "\n")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_fastx(records: DataFrame, path: str, *, kind: str = "fastq", compression: str | None = "bgzf", block_bytes: int | None = None, width: int = 0, crlf: bool = False, mode: str = "append") -> None:
    """Part files of FASTA or FASTQ by the data source's own writer, with an all-or-nothing commit (modes append, overwrite).

    bgzf and zstd files consist of blocks or frames of block_bytes of text and are split by readers; gzip, bzip2 and xz are one
    stream. Lines are made by column functions; tasks only compress them.
    """
    from .fastx import FastxDataSource

    records.sparkSession.dataSource.register(FastxDataSource)
    text = fastq_text(crlf=crlf) if kind == "fastq" else fasta_text(width=width, crlf=crlf)
    writer = _ordered(records).select(text.alias("text")).write.format("fastx").mode(mode).option("lineSep", "\r\n" if crlf else "\n").option("extension", ".fq" if kind == "fastq" else ".fa")
    if block_bytes:
        writer = writer.option("blockBytes", block_bytes)
    writer.option("compression", compression or "none").save(path)


def fastq_to_fasta(records: DataFrame) -> DataFrame:
    """record, line_no and line of the FASTA form: a header line and one line of sequence for each record."""
    lines = F.array(F.concat(F.lit(">"), F.col("header")), F.col("seq"))
    return records.select(F.col("header").alias("record"), F.posexplode(lines).alias("line_no", "line"))


def concatenated(records: DataFrame, text: Column, order: list[str], *by: str, name: str = "content", end: str = "\n") -> DataFrame:
    """All records of a group as one text, in order: a file's content in a row, for tests and small groups."""
    parts = F.sort_array(F.collect_list(F.struct(*order, text.alias("t_"))))
    return records.groupBy(*by).agg(F.concat(F.array_join(F.transform(parts, lambda p: p["t_"]), end), F.lit(end)).alias(name))
