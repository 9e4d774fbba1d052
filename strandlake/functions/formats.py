"""Column functions over the first bytes of inputs: what format and compression they announce."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compression_format(content: Column | str) -> Column:
    """gzip, bgzf, zstd, pzstd, bzip2 or xz by a binary column's first bytes; null for anything else."""
    column = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(column, 1, 18))
    blocked = (F.length(head) == 36) & (F.substring(head, 5, 2) == "08") & (F.conv(F.substring(head, 7, 2), 16, 10).cast("int").bitwiseAND(F.lit(4)) != 0) & (F.substring(head, 25, 8) == "42430200")
    return (
        F.when(head.startswith("1F8B") & blocked, "bgzf")
        .when(head.startswith("1F8B"), "gzip")
        .when(head.startswith("28B52FFD"), "zstd")
        .when(head.rlike("^5.2A4D18"), "pzstd")
        .when(head.startswith("425A"), "bzip2")
        .when(head.startswith("FD377A"), "xz")
    )


def sequence_format(content: Column | str) -> Column:
    """fasta or fastq by the first byte of an uncompressed string or binary; null for anything else, and for nothing."""
    column = F.col(content) if isinstance(content, str) else content
    first = F.hex(F.substring(column.cast("binary"), 1, 1))
    return F.when(first == "3E", "fasta").when(first == "40", "fastq")
