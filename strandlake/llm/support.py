"""Helpers that several corpus operators share: checkpoints, Arrow text buffers, vectorised hashing."""

from __future__ import annotations

import functools
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Odd multiplier of the polynomial rolling hashes, and its inverse modulo 2**64.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Where none is configured, a local master (tests, a laptop) gets a temporary one; on a cluster that is an error, as
    executors wouldn't find what others wrote.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this run's own in whatever store Spark reaches by its path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to be no column of df (Spark's names don't tell case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the row offsets into them, without a copy; nulls count as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, max_bytes: int = 1 << 20, max_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about max_bytes of text each; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + max_rows)
        yield lo, hi
        lo = hi


def batch_pieces(batches: Iterator[pa.RecordBatch], text_col: int, max_bytes: int = 1 << 20, max_rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of one of their text columns."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text_col))
        for lo, hi in pieces(offsets, max_bytes, max_rows):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


@functools.lru_cache(maxsize=4)
def powers(size: int, base: int = MULTIPLIER) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64."""
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER and INVERSE for at least size positions, from tables of doubling length."""
    top = max(1 << 16, 1 << int(size).bit_length())
    return powers(top)[:size], powers(top, INVERSE)[:size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = 1 << 20) -> np.ndarray:
    """A 64-bit polynomial hash of each data[start:end], equal for equal bytes wherever they stand.

    Spans are sorted and disjoint. Long data is worked through in windows of about `window` bytes, and a span longer than
    that block by block, so memory doesn't grow with a text.
    """
    if len(data) <= window:
        return _short_span_hashes(data, starts, ends)
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + window, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        if b - a <= window:
            out[lo:hi] = _short_span_hashes(data[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
        else:  # one long span
            total = 0
            for at in range(a, b, window):
                part = data[at : min(at + window, b)]
                h = int(_short_span_hashes(part, np.array([0]), np.array([len(part)]))[0])
                total += h * pow(MULTIPLIER, at - a, 1 << 64)
            out[lo] = total & ((1 << 64) - 1)
        lo = hi
    return out


def _short_span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = power_tables(n + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * down[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with their high bits spread over all bits, for use as bucket numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True in member that don't cross a row's end."""
    n = len(member)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = member[:-1]
    starts = member & (~before | edge[:n])
    after = np.zeros(n, bool)
    after[:-1] = member[1:]
    ends = member & (~after | edge[1 : n + 1])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1
