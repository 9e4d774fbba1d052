"""Filters that a scan of sequence files applies itself, before it builds the columns of a batch.

Spark hands over conditions on single columns (a = 1, a < 5, a in (..), a like 'x%', not ...). Those on header, format, dna_len
and byte offsets are tested on a batch of records at once, as bytes, so that sequences and qualities of other records are never
turned into columns; one on file drops whole files before any of their bytes is read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import datasource as ds

from .grammar import Records

NUMBERS = {"dna_len", "byte_start", "byte_end"}
TEXTS = {"header", "format", "file"}
COMPARE = {ds.EqualTo: "equal", ds.EqualNullSafe: "equal", ds.GreaterThan: "greater", ds.GreaterThanOrEqual: "greater_equal", ds.LessThan: "less", ds.LessThanOrEqual: "less_equal"}
MATCH = {ds.StringStartsWith: "starts_with", ds.StringEndsWith: "ends_with", ds.StringContains: "match_substring"}


def column_of(f: ds.Filter) -> str | None:
    """The column that a filter is about, if it is one that a scan can test."""
    if isinstance(f, ds.Not):
        return column_of(f.child)
    name = f.attribute[0] if len(f.attribute) == 1 else None
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return name if name in NUMBERS | TEXTS else None
    values = list(f.value) if isinstance(f, ds.In) else [f.value]
    if any(v is None for v in values):
        return None
    if name in TEXTS and type(f) in {*COMPARE, *MATCH, ds.In}:
        # Text with replacement characters may stand for bytes that aren't UTF-8.
        return name if all(isinstance(v, str) and "�" not in v for v in values) and (name == "header" or type(f) not in MATCH) else None
    if name in NUMBERS and type(f) in {*COMPARE, ds.In}:
        return name if all(isinstance(v, int) and abs(v) < 1 << 62 for v in values) else None
    return None


def split_filters(filters: Iterable[ds.Filter]) -> tuple[list[ds.Filter], list[ds.Filter]]:
    """Those that a scan tests, and the rest."""
    taken, rest = [], []
    for f in filters:
        (rest if column_of(f) is None else taken).append(f)
    return taken, rest


def _test(f: ds.Filter, values: np.ndarray | pa.Array, n: int) -> np.ndarray:
    if isinstance(f, ds.Not):
        return ~_test(f.child, values, n)
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return np.full(n, isinstance(f, ds.IsNotNull))
    if isinstance(values, np.ndarray):
        if isinstance(f, ds.In):
            return np.isin(values, np.array(list(f.value), np.int64))
        return getattr(np, COMPARE[type(f)])(values, f.value)
    if isinstance(f, ds.In):
        found = pc.is_in(values, pa.array([v.encode() for v in f.value], pa.binary()))
    elif type(f) in MATCH:
        found = getattr(pc, MATCH[type(f)])(values, f.value.encode())
    else:
        found = getattr(pc, COMPARE[type(f)])(values, pa.scalar(f.value.encode(), pa.binary()))
    return found.to_numpy(zero_copy_only=False).astype(bool)


def keeps_file(filters: list[ds.Filter], path: str) -> bool:
    """Whether a file's records can be wanted at all."""
    own = pa.array([path.encode()], pa.binary())
    return all(_test(f, own, 1)[0] for f in filters if column_of(f) == "file")


def wanted(filters: list[ds.Filter], records: Records, format_: str) -> np.ndarray | None:
    """Which records pass all filters but those on files; None for all of them."""
    n, keep = len(records), None
    for f in filters:
        name = column_of(f)
        if name == "file":
            continue
        if name == "header":
            values = records.headers.cast(pa.binary()) if isinstance(records.headers, pa.Array) else pa.array(records.headers, pa.binary())
        elif name == "format":
            values = pa.array([format_.encode()] * n, pa.binary())
        elif name == "dna_len":
            values = pc.binary_length(records.seqs).to_numpy() if isinstance(records.seqs, pa.Array) else np.array([len(s) for s in records.seqs], np.int64)
        else:
            values = np.asarray(records.starts if name == "byte_start" else records.ends, np.int64)
        found = _test(f, values, n)
        keep = found if keep is None else keep & found
    return None if keep is None or keep.all() else keep


def chosen(records: Records, keep: np.ndarray) -> Records:
    """The records at which keep is true."""
    at = np.flatnonzero(keep)

    def take(values):
        if isinstance(values, pa.Array):
            return values.take(pa.array(at))
        return values[at] if isinstance(values, np.ndarray) else [values[i] for i in at] if values else values

    return Records(*(take(v) for v in (records.headers, records.seqs, records.quals, records.starts, records.ends)))
