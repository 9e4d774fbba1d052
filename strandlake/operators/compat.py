"""Familiar shapes for people who come from record-by-record readers: an iterator, folds, and batch processors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fastx import read_fastx
from .parse import parse_fastx


@dataclass(frozen=True)
class SequenceRecord:
    """One record; id is the whole header line."""

    id: str
    seq: str
    qual: str | None
    format: str
    index: int

    @property
    def raw_seq(self) -> str:
        return self.seq

    seq_raw = raw_seq

    @property
    def num_bases(self) -> int:
        return len(self.seq.encode())


def _iterate(df: DataFrame) -> Iterator[SequenceRecord]:
    for i, r in enumerate(df.toLocalIterator()):
        yield SequenceRecord(r["header"], r["seq"], r["quality"], r["format"], i)


def iterate_fastx(spark: SparkSession, path: str) -> Iterator[SequenceRecord]:
    """The records of a file one by one on the driver, which holds a partition at a time."""
    rows = read_fastx(spark, path, columns=["file", "format", "header", "seq", "quality", "byte_start"])
    return _iterate(rows.orderBy("file", "byte_start"))


def iterate_bytes(spark: SparkSession, data: bytes, *, decompress: bool = True) -> Iterator[SequenceRecord]:
    """The records of an input in memory."""
    df = spark.createDataFrame([(data,)], "content binary")
    return _iterate(parse_fastx(df, "content", decompress=decompress).orderBy("record_index"))


def record_view(records: DataFrame) -> DataFrame:
    """The columns id, seq, seq_raw, qual and index."""
    index = F.col("record_index") if "record_index" in records.columns else F.lit(None).cast("long")
    return records.select(F.col("header").alias("id"), "seq", F.col("seq").alias("seq_raw"), F.col("quality").alias("qual"), index.alias("index"))


def for_each(records: DataFrame, process: Callable[[pa.RecordBatch], None]) -> None:
    """Calls process on every Arrow batch, on the executors; a failure fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            process(batch)
            n += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    records.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def fold_partitions(records: DataFrame, init: Callable[[], Any], process: Callable[[Any, pa.RecordBatch], Any], to_row: Callable[[Any], dict], schema: str) -> DataFrame:
    """One row of state for each partition: init() led through its batches by process. Merge them with agg()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = init()
        for batch in batches:
            state = process(state, batch)
        row = to_row(state)
        yield pa.RecordBatch.from_pylist([row])

    return records.mapInArrow(run, schema)


def reduce_partitions(records: DataFrame, init: Callable[[], Any], process: Callable[[Any, pa.RecordBatch], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """One state for all records: partitions are folded on the executors, their states merged on the driver; init() for
    none. States must be small; for anything larger, fold to rows and aggregate those."""
    import functools
    import pickle

    states = fold_partitions(records, init, process, lambda s: {"state": pickle.dumps(s)}, "state binary").collect()
    return functools.reduce(merge, (pickle.loads(bytes(r["state"])) for r in states), init())


class BatchProcessor:
    """Override what is needed; one instance works through each partition, and what it returns is output.

    process_batch gets Arrow batches. Those who think in records override process_record instead, which gets a dict for each.
    """

    schema = "value string"
    requires_ordering = False

    def set_partition(self, number: int) -> None: ...

    def process_batch(self, batch: pa.RecordBatch) -> pa.RecordBatch | pa.Table | list[dict] | None:
        names = batch.schema.names
        rows = zip(*(iter(column) for column in batch.columns), strict=True)
        return [x for row in rows if (x := self.process_record({n: v.as_py() for n, v in zip(names, row, strict=True)})) is not None]

    def process_record(self, record: dict) -> dict | None:
        raise NotImplementedError

    def on_batch_complete(self) -> list[dict]:
        return []

    def on_partition_complete(self) -> list[dict]:
        return []


TICKET = "struct<file: string, byte_start: long, row: long>"


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The parts of a batch in which file stays and byte_start ascends: stretches of the input, as a scan gives them."""
    if batch.num_rows < 2:
        yield batch
        return
    file, start = batch.column("file"), batch.column("byte_start")
    breaks = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.less_equal(start[1:], start[:-1]))
    cuts = [0, *(pc.indices_nonzero(breaks).to_numpy() + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(lo, hi - lo)


def process_parallel(records: DataFrame, processor: BatchProcessor) -> DataFrame:
    """The rows that a processor gives.

    With requires_ordering, rows come in the order of the input (file, byte_start), which records must have as columns: every
    batch draws a ticket, the place of its first record in the input, its rows carry it in the column `ticket` with their
    number in the batch, and the output is sorted by it. Records stay where they are, for which they must come from a scan, a
    partition being a stretch of the input; rows of on_partition_complete follow those of the partition's last batch.
    """
    from copy import deepcopy

    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    out = _parse_datatype_string(processor.schema)
    schema, ordered = to_arrow_schema(out), processor.requires_ordering
    full = StructType([*out.fields, *_parse_datatype_string(f"ticket {TICKET}").fields]) if ordered else out

    def table(found: pa.RecordBatch | pa.Table | list[dict] | None) -> pa.Table:
        if found is None:
            return schema.empty_table()
        if isinstance(found, list):
            return pa.Table.from_pylist(found, schema)
        return (found if isinstance(found, pa.Table) else pa.Table.from_batches([found])).select(schema.names).cast(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = deepcopy(processor)
        own.set_partition(TaskContext.get().partitionId())
        file, start, given = None, None, 0

        def stamped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal given
            if ordered:
                n = rows.num_rows
                ticket = pa.StructArray.from_arrays([pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(given, given + n), pa.int64())], ["file", "byte_start", "row"])
                rows, given = rows.append_column("ticket", ticket), given + n
            yield from rows.combine_chunks().to_batches()

        for batch in batches:
            for part in _runs(batch) if ordered else (batch,):
                if ordered and part.num_rows:
                    file, start, given = part.column("file")[0].as_py(), part.column("byte_start")[0].as_py(), 0
                yield from stamped(table(own.process_batch(part)))
                yield from stamped(table(own.on_batch_complete()))
        yield from stamped(table(own.on_partition_complete()))

    done = records.mapInArrow(run, full)
    return done.orderBy("ticket") if ordered else done
