"""Running length of merged sequences over a stream, which goes on from batch to batch.

State is one number for each file: how long its sequence was after the batches so far. A batch's own running sums are those of the
batch operator, in two levels of blocks, so no task and no state ever holds a file's records. Rows and state of a batch go
to folders named by its number, which a batch that is run again after a failure replaces by the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.aggregates import running_length


def write_running_length(records: DataFrame, path: str, *, by: tuple[str, ...] = ("file",), order: tuple[str, ...] = ("byte_start",), length: str = "dna_len", block: int = 1 << 16, **trigger) -> StreamingQuery:
    """Starts writing the rows of a stream with merged_len to path/rows as Parquet: the length of all records of its group so far.

    Records of a group must come in their order, batch after batch, as stream_ranges gives those of a growing file. trigger: as
    of DataStreamWriter.trigger. Read the result by `read_running_length`.
    """
    spark = records.sparkSession

    def totals_before(batch: int) -> DataFrame:
        if batch == 0:
            return spark.createDataFrame([], ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in by) + ", total_ bigint")
        return spark.read.parquet(f"{path}/totals/batch={batch - 1}")

    def step(rows: DataFrame, batch: int) -> None:
        before = totals_before(batch)
        local = running_length(rows, list(order), *by, length=length, block=block)
        known = before.select(*[F.col(c).alias(f"{c}_of") for c in by], "total_")
        same = [local[c].eqNullSafe(known[f"{c}_of"]) for c in by]
        out = local.join(known, same, "left").withColumn("merged_len", F.col("merged_len") + F.coalesce("total_", F.lit(0))).select(*records.columns, "merged_len")
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        added = rows.groupBy(*by).agg(F.sum(length).alias("total_")).unionByName(before).groupBy(*by).agg(F.sum("total_").alias("total_"))
        added.write.mode("overwrite").parquet(f"{path}/totals/batch={batch}")

    return records.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/offsets").trigger(**(trigger or {"availableNow": True})).start()


def read_running_length(spark, path: str) -> DataFrame:
    """All rows that have been written so far, with the number of their batch."""
    return spark.read.parquet(f"{path}/rows")
