"""Dense record numbers across the splits of a file, without bringing a file together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_record_index(records: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """records (with file and byte_start) with record_index, 0, 1, ... in each file.

    Records are numbered within blocks of byte offsets, and blocks are counted: the windows see a block or a file's
    blocks, never a file's records.
    """
    blocked = records.withColumn("block_", F.floor(F.col("byte_start") / block_bytes))
    counts = blocked.groupBy("file", "block_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("file").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col("file").alias("f_"), F.col("block_").alias("b_"), before.alias("before_"))
    local = F.row_number().over(Window.partitionBy("file", "block_").orderBy("byte_start"))
    joined = blocked.withColumn("local_", local).join(base, blocked["file"].eqNullSafe(base["f_"]) & (F.col("block_") == F.col("b_")))
    return joined.withColumn("record_index", F.col("local_") + F.col("before_") - 1).drop("block_", "f_", "b_", "before_", "local_")
