"""Joins of intervals: overlaps, and the last one that begins before a place.

An interval lies on a sequence (a key, such as file and header) from start to end, end not included. It is put into every bin of
`width` coordinates that it touches, and two intervals are compared where both are, so the join is one by equality of key and bin
that Spark shuffles, spreads and, where it has skew, splits. Of the bins that two intervals share, one owns the pair: the bin
in which the later of them begins. So no pair comes twice and nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    """The bins of an interval; an empty one lies in that of its start."""
    first = F.floor(start / width).cast("long")
    return F.sequence(first, F.greatest(first, F.floor((end - 1) / width).cast("long")))


def overlaps(left: DataFrame, right: DataFrame, on: list[str], *, start: str = "start", end: str = "end", width: int = 1 << 14, suffix: str = "_right") -> DataFrame:
    """All pairs of a left and a right interval of one key that share a coordinate, with the columns of both; those of right but
    the keys get the suffix.

    Intervals with a null key, start or end, and empty ones, overlap nothing. width: some thousand coordinates, at best about
    the usual length of an interval, of which each makes one row for each bin.
    """
    named = right.select(*on, *[F.col(c).alias(c + suffix) for c in right.columns if c not in on])
    taken = {c.lower() for c in (*left.columns, *named.columns)}
    bin_ = "bin_"
    while bin_ in taken:
        bin_ += "_"
    some = lambda df, s, e: df.where((F.col(e) > F.col(s)) & F.col(s).isNotNull()).withColumn(bin_, F.explode(_bins(F.col(s), F.col(e), width)))
    a, b = some(left, start, end), some(named, start + suffix, end + suffix)
    pairs = a.join(b, [*on, bin_])
    s, e, t, u = F.col(start), F.col(end), F.col(start + suffix), F.col(end + suffix)
    return pairs.where((s < u) & (t < e) & (F.col(bin_) == F.floor(F.greatest(s, t) / width))).drop(bin_)


def asof(left: DataFrame, right: DataFrame, on: list[str], *, at: str = "pos", start: str = "start", width: int = 1 << 14, suffix: str = "_right") -> DataFrame:
    """Each left row with the right row of its key that begins last at or before `at`; with nulls if there is none, or if its key
    or place is null.

    Right rows that begin at one place: the greatest by their other columns. Both sides are dealt by key and bin; a bin's last
    right row is carried on to later bins of its key by a window over bins, of which each is one row, so neither side meets
    the other but within a bin.
    """
    rest = [c for c in right.columns if c not in on]
    packed = F.struct(F.col(start).alias("begins_"), *[F.col(c) for c in rest if c != start])
    events = right.where(F.col(start).isNotNull()).select(*on, F.floor(F.col(start) / width).cast("long").alias("bin_"), F.col(start).alias("at_"), packed.alias("row_"))
    keyed = left.select(*on, F.floor(F.col(at) / width).cast("long").alias("bin_"), F.col(at).alias("at_"), F.struct(*left.columns).alias("left_"))
    lasts = events.groupBy(*on, "bin_").agg(F.max("row_").alias("row_"))
    marks = lasts.unionByName(keyed.select(*on, "bin_").distinct(), allowMissingColumns=True).groupBy(*on, "bin_").agg(F.max("row_").alias("row_"))
    earlier = Window.partitionBy(*on).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*on, "bin_", F.last("row_", ignorenulls=True).over(earlier).alias("row_")).where("row_ is not null")
    inherited = carried.select(*on, "bin_", F.lit(None).alias("at_"), "row_")
    sides = events.unionByName(inherited).withColumn("left_", F.lit(None)).unionByName(keyed.withColumn("row_", F.lit(None)))
    # Within a bin: what was carried on to it, then events and places in order, an event before a place where it begins.
    order = Window.partitionBy(*on, "bin_").orderBy(F.col("at_").asc_nulls_first(), F.col("left_").isNotNull(), "row_").rowsBetween(Window.unboundedPreceding, 0)
    found = sides.withColumn("found_", F.last("row_", ignorenulls=True).over(order)).where("left_ is not null")
    known = F.col("left_")[at].isNotNull()
    for c in on:
        known = known & F.col("left_")[c].isNotNull()
    return found.select("left_.*", *[F.when(known, F.col("found_")["begins_" if c == start else c]).alias(c + suffix) for c in rest])
