"""Aggregations that people compute over sequence records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna


def seq_stats(records: DataFrame, *by: str) -> DataFrame:
    """num_seqs, sum_len, min_len, avg_len and max_len, by file and format unless said otherwise."""
    length = F.col("dna_len") if "dna_len" in records.columns else dna.dna_len("seq")
    keys = by or tuple(c for c in ("file", "format") if c in records.columns)
    return records.groupBy(*keys).agg(F.count("*").alias("num_seqs"), F.sum(length).alias("sum_len"), F.min(length).alias("min_len"), F.avg(length).alias("avg_len"), F.max(length).alias("max_len"))


def file_stats(spark, paths: list[str], **options) -> DataFrame:
    """seq_stats of each file that the paths (files, folders, patterns, URIs) stand for; a path for which there is nothing, and
    a file that can't be read or isn't well formed, gives a row with format ERR and null figures.

    A file with an error counts as that, whatever records came before it.
    """
    from ..sources.fastx import read_fastx

    rows = read_fastx(spark, paths, columns=["file", "format", "dna_len", "error"], mode="PERMISSIVE", **options)
    bad = F.max(F.col("error").isNotNull())
    length = lambda f: F.when(~bad, f("dna_len"))
    empty = F.when(~bad, F.count("dna_len"))
    return rows.groupBy("file").agg(F.when(bad, "ERR").otherwise(F.max("format")).alias("format"), empty.alias("num_seqs"), length(F.sum).alias("sum_len"), length(F.min).alias("min_len"), length(F.avg).alias("avg_len"), length(F.max).alias("max_len"))


def base_histogram(records: DataFrame, seq: str = "seq") -> DataFrame:
    """a, c, t and g over all records, in either case: four sums, no shuffle of sequences."""
    return records.agg(*[F.coalesce(F.sum(dna.base_count(seq, b)), F.lit(0)).alias(b.lower()) for b in "ACTG"])


def totals(records: DataFrame, seq: str = "seq") -> DataFrame:
    """n_records, n_bases and n_actg over all records."""
    return records.agg(F.count("*").alias("n_records"), F.coalesce(F.sum(dna.dna_len(seq)), F.lit(0)).alias("n_bases"), F.coalesce(F.sum(dna.actg_len(seq)), F.lit(0)).alias("n_actg"))


def header_lengths(records: DataFrame) -> DataFrame:
    """header and dna_len; of repeated headers the last record's length."""
    order = F.col("byte_start") if "byte_start" in records.columns else F.monotonically_increasing_id()
    return records.groupBy("header").agg(F.max_by("dna_len", order).alias("dna_len"))


def kmer_counts(records: DataFrame, k: int, *, canonical: bool = True, seq: str = "seq") -> DataFrame:
    """kmer and n: upper-case words of k residues within ACTG runs, by default the lesser of both strands.

    Words are counted in each task before they are shuffled.
    """
    runs = records.select(F.explode(dna.actg_runs(F.upper(F.col(seq)))).alias("run"))
    words = runs.select(F.explode(dna.kmers("run", k)).alias("kmer"))
    return words.select((dna.canonical("kmer") if canonical else F.col("kmer")).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def seq_rollup(records: DataFrame, *by: str) -> DataFrame:
    """seq_stats of every group of by, of every group of its beginnings, and of all records; by columns are null where they are
    summed over, and `level` is how many are kept."""
    length = F.col("dna_len") if "dna_len" in records.columns else dna.dna_len("seq")
    kept = sum((1 - F.grouping(c) for c in by), F.lit(0)).cast("int")
    return records.rollup(*by).agg(kept.alias("level"), F.count("*").alias("num_seqs"), F.sum(length).alias("sum_len"), F.min(length).alias("min_len"), F.avg(length).alias("avg_len"), F.max(length).alias("max_len"))


def kmer_sketches(records: DataFrame, k: int, *by: str, canonical: bool = True, seq: str = "seq", bits: int = 14) -> DataFrame:
    """A sketch of each group's distinct words of k residues, of 2**bits registers whatever their number. Sketches of parts are
    merged by `merged_kmers`, today's with those of a table written yesterday."""
    runs = records.select(*by, F.explode(dna.actg_runs(F.upper(F.col(seq)))).alias("run"))
    words = runs.select(*by, F.explode(dna.kmers("run", k)).alias("kmer"))
    return words.groupBy(*by).agg(F.hll_sketch_agg(dna.canonical("kmer") if canonical else "kmer", bits).alias("sketch"))


def merged_kmers(sketches: DataFrame, *by: str, rollup: bool = False) -> DataFrame:
    """The estimated number of distinct words of the groups by, from sketches of finer ones, and their merged sketches; with
    rollup also of the beginnings of by and of all. The relative standard error is about 1.04 / sqrt(2**bits), 0.8 % at 14."""
    grouped = sketches.rollup(*by) if rollup else sketches.groupBy(*by)
    return grouped.agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("distinct_kmers", F.hll_sketch_estimate("sketch"))


def minimizers(records: DataFrame, k: int = 21, w: int = 11, *, seq: str = "seq") -> DataFrame:
    """The columns of records but seq, run_index, position and minimizer: in every window of w neighbouring words of k
    residues the one whose canonical form has the least MD5 digest, the leftmost of several; each place once.

    The place of a window's minimum never goes back, so a place is new if it differs from that of the window before.
    """
    rest = [c for c in records.columns if c != seq]
    runs = records.select(*rest, F.posexplode_outer(dna.actg_runs(F.upper(F.col(seq)))).alias("run_index", "run")).where(F.length("run") >= k + w - 1)
    words = F.transform(dna.kmers("run", k), lambda x, i: F.struct(F.md5(dna.canonical(x)).alias("h"), i.alias("position"), x.alias("minimizer")))
    least = lambda i: F.array_min(F.slice("words_", i, w))
    windows = runs.select(*rest, "run_index", words.alias("words_")).select(*rest, "run_index", F.transform(F.sequence(F.lit(1), F.size("words_") - w + 1), least).alias("windows_"))
    new = F.filter("windows_", lambda x, i: (i == 0) | (x["position"] != F.get("windows_", i - 1)["position"]))
    picked = windows.select(*rest, "run_index", F.explode_outer(new).alias("m")).where("m is not null")
    return picked.select(*rest, "run_index", F.col("m.position").alias("position"), F.col("m.minimizer").alias("minimizer"))


def blocked(records: DataFrame, order: list[str], by: tuple[str, ...], block: int) -> DataFrame:
    """records with block_, the number of the block of `block` values of order's first column (a number) that they are in."""
    return records.withColumn("block_", F.floor(F.col(order[0]) / block).cast("long"))


def merge_sequences(records: DataFrame, order: list[str], *by: str, seq: str = "seq") -> DataFrame:
    """All sequences of a group as one, in order. The result grows with the input; a group must fit a row. For groups of any
    size see merged_parts."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(seq).alias("s_"))))
    return records.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["s_"]), "").alias(seq))


def merged_parts(records: DataFrame, order: list[str], *by: str, seq: str = "seq", block: int = 1 << 16) -> DataFrame:
    """The merged sequence of each group in parts: by, part, merged_start (where the part begins in it) and seq, the
    sequences of records whose first order column, a number such as byte_start, lies in one block of values."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(seq).alias("s_"))))
    rows = blocked(records, order, by, block).groupBy(*by, "block_").agg(F.array_join(F.transform(parts, lambda p: p["s_"]), "").alias(seq))
    sizes = rows.select(*by, "block_", dna.dna_len(seq).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("block_").alias("block_of"), before.alias("merged_start"))
    same = [rows[c].eqNullSafe(starts[f"{c}_of"]) for c in by] + [rows["block_"].eqNullSafe(starts["block_of"])]
    return rows.join(starts, same).select(*by, F.col("block_").alias("part"), "merged_start", seq)


def running_length(records: DataFrame, order: list[str], *by: str, length: str = "dna_len", block: int = 1 << 16) -> DataFrame:
    """records with merged_len: how long the merged sequence is after each record.

    Sums run within blocks of values of order's first column, a number such as record_index or byte_start, and blocks are
    summed up: a window sees one block, or one row for each block of a group, never a group's records.
    """
    rows = blocked(records, order, by, block)
    local = F.sum(length).over(Window.partitionBy(*by, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(*by, "block_").agg(F.sum(length).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("block_").alias("block_of"), before.alias("before_"))
    same = [rows[c].eqNullSafe(base[f"{c}_of"]) for c in by] + [rows["block_"].eqNullSafe(base["block_of"])]
    out = rows.withColumn("local_", local).join(base, same)
    return out.withColumn("merged_len", F.col("local_") + F.col("before_")).select(*records.columns, "merged_len")


def throughput_stats(runs: DataFrame, *by: str, seconds: str = "seconds", n_bytes: str = "bytes") -> DataFrame:
    """Of repeated measurements: mean and population deviation of GB/s, and the coefficient of variation."""
    rate = F.col(n_bytes) / 1e9 / F.col(seconds)
    out = runs.groupBy(*by).agg(F.count("*").alias("repeats"), F.avg(rate).alias("mean_gbs"), F.stddev_pop(rate).alias("stdev_gbs"))
    return out.withColumn("cv", F.col("stdev_gbs") / F.col("mean_gbs"))
