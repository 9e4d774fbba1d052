"""From option sets to columns: residue policies, encodings, and records against runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..options import FastxOptions, Flag
from .aggregates import merge_sequences

ENCODERS = {"packed": dna.pack_dna, "columnar": dna.columnar_dna, "mask_non_actg": dna.mask_non_actg, "mask_n": dna.mask_n, "dna_len": dna.dna_len}


def source_columns(options: FastxOptions) -> list[str]:
    """What a scan must read for these options."""
    wanted = options.columns
    needs_seq = options.has(Flag.MERGE_RECORDS) or options.policy != "keep" or any(c in wanted for c in ("seq", "packed", "columnar", "mask_non_actg", "mask_n"))
    names = ["file", "format", "byte_start"]
    names += [c for c in ("header", "quality") if c in wanted]
    return names + (["seq"] if needs_seq else []) + (["dna_len"] if "dna_len" in wanted and not needs_seq else [])


def split_runs(records: DataFrame, seq: str = "seq") -> DataFrame:
    """A row for each maximal ACTG run of each record: run_index, run_start, run_end (in the sequence) and run.

    Records without a run give no row. All other columns stay, seq goes.
    """
    rest = [c for c in records.columns if c != seq]
    # A gap stands before each run, an empty one too, and a last one behind.
    parts = records.select(*rest, dna.actg_runs(seq).alias("runs_"), F.split(F.col(seq), "[ACGTacgt]+", -1).alias("gaps_"))
    sizes = F.zip_with("runs_", F.slice("gaps_", 1, F.greatest(F.size("gaps_") - 1, F.lit(0))), lambda r, g: (F.octet_length(r) + F.octet_length(g)).cast("long"))
    ended = parts.select(*rest, "runs_", sizes.alias("sizes_")).select(*rest, "runs_", dna.running_sums("sizes_").alias("ends_"))
    out = ended.select(*rest, F.posexplode_outer(F.arrays_zip(F.col("runs_").alias("run"), F.col("ends_").alias("run_end"))).alias("run_index", "r_")).where("r_ is not null")
    return out.select(*rest, "run_index", (F.col("r_.run_end") - F.octet_length("r_.run")).alias("run_start"), F.col("r_.run_end").alias("run_end"), F.col("r_.run").alias("run"))


def apply_options(records: DataFrame, options: FastxOptions) -> DataFrame:
    """The wanted columns under the option set's policy.

    keep: one row a record, all residues. skip: without other residues. reject: the query fails at another residue.
    With merge_records, one row a file: the sequences of its records in order, as the policy leaves them, and their
    encodings; what belongs to single records (header, quality) is not in it.
    split: one row a run (event chunk) or, with records asked for, one row a record with its runs as an array; with both,
    the chunks of a record come before it in (file, byte_start, event order) and `event` tells them apart.
    """
    wanted, policy = options.columns, options.policy
    key = [c for c in ("file", "byte_start") if c in records.columns]

    def encoded(df: DataFrame) -> DataFrame:
        for name in wanted:
            if name in ENCODERS and not (name == "dna_len" and "seq" not in df.columns):
                df = df.withColumn(name, ENCODERS[name]("seq"))
        return df.select(*key, *[c for c in ["event", "run_index", "run_start", "run_end", *wanted, "runs"] if c in df.columns])

    if options.has(Flag.MERGE_RECORDS):
        clean = {"keep": F.col("seq"), "reject": dna.reject_non_actg("seq")}.get(policy, dna.skip_non_actg("seq"))
        merged = merge_sequences(records.withColumn("seq", clean), ["byte_start"], "file")
        for name in wanted:
            if name in ENCODERS:
                merged = merged.withColumn(name, ENCODERS[name]("seq"))
        return merged.select("file", *[c for c in wanted if c in merged.columns])
    if policy == "skip":
        return encoded(records.withColumn("seq", dna.skip_non_actg("seq")))
    if policy == "reject":
        return encoded(records.withColumn("seq", dna.reject_non_actg("seq")))
    if policy == "keep":
        return encoded(records)
    chunks = encoded(split_runs(records).withColumn("event", F.lit("chunk")).withColumnRenamed("run", "seq"))
    if "quality" in chunks.columns:
        chunks = chunks.drop("quality")  # read after the runs, so known with the record only
    whole = records.withColumn("event", F.lit("record")).withColumn("runs", dna.actg_runs("seq"))
    whole = whole.select(*key, "event", *[c for c in wanted if c in ("header", "quality")], "runs")
    if options.has(Flag.CHUNK) and options.has(Flag.RECORD):
        return chunks.unionByName(whole, allowMissingColumns=True)
    return whole if options.has(Flag.RECORD) else chunks
