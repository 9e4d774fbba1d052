"""Seeded sequence data as DataFrames: every value is a function of seed and record number, whatever the partitions."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sink import fasta_text, fastq_text

#: Residues by name of alphabet; the second is what takes a residue's place at the given chance.
ALPHABETS = {
    "dna": ("ACGT", ""),
    "mixed": ("ACGTacgt", ""),
    "dna_n": ("ACGT", "N"),
    "iupac": ("ACGT", "RYSWKMBDHVN"),
    "protein": ("ACDEFGHIKLMNPQRSTVWY", ""),
}


@dataclass(frozen=True)
class FastxGen:
    """What to generate. corrupt is one of bad_marker, short_quality, no_plus, truncated, and strikes a record with
    corrupt_chance."""

    format: str = "fasta"
    records: int = 1000
    mean_len: int = 150
    std_dev: float = 0.0
    seed: int = 42
    alphabet: str = "dna"
    custom: str | None = None
    other_chance: float = 0.05
    width: int = 0
    crlf: bool = False
    prefix: str = "record_"
    quality_low: str = "!"
    quality_high: str = "~"
    corrupt: str | None = None
    corrupt_chance: float = 0.1

    @classmethod
    def fasta(cls, records: int, mean_len: int) -> FastxGen:
        return cls(records=records, mean_len=mean_len)

    @classmethod
    def fastq(cls, records: int, mean_len: int) -> FastxGen:
        return cls("fastq", records, mean_len)

    @classmethod
    def illumina(cls, records: int) -> FastxGen:
        return cls("fastq", records, 150)

    @classmethod
    def pacbio(cls, records: int) -> FastxGen:
        return cls("fastq", records, 15_000, 1_500.0)

    @classmethod
    def wrapped_fasta(cls, records: int, mean_len: int, width: int = 60) -> FastxGen:
        return cls(records=records, mean_len=mean_len, width=width)

    @classmethod
    def protein(cls, records: int, mean_len: int) -> FastxGen:
        return cls(records=records, mean_len=mean_len, alphabet="protein")

    def with_(self, **changes) -> FastxGen:
        return replace(self, **changes)


def draw(seed: int, what: str, *at: Column) -> Column:
    """A number in [0, 1) that depends on seed, purpose and place only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), *at), 11) * F.lit(2.0**-53)


def letters(seed: int, what: str, number: Column, length: Column, alphabet: str, other: str = "", chance: float = 0.0) -> Column:
    """`length` letters of an alphabet; with a chance, one of `other` instead."""

    def letter(i: Column) -> Column:
        pick = F.substring(F.lit(alphabet), (draw(seed, what, number, i) * len(alphabet)).cast("int") + 1, F.lit(1))
        if not other or chance <= 0:
            return pick
        else_ = F.substring(F.lit(other), (draw(seed, what + "-other", number, i) * len(other)).cast("int") + 1, F.lit(1))
        return F.when(draw(seed, what + "-which", number, i) < chance, else_).otherwise(pick)

    return F.when(length > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), letter), "")).otherwise("")


def generate(spark: SparkSession, gen: FastxGen, partitions: int | None = None) -> DataFrame:
    """The true records: number, header, seq and quality (null for FASTA)."""
    rows = spark.range(0, gen.records, 1, partitions) if partitions else spark.range(gen.records)
    number = F.col("id")
    length: Column = F.lit(gen.mean_len)
    if gen.std_dev > 0:  # Box and Muller
        normal = F.sqrt(-2 * F.log(1 - draw(gen.seed, "radius", number))) * F.cos(2 * F.pi() * draw(gen.seed, "angle", number))
        length = F.greatest(F.lit(1), F.round(gen.mean_len + gen.std_dev * normal).cast("int"))
    main, other = (gen.custom, "") if gen.custom else ALPHABETS[gen.alphabet]
    out = rows.select(number.alias("number"), F.concat(F.lit(gen.prefix), number.cast("string")).alias("header"), length.alias("length"))
    out = out.withColumn("seq", letters(gen.seed, "base", F.col("number"), F.col("length"), main, other, gen.other_chance))
    scores = "".join(map(chr, range(ord(gen.quality_low), ord(gen.quality_high) + 1)))
    quality = letters(gen.seed, "quality", F.col("number"), F.col("length"), scores) if gen.format == "fastq" else F.lit(None).cast("string")
    return out.withColumn("quality", quality).select("number", "header", "seq", "quality")


def as_text(records: DataFrame, gen: FastxGen) -> DataFrame:
    """number and value, a record's lines; corrupt ones as asked for."""
    end = "\r\n" if gen.crlf else "\n"
    text = fasta_text(width=gen.width, crlf=gen.crlf) if gen.format == "fasta" else fastq_text(crlf=gen.crlf)
    if gen.corrupt:
        struck = draw(gen.seed, "corrupt", F.col("number")) < gen.corrupt_chance
        broken = {
            "bad_marker": F.concat(F.lit("!"), F.substring(text, F.lit(2), F.length(text))),
            "short_quality": F.substring(text, F.lit(1), F.length(text) - 1),
            "no_plus": F.regexp_replace(text, end + r"\+" + end, end),
            "truncated": F.substring(text, F.lit(1), (F.length(text) / 2).cast("int")),
        }[gen.corrupt]
        text = F.when(struck, broken).otherwise(text)
    return records.select("number", text.alias("value"))


def write(spark: SparkSession, gen: FastxGen, path: str, *, compression: str | None = None, partitions: int | None = None) -> None:
    """Part files of the generated records, in order of number."""
    writer = as_text(generate(spark, gen, partitions), gen).select("value").write.option("lineSep", "\r\n" if gen.crlf else "\n")
    (writer.option("compression", compression) if compression else writer).text(path)


def to_text(spark: SparkSession, gen: FastxGen) -> str:
    """All generated records as one string on the driver, for small inputs."""
    end = "\r\n" if gen.crlf else "\n"
    return "".join(r["value"] + end for r in as_text(generate(spark, gen), gen).orderBy("number").toLocalIterator())


def to_bytes(spark: SparkSession, gen: FastxGen) -> bytes:
    return to_text(spark, gen).encode()


def line_length_sweep(spark: SparkSession, records: int, lines: int, length: int, *, seed: int = 42, multiline: bool = True, other: bool = False) -> DataFrame:
    """number and value of FASTA records of `lines` lines of `length` residues, or the same on one line."""
    gen = FastxGen(records=records, mean_len=lines * length, seed=seed, width=length if multiline else 0, alphabet="dna_n" if other else "dna")
    return as_text(generate(spark, gen), gen)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("path")
    p.add_argument("-f", "--format", choices=("fasta", "fastq"), default="fasta")
    p.add_argument("-n", "--records", type=int, default=1000)
    p.add_argument("-l", "--mean-len", type=int, default=150)
    p.add_argument("-s", "--std-dev", type=float, default=0.0)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("-w", "--width", type=int, default=0)
    p.add_argument("-a", "--alphabet", choices=sorted(ALPHABETS), default="dna")
    p.add_argument("--prefix", default="record_")
    p.add_argument("-N", "--other-chance", type=float, default=0.05)
    p.add_argument("--crlf", action="store_true")
    args = vars(p.parse_args(argv))
    path = args.pop("path")
    write(SparkSession.builder.getOrCreate(), FastxGen(**args), path)


if __name__ == "__main__":
    main()
