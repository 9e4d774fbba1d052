"""Bit planes are unpacked by words, not residue by residue."""

from test_spread_reads import plan_of

from strandlake.functions import dna


def test_unpacks_every_length_and_full_words(spark):
    seqs = ["", *("ACGTTGCAAGGT" * 17)[:200:13], *[b * n for b in "ACGT" for n in (1, 31, 32, 33, 63, 64, 65, 128, 129)], *[("GATC" * 50)[:n] for n in range(0, 140, 7)]]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").withColumn("c", dna.columnar_dna("seq"))
    assert all(s == v for s, v in df.select("seq", dna.unpack_columnar("c")).collect())
    assert spark.range(1).selectExpr("cast(null as struct<len: long, hi: array<long>, lo: array<long>>) as c").select(dna.unpack_columnar("c")).collect() == [(None,)]


def test_no_step_for_each_residue(spark):
    plan = plan_of(spark.createDataFrame([("ACGT",)], "seq string").select(dna.unpack_columnar(dna.columnar_dna("seq"))))
    assert "sequence(1, 64" not in plan and "conv(" in plan
