"""Filters in the scan, numbers from counts, and inputs that can't be read."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from strandlake.operators import aggregates as agg
from strandlake.sources.fastx import FilteringReader, read_fastx, read_numbered
from strandlake.sources.filters import column_of, split_filters
from strandlake.sources.sink import write_fastx

COLUMNS = ["file", "format", "header", "seq", "dna_len", "byte_start"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("filters")
    fq = "".join(f"@r{i} x\n{'ACGT' * (i % 9)}\n+\n{'IIII' * (i % 9)}\n" for i in range(500))
    (path / "a.fq").write_text(fq)
    (path / "b.fq.gz").write_bytes(gzip.compress(fq.replace("@r", "@s").encode()))
    (path / "c.fa").write_text("".join(f">t{i}\r\n{'AC' * (i % 5)}\r\nGT\r\n" for i in range(300)))
    (path / "d.fa").write_bytes(b">caf\xe9\nAC\n>plain\nACG\n")
    return path


CONDITIONS = [
    "header = 'r7 x'",
    "header in ('r7 x', 's9 x', 'none')",
    "header not in ('r7 x', 's9 x')",
    "header like 'r1%'",
    "header like '%9 x' and dna_len > 20",
    "header like '%2%'",
    "not (header like 'r%')",
    "header <= 'r2' and header > 'r1'",
    "header = 'caf�'",
    "format = 'fasta' and dna_len in (2, 4)",
    "format <> 'fasta'",
    "dna_len between 8 and 12",
    "dna_len != 0 and byte_start < 2000",
    "dna_len = 0 or header = 't3'",
    "header is null",
    "header is not null and upper(header) = 'R5 X'",
    "dna_len <=> 12",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_same_rows_as_without(spark, folder, condition):
    rows = lambda push: sorted(map(tuple, read_fastx(spark, str(folder), columns=COLUMNS, split_bytes=3000, push_filters=push).where(condition).collect()))
    assert rows(True) == rows(False)


def test_rows_are_dropped_before_they_become_columns(spark, folder):
    schema = read_fastx(spark, str(folder), columns=COLUMNS).schema
    reader = FilteringReader(schema, {"paths": str(folder)})
    rest = reader.pushFilters([ds.StringStartsWith(("header",), "r1"), ds.GreaterThan(("dna_len",), 20), ds.IsNotNull(("seq",)), ds.EqualTo(("file",), str(folder / "a.fq"))])
    assert [type(f) for f in rest] == [ds.IsNotNull]
    parts = reader.partitions()
    assert {p.path for p in parts} == {str(folder / "a.fq")}
    got = [r["header"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == [f"r{i} x" for i in range(500) if str(i).startswith("1") and i % 9 > 5]


def test_the_plan_has_no_filter_left(spark, folder):
    df = read_fastx(spark, str(folder), columns=["header", "dna_len"], push_filters=True).where("dna_len > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "(dna_len" not in plan.replace("isnotnull(dna_len", "") or "Filter (isnotnull" in plan
    assert df.count() == read_fastx(spark, str(folder), columns=["header", "dna_len"]).where("dna_len > 3").count()


def test_what_can_be_tested():
    good = [ds.EqualTo(("format",), "fasta"), ds.In(("dna_len",), (1, 2)), ds.Not(ds.LessThan(("byte_end",), 5)), ds.StringContains(("header",), "é")]
    bad = [ds.EqualTo(("seq",), "A"), ds.EqualTo(("header",), "�"), ds.EqualTo(("dna_len",), 1.5), ds.EqualNullSafe(("header",), None), ds.StringContains(("file",), "x"), ds.Not(ds.EqualTo(("record_index",), 1)), ds.EqualTo(("error", "kind"), "Io")]
    assert split_filters(good + bad) == (good, bad) and column_of(good[2]) == "byte_end"


def test_numbers_by_counts_equal_those_of_whole_files(spark, folder):
    columns = ["file", "header", "record_index"]
    want = sorted(map(tuple, read_fastx(spark, str(folder), columns=columns).collect()))
    for split in (200, 1000, 1 << 20):
        df = read_numbered(spark, str(folder), columns=columns, split_bytes=split)
        assert sorted(map(tuple, df.collect())) == want
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_filtered_records(spark, folder):
    df = read_fastx(spark, str(folder / "a.fq"), columns=["header", "record_index", "dna_len"], push_filters=True).where("dna_len = 8")
    assert sorted(r["record_index"] for r in df.collect()) == list(range(2, 500, 9))


def test_numbers_over_blocks(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("r"), "id").alias("header"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("quality")).coalesce(1)
    write_fastx(rows, str(tmp_path / "out"), compression="bgzf", block_bytes=2000)
    got = read_numbered(spark, str(tmp_path / "out"), columns=["header", "record_index"], split_bytes=700).collect()
    assert all(r["header"] == f"r{r['record_index']}" for r in got) and len(got) == 5000


def test_missing_unreadable_and_torn_files_in_one_read(spark, tmp_path):
    good = b"@a\nAC\n+\nII\n@b\nAC\n+\nII\n"
    (tmp_path / "good.fq").write_bytes(good)
    (tmp_path / "torn.fq.gz").write_bytes(gzip.compress(good)[:-9])
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "link.fq").symlink_to(tmp_path / "nowhere")
    paths = [str(tmp_path / "good.fq"), str(tmp_path / "torn.fq.gz"), str(tmp_path / "none.fq"), str(tmp_path / "folder")]
    rows = read_fastx(spark, paths, columns=["file", "header", "error"], mode="PERMISSIVE").collect()
    kinds = {os.path.basename(r["file"]): r["error"]["kind"] for r in rows if r["error"]}
    assert kinds == {"torn.fq.gz": "Decompression", "none.fq": "Io", "link.fq": "Io"}
    assert sorted(r["header"] for r in rows if "good" in r["file"]) == ["a", "b"]
    message = next(r["error"]["message"] for r in rows if "none" in r["file"])
    assert message.startswith("I/O error: ") and "none.fq" in message
    with pytest.raises(Exception, match="no such file or folder"):
        read_fastx(spark, paths, columns=["header"]).collect()


def test_stats_of_uris_patterns_and_bad_paths(spark, folder, tmp_path):
    (tmp_path / "bad.fa").write_bytes(b"no\n")
    rows = agg.file_stats(spark, [f"file://{folder}/a.fq", f"{folder}/*.fa", str(tmp_path / "bad.fa"), str(tmp_path / "none")]).collect()
    got = {os.path.basename(r["file"]): tuple(r)[1:] for r in rows}
    lengths = np.array([4 * (i % 9) for i in range(500)])
    assert got["a.fq"] == ("fastq", 500, lengths.sum(), 0, pytest.approx(lengths.mean()), 32)
    assert got["d.fa"][:3] == ("fasta", 2, 5)
    assert got["bad.fa"] == got["none"] == ("ERR", None, None, None, None, None)


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i:02d}.fa").write_bytes(b">r%d\nACGT\n" % i)
    (tmp_path / "zz.fa").write_bytes(b"".join(b">z%d\nAC\n" % i for i in range(20_000)))
    df = read_fastx(spark, str(tmp_path), columns=["file", "header"])
    assert df.rdd.getNumPartitions() < 10 and df.count() == 20_060 and df.select("file").distinct().count() == 61
    reader = FilteringReader(df.schema, {"paths": str(tmp_path), "splitbytes": "100000000", "parallelism": "4"})
    bundles = reader.partitions()
    assert len(bundles) <= 5 and sum(len(getattr(b, "parts", [b])) for b in bundles) == 61
    numbered = read_numbered(spark, str(tmp_path), columns=["file", "header", "record_index"])
    assert numbered.groupBy("file").agg((F.max("record_index") + 1 == F.count("*")).alias("dense")).where("not dense").count() == 0
