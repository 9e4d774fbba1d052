"""The data source's writer: what it writes can be split, and a job leaves all of its records once or none."""

import bz2
import gzip
import lzma
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from strandlake.sources.codecs import BGZF_END, make_encoder, zstd_frames
from strandlake.sources.fastx import FastxReader, read_fastx
from strandlake.sources.sink import write_fastx

UNPACK = {"none": bytes, "bgzf": gzip.decompress, "gzip": gzip.decompress, "bzip2": bz2.decompress, "xz": lzma.decompress, "zstd": lambda b: zstandard.ZstdDecompressor().stream_reader(b, read_across_frames=True).read()}


@pytest.fixture(scope="module")
def records(spark):
    seq = F.repeat(F.substring(F.md5(F.col("id").cast("string")), 1, (F.col("id") % 33).cast("int")), 3)
    return spark.range(2000).select(F.concat(F.lit("r"), "id").alias("header"), seq.alias("seq"), seq.alias("quality")).repartition(3)


def parts_of(path):
    return sorted(f for f in os.listdir(path) if f.startswith("part-"))


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("compression", list(UNPACK))
@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_round_trip_and_other_decoders(spark, tmp_path, records, compression, kind):
    path, columns = str(tmp_path / "out"), ("header", "seq", "quality")[: 3 if kind == "fastq" else 2]
    write_fastx(records, path, kind=kind, compression=compression, block_bytes=3000, width=0 if kind == "fastq" else 10, crlf=kind == "fastq")
    assert len(parts_of(path)) == 3 and sorted(set(os.listdir(path)) - set(parts_of(path))) == ["_SUCCESS"]
    assert rows_of(read_fastx(spark, path, columns=list(columns)), *columns) == rows_of(records, *columns)
    assert rows_of(read_fastx(spark, path, columns=list(columns), split_bytes=4000), *columns) == rows_of(records, *columns)
    for name in parts_of(path):
        with open(f"{path}/{name}", "rb") as f:
            data = f.read()
        text = UNPACK[compression](data)
        assert text[:1] == (b">" if kind == "fasta" else b"@") and text.endswith(b"\n")
        reader = FastxReader(read_fastx(spark, path, columns=["header"]).schema, {"paths": f"{path}/{name}", "splitbytes": 4000})
        assert (len(reader.partitions()) > 3) == (compression in ("none", "bgzf", "zstd"))
        if compression == "bgzf":
            assert data.endswith(BGZF_END)
        if compression == "zstd":
            with open(f"{path}/{name}", "rb") as f:
                assert len(zstd_frames(f, len(data))) == -(-len(text) // 3000)


def test_append_overwrite_and_empty(spark, tmp_path, records):
    path = str(tmp_path / "out")
    write_fastx(records, path)
    write_fastx(records, path)
    assert read_fastx(spark, path, columns=["header"]).count() == 4000
    write_fastx(records.where("header = 'r7'"), path, mode="overwrite")
    assert [r["header"] for r in read_fastx(spark, path, columns=["header"]).collect()] == ["r7"] and len(parts_of(path)) == 1
    write_fastx(records.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"]


def test_a_failing_job_leaves_what_was_there(spark, tmp_path, records):
    path = str(tmp_path / "out")
    write_fastx(records, path)
    before = sorted(os.listdir(path))
    bad = records.withColumn("seq", F.when(F.col("header") == "r1999", F.raise_error(F.lit("no"))).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="no"):
        write_fastx(bad, path, mode="overwrite")
    assert sorted(os.listdir(path)) == before


def test_wrong_columns_and_names_are_refused(spark, tmp_path, records):
    with pytest.raises(Exception, match="one column of text"):
        records.write.format("fastx").mode("append").save(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no such compression"):
        make_encoder("lzo")


@pytest.mark.parametrize("name", list(UNPACK))
def test_encoders_take_pieces_of_any_size(name):
    data = os.urandom(200_000) + b"A" * 200_000
    for step in (1 << 10, 70_000, 400_000):
        encoder = make_encoder(name, 65_280 if name in ("bgzf", "zstd") else None)
        out = b"".join(encoder.write(data[i : i + step]) for i in range(0, len(data), step)) + encoder.finish()
        assert UNPACK[name](out) == data
