"""Where FASTQ records start, wherever a reader begins, with sequences and qualities that begin like other lines."""

import random

import pytest
from pyspark.sql.types import StringType, StructField, StructType
from test_chunks import fastq, odd_reads

from strandlake.operators.parse import split_input
from strandlake.sources.fastx import FastxReader
from strandlake.sources.grammar import FastqSync, find_record_start, irregular_record_start

SCHEMA = StructType([StructField(n, StringType()) for n in ("header", "seq", "quality")])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("blanks", [False, True])
def test_each_record_once_whatever_the_ranges(tmp_path, end, blanks):
    path = tmp_path / "a.fq"
    for seed in range(6):
        rng = random.Random(seed)
        rows = odd_reads(rng, 14)
        data = fastq(rows, end, rng if blanks else None)
        path.write_bytes(data)
        for split in range(1, len(data), 3):
            reader = FastxReader(SCHEMA, {"paths": str(path), "splitbytes": split})
            got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
            assert sorted(got) == sorted(rows), (seed, split)


def test_every_offset_finds_the_next_header():
    rows = [(f"h{i}", "@+AC"[i % 4] * (i % 7), "+@II"[i % 4] * (i % 7)) for i in range(20)]
    data = fastq(rows)
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(fastq([r])))
    for pos in range(len(data) - 1):
        want = next((s for s in starts[1:-1] if s > pos), None)
        assert find_record_start("fastq", data, pos) == want, pos


def test_two_readings_that_both_fit_are_told_apart_by_the_end():
    """Headers and plus lines of one form, and sequences like plus lines: only where the input ends decides."""
    data = b"@a\n+\n+\n@\n@b\n+\n+\n@\n"
    assert find_record_start("fastq", data, 0) == len(data) // 2
    sync = FastqSync()
    sync.line(0, b"x")
    assert sync.start is None and not sync.lost


def test_irregular_records_fall_back_to_the_marker():
    data = b"@a\nACGT\n-\nII\n@b\nAC\n-\nIIII\n"
    assert find_record_start("fastq", data, 1) == irregular_record_start(data, 1) == data.index(b"@b")
    assert split_input(data, 3) == [data[:13], data[13:]]


def test_fasta_headers_begin_a_line():
    assert find_record_start("fasta", b">a\nAC>x\n>b\n", 0) == 8
    assert find_record_start("fasta", b">a\nACGT", 0) is None
