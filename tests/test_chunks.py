"""Files of one stream in chunks: the same rows, offsets and numbers as a whole scan, in bounded memory."""

import bz2
import gzip
import lzma
import random

import pytest
import zstandard

from strandlake.sources.chunks import chunks_of, read_chunked, read_parallel
from strandlake.sources.fastx import read_fastx
from strandlake.sources.grammar import scan_pieces, scanner

COLUMNS = ["file", "record_index", "format", "header", "seq", "quality", "dna_len", "byte_start", "byte_end"]


def odd_reads(rng, n):
    """Headers, sequences and qualities that begin with the markers of other lines."""
    out = []
    for _ in range(n):
        size = rng.choice([0, 1, 2, 5, 30])
        out.append(("".join(rng.choices("@+ab", k=rng.randrange(1, 6))), "".join(rng.choices("@+ACGT", k=size)), "".join(rng.choices("@+!I", k=size))))
    return out


def fastq(rows, end="\n", blanks=None):
    return "".join(f"@{h}{end}{s}{end}+{end}{q}{end}" + end * (blanks.randrange(3) if blanks else 0) for h, s, q in rows).encode()


def fasta(rows, end="\n", width=7):
    return "".join(f">{h}{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for h, s, _ in rows).encode()


def listed(x):
    return [bytes(v) for v in (x.to_pylist() if hasattr(x, "to_pylist") else x)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_chunks_of_any_size_from_pieces_of_any_size(end):
    for seed in range(12):
        rng = random.Random(seed)
        rows = odd_reads(rng, 14)
        safe = [(h.replace(">", ""), s.replace("@", "A").replace("+", "C"), "") for h, s, _ in rows]
        for data in (fastq(rows, end), fastq(rows, end, rng), fastq(rows, end)[: -len(end)] if rows[-1][2] else fastq(rows, end), fasta(safe, end)):
            whole = [(h, b) for _, r in scan_pieces(iter([data])) for h, b in zip(listed(r.headers), list(r.starts), strict=True)]
            for size in (1, 3, 17, 400):
                for chunk_bytes in (1, 20, 90, 10_000):
                    got, offset = [], 0
                    for i, (kind, crlf, chunk) in enumerate(chunks_of((data[a : a + size] for a in range(0, len(data), size)), chunk_bytes)):
                        assert (chunk.byte_start, chunk.first_record) == (offset, len(got))
                        assert len(chunk.content) <= 2 * chunk_bytes + 140
                        offset += len(chunk.content)
                        scan = scanner(kind, chunk.byte_start, crlf, i == 0)
                        for r in (scan.feed(chunk.content), scan.finish()):
                            got += list(zip(listed(r.headers), [int(b) for b in r.starts], strict=True))
                    assert offset == len(data) and got == whole


def test_the_cutter_holds_a_chunk_and_a_piece():
    """What has come in and not gone out never exceeds a chunk, a piece and a record."""
    piece, came = fastq([(f"r{i}", "ACGT" * 20, "IIII" * 20) for i in range(50)]), 0

    def pieces():
        nonlocal came
        for _ in range(200):
            came += len(piece)
            yield piece

    out = most = 0
    for _, _, chunk in chunks_of(pieces(), 30_000):
        most = max(most, came - out)
        out += len(chunk.content)
    assert out == came and most < 30_000 + 2 * len(piece) + 100


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("chunks")
    rng = random.Random(1)
    reads = [(f"r{i}", "".join(rng.choices("ACGTN", k=rng.randrange(150))), "") for i in range(3000)]
    reads = [(h, s, "".join(rng.choices("@+!I", k=len(s)))) for h, s, _ in reads]
    contents = {
        "a.fq.gz": gzip.compress(fastq(reads)),
        "b.fa.xz": lzma.compress(fasta(reads)),
        "c.fq.bz2": bz2.compress(fastq(reads[:500], "\r\n")),
        "d.fq.zst": zstandard.ZstdCompressor().compress(fastq(reads[:900])),
        "e.fa": fasta(reads[:100]),
        "f.fa.gz": gzip.compress(b">one\n" + b"ACGT" * 90_000 + b"\n>two\nAC\n"),
        "g.fa": b"",
    }
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    return folder


def rows_of(df, columns=COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_same_rows_offsets_and_numbers_as_whole_scans(spark, files):
    want = rows_of(read_fastx(spark, str(files), columns=COLUMNS))
    for chunk_bytes, parts in ((4_000, 5), (1 << 16, 2), (1 << 30, 1)):
        df = read_chunked(spark, str(files), columns=COLUMNS, chunk_bytes=chunk_bytes, parts=parts)
        assert rows_of(df) == want
    assert read_chunked(spark, str(files / "g.fa")).count() == 0


def test_many_tasks_parse_one_stream(spark, files):
    from pyspark.sql import functions as F

    df = read_chunked(spark, str(files / "a.fq.gz"), columns=["header"], chunk_bytes=8_000, parts=6)
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) < 3000 / 3
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_parallel_reads_cut_each_kind_its_own_way(spark, files):
    columns = [c for c in COLUMNS if c != "record_index"]
    want = rows_of(read_fastx(spark, str(files), columns=columns), columns)
    df = read_parallel(spark, str(files), columns=columns, split_bytes=5_000, chunk_bytes=9_000)
    assert rows_of(df, columns) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "fastx_chunks" in plan and "Union" in plan


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_errors_are_those_of_whole_scans(spark, tmp_path, chunk_bytes):
    good = fastq([(f"r{i}", "ACGT" * 5, "I" * 20) for i in range(40)])
    torn = gzip.compress(fastq([(f"t{i}", "".join(random.Random(i).choices("ACGT", k=400)), "I" * 400) for i in range(400)]))
    inputs = {
        "blank.fq": good + b"\n\nx\n@b\nGT\n+\nII\n" + good,
        "start.fq": b"!" + good,
        "cut.fq": good + b"@x\nACGT\n+",
        "torn.gz": torn[: len(torn) // 2],
        "sum.gz": torn[:-8] + b"\0" * 8,
        "fine.gz": gzip.compress(good),
    }
    for name, data in inputs.items():
        (tmp_path / name).write_bytes(data)
    columns = ["file", "header", "byte_start", "error"]
    for name in inputs:
        path = str(tmp_path / name)
        want = rows_of(read_fastx(spark, path, columns=columns, mode="PERMISSIVE"), columns)
        assert rows_of(read_chunked(spark, path, columns=columns, mode="PERMISSIVE", chunk_bytes=chunk_bytes), columns) == want, name
        if name != "fine.gz":
            with pytest.raises(Exception, match="invalid record start|end of file|decompression"):
                read_chunked(spark, path, columns=["header"], chunk_bytes=chunk_bytes).collect()


def test_options_apply_to_chunks(spark, files):
    from strandlake.options import FastxOptions

    options = FastxOptions().skip_non_actg()
    want = rows_of(read_fastx(spark, str(files / "a.fq.gz"), options=options), ["header", "seq"])
    assert rows_of(read_chunked(spark, str(files / "a.fq.gz"), options=options, chunk_bytes=5_000), ["header", "seq"]) == want
