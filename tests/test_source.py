"""Files through the data source: every way to cut or compress them gives the same rows."""

import bz2
import gzip
import lzma
import random
import zlib

import pytest
import zstandard

from strandlake.errors import DecompressionError
from strandlake.options import FastxOptions
from strandlake.sources.codecs import BGZF_END, compression_format, decoded_pieces, format_from_path, zstd_frames
from strandlake.sources.fastx import FastxReader, read_fastx
from strandlake.sources.sink import write_fasta, write_fastq


def reads(n, seed, all_at=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 30, 64, 150])
        out.append((f"r{i}", "".join(rng.choices("ACGTN", k=size)), "@" * size if all_at else "".join(rng.choices("@+!I", k=size))))
    return out


def fastq(rows, end="\n"):
    return "".join(f"@{h}{end}{s}{end}+{end}{q}{end}" for h, s, q in rows).encode()


def fasta(rows, width=60, end="\n"):
    return "".join(f">{h}{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for h, s, _ in rows).encode()


def bgzf(data, block):
    out = b""
    for i in range(0, len(data), block):
        raw = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = raw.compress(data[i : i + block]) + raw.flush()
        tail = zlib.crc32(data[i : i + block]).to_bytes(4, "little") + len(data[i : i + block]).to_bytes(4, "little")
        out += bytes.fromhex("1f8b08040000000000ff0600424302 00".replace(" ", "")) + (len(body) + 25).to_bytes(2, "little") + body + tail
    return out + BGZF_END


def rows_of(spark, path, split, columns=("header", "seq", "quality")):
    df = read_fastx(spark, str(path), columns=[*columns, "byte_start"], split_bytes=split)
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("all_at", [False, True])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_of_plain_files(spark, tmp_path, end, all_at):
    rows = reads(60, 1, all_at)
    path = tmp_path / "a.fq"
    path.write_bytes(fastq(rows, end))
    for split in (137, 1000, 1 << 20):
        assert rows_of(spark, path, split) == sorted(rows), split
    path = tmp_path / "a.fa"
    path.write_bytes(fasta(rows, 20, end))
    for split in (97, 1000, 1 << 20):
        assert rows_of(spark, path, split) == sorted((h, s, None) for h, s, _ in rows), split


def test_every_split_offset_owns_each_record_once(spark, tmp_path):
    """Ranges of every size, without Spark."""
    from pyspark.sql.types import _parse_datatype_string

    rows = reads(12, 3)
    for name, data in (("a.fq", fastq(rows)), ("a.fa", fasta(rows, 20))):
        path = tmp_path / name
        path.write_bytes(data)
        for split in range(1, 200, 7):
            reader = FastxReader(_parse_datatype_string("header string, seq string"), {"paths": str(path), "splitbytes": split})
            got = [r["header"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
            assert sorted(got) == sorted(h for h, _, _ in rows), (name, split)


def test_codecs(spark, tmp_path):
    rows = reads(200, 2)
    data = fastq(rows)
    half = len(data) // 2
    frames = [zstandard.ZstdCompressor(level=3).compress(data[i : i + 700]) for i in range(0, len(data), 700)]
    skippable = bytes.fromhex("502a4d18") + (5).to_bytes(4, "little") + b"hello"
    inputs = {
        "gzip": gzip.compress(data),
        "members": gzip.compress(data[:half]) + gzip.compress(data[half:]),
        "junk": gzip.compress(data) + b"\x01\x02\x03",
        "bgzf": bgzf(data, 900),
        "bgzf_no_end": bgzf(data, 900)[: -len(BGZF_END)],
        "zstd": zstandard.ZstdCompressor().compress(data),
        "frames": b"".join(frames),
        "pzstd": skippable + skippable.join(frames),
        "bzip2": bz2.compress(data[:half]) + bz2.compress(data[half:]),
        "xz": lzma.compress(data[:half]) + lzma.compress(data[half:]),
    }
    for name, content in inputs.items():
        path = tmp_path / name
        path.write_bytes(content)
        for split in (500, 1 << 20):
            assert rows_of(spark, path, split) == sorted(rows), (name, split)
    sniffed = [compression_format(inputs[n][:18]) for n in ("gzip", "bgzf", "zstd", "pzstd", "bzip2", "xz")]
    assert sniffed == ["gzip", "bgzf", "zstd", "pzstd", "bzip2", "xz"] and compression_format(data[:18]) is None
    assert format_from_path("x/y.fa.gz") == "gzip" and format_from_path("y.fa") is None
    with open(tmp_path / "frames", "rb") as f:
        assert len(zstd_frames(f, len(inputs["frames"]))) == len(frames)


def test_n26_bad_check_sum_fails(tmp_path):
    content = bytearray(gzip.compress(fastq(reads(50, 4))))
    content[-8] ^= 1
    path = tmp_path / "bad.gz"
    path.write_bytes(content)
    with pytest.raises(DecompressionError), open(path, "rb") as f:
        list(decoded_pieces(f, "gzip"))


def test_schema_is_pruned_and_index_is_dense(spark, tmp_path):
    from strandlake.operators.ordering import with_record_index

    rows = reads(100, 5)
    path = tmp_path / "a.fq"
    path.write_bytes(fastq(rows))
    df = read_fastx(spark, str(path), columns=["header", "record_index"], split_bytes=100)
    assert df.columns == ["header", "record_index"]
    assert [r["header"] for r in df.orderBy("record_index").collect()] == [h for h, _, _ in rows]
    split = with_record_index(read_fastx(spark, str(path), columns=["file", "header", "byte_start"], split_bytes=300), block_bytes=512)
    assert [(r["record_index"], r["header"]) for r in split.orderBy("record_index").collect()] == [(i, h) for i, (h, _, _) in enumerate(rows)]


def test_permissive_gives_good_rows_then_the_error(spark, tmp_path):
    path = tmp_path / "bad.fq"
    path.write_bytes(b"@a\nAC\n+\nII\n\nx\n@b\nGT\n+\nII\n")
    got = read_fastx(spark, str(path), columns=["header", "error"], mode="PERMISSIVE").collect()
    assert got[0]["header"] == "a" and got[1]["error"]["kind"] == "InvalidRecordStart" and got[1]["error"]["byte"] == ord("x")
    with pytest.raises(Exception, match="invalid record start"):
        read_fastx(spark, str(path), columns=["header"]).collect()


def test_empty_file_and_folder(spark, tmp_path):
    (tmp_path / "empty.fa").write_bytes(b"")
    (tmp_path / "one.fa").write_bytes(b">a\nACGT\n")
    assert read_fastx(spark, str(tmp_path)).count() == 1


def test_options_and_policies(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_bytes(b">test\nACGTNNNACGT\n>b\nNN\n")
    o = FastxOptions()
    assert o.config() == 131 and o.policy == "keep"
    assert o.keep_non_actg().and_dna_packed().policy == "split"
    assert o.dna_packed().keep_non_actg().policy == "keep"
    assert o.merge_records().ignore_dna().config() & 1 << 10
    get = lambda opt: read_fastx(spark, str(path), options=opt).orderBy("byte_start").collect()
    assert [r["seq"] for r in get(o.skip_non_actg())] == ["ACGTACGT", ""]
    assert [(r["seq"], r["run_start"], r["run_end"]) for r in get(o.split_non_actg())] == [("ACGT", 0, 4), ("ACGT", 7, 11)]
    both = get(o.split_non_actg().return_record())
    assert sorted((r["event"], r["seq"]) for r in both if r["byte_start"] == 0) == [("chunk", "ACGT"), ("chunk", "ACGT"), ("record", None)] or len(both) == 4
    assert [r["packed"]["words"][0] for r in get(o.dna_packed())] == [0b10110100, 0b10110100]
    with pytest.raises(Exception, match="invalid base 0x4e"):
        get(o.reject_non_actg())


def test_n21_merged_records(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_bytes(b">r1\nACGTNACGT\n>r2\nTGCAACGT\n>r3\nACGTACGT\n")
    o = FastxOptions().merge_records().compute_dna_len()
    get = lambda opt: read_fastx(spark, str(path), options=opt).first()
    assert get(o)["seq"] == "ACGTNACGTTGCAACGTACGTACGT" and get(o.skip_non_actg())["dna_len"] == 24
    assert get(o.and_dna_packed())["packed"]["len"] == 24 and "header" not in get(o).asDict()


def test_headers_alone_need_no_sequences(spark, tmp_path):
    rows = reads(30, 9)
    for name, data in (("a.fq", fastq(rows, "\r\n")), ("a.fa", fasta(rows, 20, "\r\n")), ("a.fa.gz", gzip.compress(fasta(rows)))):
        path = tmp_path / name
        path.write_bytes(data)
        got = read_fastx(spark, str(path), columns=["header", "byte_start", "byte_end"], split_bytes=200).orderBy("byte_start").collect()
        assert [r["header"] for r in got] == [h for h, _, _ in rows]


def test_writers_round_trip(spark, tmp_path):
    rows = reads(50, 6)
    df = spark.createDataFrame(rows, "header string, seq string, quality string")
    write_fastq(df, str(tmp_path / "q"), crlf=True)
    assert rows_of(spark, tmp_path / "q", 1 << 20) == sorted(rows)
    write_fasta(df, str(tmp_path / "a"), width=7, compression="gzip")
    assert rows_of(spark, tmp_path / "a", 1 << 20, ("header", "seq")) == sorted((h, s) for h, s, _ in rows)


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_a_record_longer_than_many_splits(spark, tmp_path, kind):
    """Each task looks at its own bytes once; only the first one reads the long record."""
    import time

    long = "ACGT" * 8_000_000
    text = f">long\n{long}\n>short\nAC\nGT\n" if kind == "fasta" else f"@long\n{long}\n+\n{'@' * len(long)}\n@short\nACGT\n+\n!!!!\n"
    path = tmp_path / "one"
    path.write_text(text)
    began = time.perf_counter()
    got = [(r["header"], r["dna_len"]) for r in read_fastx(spark, str(path), columns=["header", "dna_len"], split_bytes=1 << 20).collect()]
    assert sorted(got) == [("long", len(long)), ("short", 4)] and time.perf_counter() - began < 90


def test_pieces_of_any_size_of_long_fastq_records():
    from strandlake.sources.grammar import scan_pieces

    text = b"@a\nACGT\n+\n!!!!\n\n\n@b c\nAC\n+x\n@!\n@d\n\n+\n\n@e\nACG\n+\n@@@"
    for size in (1, 2, 3, 7, len(text)):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        rows = [(bytes(h), bytes(s), bytes(q)) for _, r in scan_pieces(iter(pieces)) for h, s, q in zip(*(x.to_pylist() if hasattr(x, "to_pylist") else x for x in (r.headers, r.seqs, r.quals or [])), strict=False)]
        assert rows == [(b"a", b"ACGT", b"!!!!"), (b"b c", b"AC", b"@!"), (b"d", b"", b""), (b"e", b"ACG", b"@@@")]
