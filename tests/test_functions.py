"""Column functions against plain Python, byte by byte."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import dna
from strandlake.operators import aggregates as agg
from strandlake.operators.parse import parse_fastx
from strandlake.operators.project import split_runs


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def words(bits, width, size):
    out = [0] * (len(bits) // width + 1)
    for i, b in enumerate(bits):
        out[i // width] |= b << (size * (i % width))
    return [signed(w) for w in out]


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(1)
    fixed = ["", "A", "N", "n-*U", "é漢N", "\r", "G" * 31, "G" * 32, "t" * 33, "C" * 63, "G" * 64, "T" * 65, "G" * 128]
    return fixed + ["".join(rng.choices("ACGTacgtNnRU-", k=rng.randint(0, 200))) for _ in range(60)]


def test_n14_n15_n23_encodings(spark, sequences):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "i int, seq string")
    row = df.select("i", dna.pack_dna("seq").alias("p"), dna.columnar_dna("seq").alias("c"), dna.mask_non_actg("seq").alias("m"), dna.mask_n("seq").alias("n"), dna.actg_len("seq").alias("a"), dna.first_non_actg("seq").alias("f"), dna.is_actg("seq").alias("ok"), dna.packed_bytes(dna.pack_words("seq")).alias("raw"), dna.words_from_bytes(dna.packed_bytes(dna.pack_words("seq"))).alias("back"))
    for r in row.collect():
        raw = sequences[r["i"]].encode()
        codes = [b >> 1 & 3 for b in raw]
        other = [int(chr(b) not in "ACGTacgt") for b in raw]
        assert r["back"] == r["p"]["words"]
        assert r["p"]["len"] == len(raw) and r["p"]["words"] == words(codes, 32, 2)
        assert r["c"]["hi"] == words([c >> 1 for c in codes], 64, 1) and r["c"]["lo"] == words([c & 1 for c in codes], 64, 1)
        assert r["m"]["words"] == words(other, 64, 1)
        assert r["n"]["words"] == words([int(b in b"Nn") for b in raw], 64, 1)
        assert r["a"] == other.count(0) and r["ok"] == (1 not in other)
        assert r["raw"] == b"".join((w & (1 << 64) - 1).to_bytes(8, "little") for w in words(codes, 32, 2))
        if 1 in other and sequences[r["i"]].isascii():
            assert r["f"] == other.index(1)


def test_unpack_and_random_access(spark, sequences):
    rows = [(i, s) for i, s in enumerate(sequences) if s.isascii()]
    df = spark.createDataFrame(rows, "i int, seq string").withColumn("p", dna.pack_dna("seq")).withColumn("c", dna.columnar_dna("seq")).withColumn("m", dna.mask_n("seq"))
    at = F.lit(40)
    got = df.select("seq", dna.unpack_dna("p").alias("u"), dna.unpack_columnar("c").alias("v"), dna.base_at(F.col("p.words"), at).alias("b"), dna.columnar_code_at("c", at).alias("k"), dna.mask_at("m", at).alias("n"))
    for r in got.collect():
        decoded = "".join("ACTG"[ord(x) >> 1 & 3] for x in r["seq"])
        assert r["u"] == r["v"] == decoded
        if len(r["seq"]) > 40:
            assert r["b"] == decoded[40] and "ACTG"[r["k"]] == decoded[40] and r["n"] == (r["seq"][40] in "Nn")


def runs_of(seq):
    out, start = [], None
    for i, x in enumerate([*seq, "\0"]):
        if x in "ACGTacgt":
            start = i if start is None else start
        elif start is not None:
            out.append((start, i, seq[start:i]))
            start = None
    return out


def test_n16_runs(spark, sequences):
    ascii_only = [(i, s) for i, s in enumerate(sequences) if s.isascii()]
    df = spark.createDataFrame(ascii_only, "i int, seq string")
    got = {}
    for r in split_runs(df).orderBy("i", "run_index").collect():
        got.setdefault(r["i"], []).append((r["run_start"], r["run_end"], r["run"]))
    for i, s in ascii_only:
        assert got.get(i, []) == runs_of(s)
    skipped = {r["i"]: r["s"] for r in df.select("i", dna.skip_non_actg("seq").alias("s")).collect()}
    assert all(skipped[i] == "".join(x for _, _, x in runs_of(s)) for i, s in ascii_only)


def test_two_separators_at_every_position(spark):
    base = "ACGT" * 10
    rows = [(f"{i}-{j}", base[:i] + "N" + base[i + 1 : j] + "N" + base[j + 1 :]) for i in range(0, 40, 3) for j in range(i + 1, 40, 3)]
    df = spark.createDataFrame(rows, "i string, seq string")
    got = {r["i"]: r["r"] for r in df.select("i", dna.actg_runs("seq").alias("r")).collect()}
    assert all(got[i] == [x for _, _, x in runs_of(s)] for i, s in rows)


def test_kmers_and_minimizers(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=120)) for _ in range(20)] + ["ACG", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, seq string")
    comp = str.maketrans("ACGT", "TGCA")
    expected = {}
    for s in seqs:
        for _, _, r in runs_of(s):
            for j in range(len(r) - 3):
                w = min(r[j : j + 4], r[j : j + 4].translate(comp)[::-1])
                expected[w] = expected.get(w, 0) + 1
    assert {r["kmer"]: r["n"] for r in agg.kmer_counts(df, 4).collect()} == expected
    picked = agg.minimizers(df, 5, 4).collect()
    assert picked and all(seqs[r["i"]].find(r["minimizer"]) >= 0 for r in picked)
    for i, s in enumerate(seqs):
        for number, (_, _, run) in enumerate(runs_of(s)):
            places = sorted(r["position"] for r in picked if r["i"] == i and r["run_index"] == number)
            windows = range(len(run) - 5 - 4 + 2)
            assert all(any(w <= p < w + 4 for p in places) for w in windows)
            assert bool(places) == (len(run) >= 8)


@pytest.mark.parametrize("k", [1, 4, 21])
def test_kmers_of_long_runs(spark, k):
    rng = random.Random(7)
    runs = ["".join(rng.choices("ACGT", k=n)) for n in (0, 1, k - 1, k, 511, 512, 513, 512 + k, 5000)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, run string").select("i", dna.kmers("run", k).alias("w")).collect()
    assert all(r["w"] == [runs[r["i"]][j : j + k] for j in range(len(runs[r["i"]]) - k + 1)] for r in got)


def test_long_records_take_linear_time(spark):
    import time

    took = []
    for n in (200_000, 200_000, 1_600_000):
        began = time.perf_counter()
        df = spark.createDataFrame([("ACGTTGCA" * (n // 8),)], "seq string")
        assert agg.kmer_counts(df, 11).agg(F.sum("n")).first()[0] == n - 10
        assert df.select(F.size(dna.pack_words("seq"))).first()[0] == n // 32 + 1
        took.append(time.perf_counter() - began)
    assert took[2] < 30 * max(took[1], 0.5)


def test_aggregates(spark):
    df = spark.createDataFrame([("f", "a", "AAC", 0), ("f", "b", "", 9), ("g", "a", "NNGT", 0)], "file string, header string, seq string, byte_start long")
    df = df.withColumn("dna_len", dna.dna_len("seq"))
    stats = {r["file"]: r for r in agg.seq_stats(df).collect()}
    assert (stats["f"]["num_seqs"], stats["f"]["sum_len"], stats["f"]["min_len"], stats["f"]["avg_len"], stats["f"]["max_len"]) == (2, 3, 0, 1.5, 3)
    assert agg.base_histogram(df).first().asDict() == {"a": 2, "c": 1, "t": 1, "g": 1}
    assert agg.totals(df).first().asDict() == {"n_records": 3, "n_bases": 7, "n_actg": 5}
    assert {r["file"]: r["seq"] for r in agg.merge_sequences(df, ["byte_start"], "file").collect()} == {"f": "AAC", "g": "NNGT"}
    empty = df.where("false")
    assert agg.totals(empty).first().asDict() == {"n_records": 0, "n_bases": 0, "n_actg": 0}


def test_file_stats_reports_missing_files(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">a\nACGT\n")
    got = {r["format"]: r["num_seqs"] for r in agg.file_stats(spark, [str(tmp_path / "a.fa"), str(tmp_path / "none")]).collect()}
    assert got == {"fasta": 1, "ERR": None}


def test_parse_column(spark):
    import gzip

    rows = [(1, b">a\nAC\nGT\n"), (2, None), (3, b""), (4, gzip.compress(b"@q\nA\n+\nI\n")), (5, b"nonsense")]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = parse_fastx(df, "content", keys=("id",), columns=("header", "seq", "error"), mode="PERMISSIVE", decompress=True).orderBy("id").collect()
    assert [(r["id"], r["header"], r["seq"]) for r in got] == [(1, "a", "ACGT"), (4, "q", "A"), (5, None, None)]
    assert got[2]["error"]["kind"] == "InvalidRecordStart"
    with pytest.raises(ValueError, match="named like"):
        parse_fastx(df.withColumnRenamed("id", "seq"), "content", keys=("seq",))


def test_formats_of_contents(spark):
    import bz2
    import gzip
    import lzma

    import zstandard

    from strandlake.functions.formats import compression_format, sequence_format
    from strandlake.sources.codecs import BGZF_END
    from strandlake.sources.codecs import compression_format as sniffed

    data = b">a\nACGT\n"
    contents = [data, gzip.compress(data), BGZF_END, zstandard.compress(data), bytes.fromhex("5f2a4d1800000000"), bz2.compress(data), lzma.compress(data), b"", b"@", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, content binary")
    rows = df.select("i", compression_format("content").alias("c"), sequence_format("content").alias("s")).orderBy("i").collect()
    assert [r["c"] for r in rows] == [sniffed(c[:18]) if c else None for c in contents]
    assert [r["s"] for r in rows] == ["fasta", None, None, None, None, None, None, None, "fastq", None]


@pytest.mark.parametrize("parts", [1, 2, 7, 16])
def test_input_in_memory_in_parallel(spark, parts):
    import gzip

    from strandlake.operators.parse import parse_in_parallel

    data = b"@read1\nACGTACGT\n+\n@@@@++++\n@read2\nTTTTAAAA\n+\n+@+@+@+@\n@read3\nCCCCCCCC\n+\n@@@@@@@@\n"
    for content in (data, gzip.compress(data)):
        got = parse_in_parallel(spark, content, parts).collect()
        assert sorted(r["header"] for r in got) == ["read1", "read2", "read3"] and sum(r["dna_len"] for r in got) == 24


def test_throughput(spark):
    df = spark.createDataFrame([("a", 1.0, 2_000_000_000), ("a", 2.0, 2_000_000_000), ("b", 1.0, 1_000_000_000)], "name string, seconds double, bytes long")
    got = {r["name"]: r for r in agg.throughput_stats(df, "name").collect()}
    assert (got["a"]["mean_gbs"], got["a"]["stdev_gbs"], round(got["a"]["cv"], 6), got["b"]["cv"]) == (1.5, 0.5, round(1 / 3, 6), 0.0)


def test_runs_of_any_bytes_and_many_of_them(spark):
    """Offsets are those of the sequence whatever the gaps hold, and 60,000 runs of a record take little time."""
    import re
    import time

    from strandlake.operators.project import split_runs

    texts = ["AC\x01GT", "\x01\x02ACGT\x01", "", "NN", "é A é C", "ACGT", "\tA\nC", "aN" * 1500 + "GG"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, seq string")
    got = sorted((r["k"], r["run_index"], r["run_start"], r["run_end"], r["run"]) for r in split_runs(df).collect())
    expected = [(k, i, m.start(), m.end(), m[0].decode()) for k, t in enumerate(texts) for i, m in enumerate(re.finditer(rb"[ACGTacgt]+", t.encode()))]
    assert got == expected
    many = spark.createDataFrame([(1, "ACN" * 60_000)], "k long, seq string")
    began = time.perf_counter()
    last = split_runs(many).orderBy(F.desc("run_index")).first()
    assert (last["run_start"], last["run_end"]) == (179_997, 179_999) and time.perf_counter() - began < 60


def test_minimizers_of_long_runs_like_a_plain_scan(spark):
    import hashlib
    import random

    from strandlake.operators.aggregates import minimizers

    rng = random.Random(4)
    seq = "".join(rng.choices("ACGTacgt", k=6000)) + "N" + "A" * 400 + "NNN" + "".join(rng.choices("ACGT", k=30))
    expected, index = [], 0
    for index, run in enumerate(seq.upper().replace("N", " ").split()):
        def digest(i, run=run):
            w = run[i : i + 21]
            return hashlib.md5(min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))).encode()).hexdigest()

        places = {min(range(at, at + 11), key=lambda i: (digest(i), i)) for at in range(len(run) - 30)}
        expected += [(index, p, run[p : p + 21]) for p in places]
    got = [(r["run_index"], r["position"], r["minimizer"]) for r in minimizers(spark.createDataFrame([(seq,)], "seq string")).collect()]
    assert sorted(got) == sorted(expected)


def test_running_length_and_parts_across_blocks(spark):
    from strandlake.operators.aggregates import merge_sequences, merged_parts, running_length

    rows = [(f, i * 3, "ACGT" * (i % 5)) for f in ("x", "y", None) for i in range(40)]
    df = spark.createDataFrame(rows, "file string, byte_start long, seq string").withColumn("dna_len", F.octet_length("seq"))
    got = {(r["file"], r["byte_start"]): r["merged_len"] for r in running_length(df, ["byte_start"], "file", block=16).collect()}
    for f in ("x", "y", None):
        total = 0
        for _, at, seq in (r for r in rows if r[0] == f):
            total += len(seq)
            assert got[f, at] == total
    whole = {r["file"]: r["seq"] for r in merge_sequences(df, ["byte_start"], "file").collect()}
    for r in merged_parts(df, ["byte_start"], "file", block=16).collect():
        assert whole[r["file"]][r["merged_start"] :].startswith(r["seq"])
    assert sum(len(r["seq"]) for r in merged_parts(df, ["byte_start"], block=16).collect()) == sum(map(len, whole.values()))
    assert running_length(df, ["byte_start"], block=16).agg(F.max("merged_len")).first()[0] == sum(map(len, whole.values()))
