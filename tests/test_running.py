"""Running length over a stream's batches, ordered processors, sketches and roll-ups."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from strandlake.operators import aggregates as agg
from strandlake.operators import compat
from strandlake.sources.fastx import read_fastx
from strandlake.streaming.ranges import stream_ranges
from strandlake.streaming.running import read_running_length, write_running_length


def test_running_length_over_triggers_and_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(7)
    texts = {name: [f"@{name}{i}\n{'A' * (n := rng.randrange(40))}\n+\n{'I' * n}\n".encode() for i in range(90)] for name in ("p", "q")}

    def run():
        rows = stream_ranges(spark, str(folder), columns=["file", "header", "dna_len", "byte_start"], split_bytes=400, growing=True, idle_seconds=3600)
        write_running_length(rows, str(tmp_path / "state"), block=500).awaitTermination()

    for lo, hi in ((0, 30), (30, 31), (31, 90)):
        for name, parts in texts.items():
            if not (name == "q" and lo == 30):
                with open(folder / f"{name}.fq", "ab") as f:
                    f.write(b"".join(parts[lo if name == "p" or lo != 31 else 30 : hi]))
        run()
    run()  # nothing new
    got = read_running_length(spark, str(tmp_path / "state"))
    whole = agg.running_length(read_fastx(spark, str(folder), columns=["file", "header", "dna_len", "byte_start"]), ["byte_start"], "file")
    keep = lambda df: sorted(tuple(r) for r in df.select("header", "merged_len").collect())
    assert keep(got) == keep(whole) and len(keep(got)) == 180 and got.select("batch").distinct().count() == 3


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("ordered")
    for name in "ab":
        (folder / f"{name}.fa").write_bytes(b"".join(b">%s%d\n%s\n" % (name.encode(), i, b"A" * (i % 7)) for i in range(300)))
    return read_fastx(spark, str(folder), columns=["file", "header", "seq", "byte_start"], split_bytes=200)


def lengths():
    """A processor, as a class of a function, which workers get by value."""

    class Lengths(compat.BatchProcessor):
        schema = "header string, n int"
        requires_ordering = True

        def process_batch(self, batch):
            return pa.RecordBatch.from_arrays([batch.column("header"), pc.binary_length(batch.column("seq")).cast(pa.int32())], ["header", "n"])

        def on_batch_complete(self):
            return [{"header": "batch", "n": None}]

    return Lengths()


def test_tickets_restore_the_order_without_moving_records(scan):
    out = compat.process_parallel(scan, lengths())
    rows = [r for r in out.collect() if r["header"] != "batch"]
    assert [(r["header"], r["n"]) for r in rows] == [(f"{f}{i}", i % 7) for f in "ab" for i in range(300)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("MapInArrow") :]
    assert "Exchange" not in below and "Sort" not in below
    tickets = [(r["ticket"]["file"], r["ticket"]["byte_start"], r["ticket"]["row"]) for r in out.collect()]
    assert tickets == sorted(tickets) and len(set(tickets)) == len(tickets)


def test_batches_are_cut_where_the_input_is_not_consecutive(scan):
    """Partitions of several ranges: a ticket for each of them."""
    rows = [r for r in compat.process_parallel(scan.coalesce(2), lengths()).collect() if r["header"] != "batch"]
    assert [r["header"] for r in rows] == [f"{f}{i}" for f in "ab" for i in range(300)]


def test_processors_without_order_and_tables(scan):
    class Long(compat.BatchProcessor):
        schema = "header string"

        def process_batch(self, batch):
            return pa.Table.from_batches([batch]).filter(pc.equal(pc.binary_length(batch.column("seq")), 6)).select(["header"])

        def on_partition_complete(self):
            return [{"header": "end"}]

    out = compat.process_parallel(scan, Long())
    assert out.columns == ["header"] and out.where("header != 'end'").count() == 2 * 42
    assert out.where("header = 'end'").count() == scan.rdd.getNumPartitions()


def test_sketches_merge_to_what_one_sketch_says(spark):
    rng = random.Random(3)
    rows = [(i % 4, i % 3, "".join(rng.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=200))) for i in range(300)]
    df = spark.createDataFrame(rows, "part int, piece int, seq string")
    fine = agg.kmer_sketches(df, 9, "part", "piece")
    got = {r["part"]: r["distinct_kmers"] for r in agg.merged_kmers(fine, "part", rollup=True).collect()}
    whole = {r["part"]: r["distinct_kmers"] for r in agg.merged_kmers(agg.kmer_sketches(df, 9, "part"), "part").collect()}
    assert {k: v for k, v in got.items() if k is not None} == pytest.approx(whole, rel=0.02)
    for part, estimate in got.items():
        words = set()
        for p, _, s in rows:
            if part in (None, p):
                for run in s.replace("N", " ").split():
                    for i in range(len(run) - 8):
                        w = run[i : i + 9]
                        words.add(min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))))
        assert estimate == pytest.approx(len(words), rel=0.04)


def test_rollup_of_statistics(spark):
    df = spark.createDataFrame([("a", "fq", 3), ("a", "fa", 5), ("b", "fa", None), (None, "fa", 1)], "file string, format string, dna_len long")
    got = {(r["file"], r["format"], r["level"]): (r["num_seqs"], r["sum_len"]) for r in agg.seq_rollup(df, "file", "format").collect()}
    assert got[None, None, 0] == (4, 9) and got["a", None, 1] == (2, 8) and got[None, None, 1] == (1, 1) and got["b", "fa", 2] == (1, None) and len(got) == 8
    assert agg.seq_rollup(df.where(F.lit(False)), "file").count() == 0
