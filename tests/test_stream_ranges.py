"""Streams of byte ranges: every record once, whatever the triggers, restarts and half-written records."""

import gzip
import os
import random
import time

import pytest

from strandlake.sources.codecs import make_encoder
from strandlake.streaming.ranges import FastxStreamReader, stream_ranges, whole_records_end


def fastq(rows):
    return "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows).encode()


def reads(name, n, seed=1):
    rng = random.Random(seed)
    return [(f"{name}{i}", "".join(rng.choices("@+ACGT", k=(k := rng.randrange(60)))), "".join(rng.choices("@+I", k=k))) for i in range(n)]


class Stream:
    def __init__(self, spark, tmp_path, **options):
        self.spark, self.options, self.base = spark, options, tmp_path
        self.folder = tmp_path / "in"
        self.folder.mkdir()

    def put(self, name, data, mode="wb"):
        """New files appear whole; a growing one is written on to."""
        path = self.folder / (name if mode == "ab" else f".{name}")
        with open(path, mode) as f:
            f.write(data)
        if mode != "ab":
            path.rename(self.folder / name)

    def run(self):
        rows = stream_ranges(self.spark, str(self.folder), columns=["file", "header", "seq", "quality", "byte_start"], **self.options)
        query = rows.writeStream.format("parquet").option("path", str(self.base / "out")).option("checkpointLocation", str(self.base / "offsets")).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.rows()

    def rows(self):
        return sorted(((r["header"], r["seq"], r["quality"]) for r in self.spark.read.parquet(str(self.base / "out")).collect()), key=repr)


def test_files_arrive_over_triggers_and_restarts(spark, tmp_path):
    stream = Stream(spark, tmp_path, split_bytes=500)
    a, b, c, d = reads("a", 100, 1), reads("b", 50, 2), reads("c", 70, 3), reads("d", 60, 4)
    stream.put("a.fq", fastq(a))
    stream.put("b.fq.gz", gzip.compress(fastq(b)))
    assert stream.run() == sorted(a + b, key=repr)
    assert stream.run() == sorted(a + b, key=repr)  # nothing new
    blocks = make_encoder("bgzf", 400)
    stream.put("c.fq.gz", blocks.write(fastq(c)) + blocks.finish())
    stream.put("d.fq", fastq(d)[:-1])  # without the last line feed
    stream.put("e.fq", b"")
    assert stream.run() == sorted(a + b + c + d, key=repr)


def test_growing_files_give_whole_records_only(spark, tmp_path):
    stream = Stream(spark, tmp_path, split_bytes=300, growing=True, idle_seconds=3600)
    rows = reads("g", 90, 5)
    data = fastq(rows)
    fa = b"".join(b">%s\n%s\n" % (h.encode(), s.replace("@", "A").replace("+", "C").encode()) for h, s, _ in rows)
    plain = [(h, s.replace("@", "A").replace("+", "C"), None) for h, s, _ in rows]
    cuts = [0, 1, 700, 701, 1500, 3000, len(data)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        stream.put("g.fq", data[lo:hi], "ab")
        got = stream.run()
        whole = sum(data.find(b"@" + h.encode() + b"\n") >= 0 and len(fastq(rows[: i + 1])) <= hi for i, (h, _, _) in enumerate(rows))
        assert got == sorted(rows[:whole], key=repr), hi
    stream.put("h.fa", fa, "ab")
    assert stream.run() == sorted(rows + plain[:-1], key=repr)  # the last one may go on
    long_ago = time.time() - 7200
    os.utime(stream.folder / "h.fa", (long_ago, long_ago))
    assert stream.run() == sorted(rows + plain, key=repr)


def test_batches_are_ranges_fixed_by_their_offsets(spark, tmp_path):
    schema = stream_ranges(spark, str(tmp_path), columns=["header", "dna_len"]).schema
    rows = reads("r", 400, 6)
    (tmp_path / "a.fq").write_bytes(fastq(rows[:300]))
    reader = FastxStreamReader(schema, {"paths": str(tmp_path), "splitbytes": "1000", "growing": "true", "idleseconds": "1e9"})
    begin, middle = reader.initialOffset(), reader.latestOffset()
    headers = lambda parts: [r["header"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    parts = reader.partitions(begin, middle)
    assert len(parts) > 10 and all(p.end - p.start <= 1000 for p in parts)
    with open(tmp_path / "a.fq", "ab") as f:
        f.write(fastq(rows[300:]))
    end = reader.latestOffset()
    again = FastxStreamReader(schema, {"paths": str(tmp_path), "splitbytes": "1000", "growing": "true"})
    assert headers(again.partitions(begin, middle)) == [h for h, _, _ in rows[:300]]
    assert headers(again.partitions(middle, end)) == [h for h, _, _ in rows[300:]]
    assert headers(again.partitions(end, end)) == []


def test_tails_are_enlarged_until_they_hold_a_record(tmp_path):
    path = tmp_path / "long.fq"
    long = "ACGT" * 5000
    path.write_bytes(f"@a\nAC\n+\nII\n@b\n{long}\n+\n{'@' * len(long)}\n@c\n{long}\n+\n".encode())
    size = path.stat().st_size
    with open(path, "rb") as f:
        end = whole_records_end(f, size, 0, tail=64)
        f.seek(end)
        assert f.read(4) == b"\n@c\n"
        assert whole_records_end(f, size, end, tail=64) == end
        assert whole_records_end(f, 8, 0) == 0


def test_record_numbers_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="no record_index"):
        stream = stream_ranges(spark, str(tmp_path), columns=["record_index"])
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
