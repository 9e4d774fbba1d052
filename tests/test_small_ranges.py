"""Files that are cut into many small ranges: few tasks, few bytes read, all records."""

import io

import numpy as np

from strandlake.sources import fastx
from strandlake.sources.fastx import FastxReader, FilePart, read_fastx, read_numbered, requested_schema


def fastq(n: int) -> list[tuple[str, str]]:
    return [(f"r{i}", "ACGT@+"[i % 6 :] * (i % 9)) for i in range(n)]


def test_many_small_ranges_are_few_tasks_with_all_records(spark, tmp_path):
    rows = fastq(20_000)
    for name, part in (("a.fq", rows[:15_000]), ("b.fq", rows[15_000:])):
        (tmp_path / name).write_text("".join(f"@{h}\n{s}\n+\n{s}\n" for h, s in part))
    reader = FastxReader(requested_schema(["header"], False), {"paths": str(tmp_path), "splitbytes": 1 << 10, "parallelism": 4})
    single = FastxReader(requested_schema(["header"], False), {"paths": str(tmp_path), "splitbytes": 1 << 10})
    assert len(single.partitions()) > 500 and len(reader.partitions()) <= 4
    found = read_fastx(spark, str(tmp_path), columns=["header", "seq"], split_bytes=1 << 10).collect()
    assert sorted(tuple(r) for r in found) == sorted(rows)
    numbered = read_numbered(spark, str(tmp_path), columns=["file", "header", "record_index"], split_bytes=1 << 10).collect()
    assert {(r["file"][-4:], r["header"], r["record_index"]) for r in numbered} == {("a.fq" if i < 15_000 else "b.fq", h, i % 15_000) for i, (h, _) in enumerate(rows)}
    assert len(numbered) == len(rows)


def test_a_small_range_reads_little_more_than_itself(monkeypatch):
    data = "".join(f"@{h}\n{s}\n+\n{s}\n" for h, s in fastq(200_000)).encode()
    taken = []

    class Counted(io.BytesIO):
        def read(self, n=-1):
            out = super().read(n)
            taken.append(len(out))
            return out

    monkeypatch.setattr(fastx, "open_input", lambda path: Counted(data))
    reader = FastxReader(requested_schema(["header", "byte_start"], False), {"paths": "x"})
    starts = []
    for start in (0, 1 << 14, 1 << 15):
        part = FilePart("x", len(data), start, start + (1 << 14), None, "bytes", "fastq", False)
        starts += [x for batch in reader.read(part) for x in batch.column(1).to_pylist()]
    assert np.all(np.diff(starts) > 0) and data[starts[-1] :].split(b"\n")[0].startswith(b"@r") and starts[-1] <= 3 << 14
    assert sum(taken) < 2 * (3 << 14)
