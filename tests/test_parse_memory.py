"""What parse_fastx holds at a time, whatever the contents of a batch come to."""

import gzip

from strandlake.operators import parse
from strandlake.operators.parse import parse_fastx


def held_at_most(spark, monkeypatch, contents, **options):
    """The most records that are put together at once, in a scan of one batch in this process."""
    most, joined = [0], parse.concatenated_records

    def counted(found):
        most[0] = max(most[0], sum(len(f) for f in found))
        return joined(found)

    monkeypatch.setattr(parse, "concatenated_records", counted)
    import pyarrow as pa

    taken = {}

    class Frame:  # stands for a DataFrame, to get hold of the task's function
        columns = ["content_"]

        def select(self, *_):
            return self

        def __getitem__(self, _):
            raise AssertionError

        schema = None

        def mapInArrow(self, run, _):
            taken["run"] = run

    parse_fastx(Frame(), "content", columns=("header", "seq"), **options)
    batch = pa.RecordBatch.from_arrays([pa.array(contents, pa.binary())], ["content_"])
    n = sum(b.num_rows for b in taken["run"](iter([batch])))
    return n, most[0]


def test_few_records_are_held_at_a_time(spark, monkeypatch):
    text = b"".join(b"@r%d\n%s\n+\n%s\n" % (i, b"ACGT" * 25, b"IIII" * 25) for i in range(64))
    n, most = held_at_most(spark, monkeypatch, [text] * 1000)
    assert n == 64_000 and most * len(text) // 64 < 2 << 20
    n, most = held_at_most(spark, monkeypatch, [gzip.compress(text)] * 1000, decompress=True)
    assert n == 64_000 and most * len(text) // 64 < 2 << 20
