"""The grammar against records that are written in many ways, and against a slow parser that reads line by line."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.errors import FastxError, InvalidRecordStart, TruncatedRecord
from strandlake.sources.grammar import find_record_start, scan_pieces


def parse(data: bytes, size: int | None = None):
    """(records, error) of an input that is fed in pieces of a size."""
    pieces = [data[i : i + size] for i in range(0, len(data), size)] if size else [data] if data else []
    out = []
    plain = lambda x: x.to_pylist() if hasattr(x, "to_pylist") else list(map(int, x)) if hasattr(x, "dtype") else x
    add = lambda r: out.extend(zip(*map(plain, (r.headers, r.seqs, r.quals if r.quals is not None else [None] * len(r), r.starts, r.ends)), strict=True))
    try:
        for _, records in scan_pieces(iter(pieces)):
            add(records)
    except FastxError as error:
        if getattr(error, "records", None):
            add(error.records)
        return out, error
    return out, None


def fields(data: bytes, size: int | None = None):
    records, error = parse(data, size)
    assert error is None
    return [r[:3] for r in records]


SIZES = [None, 1, 2, 3, 7, 64]

#: Headers, sequences and qualities of the cases below; they hold markers, blanks and qualities of other lengths.
NAMES = [b"contig 7 | draft", b"", b"x>y@z+", b" leading"]
BASES = [b"GATTACAgattacaNNRYK", b"C", b"ttggccaaTTGGCCAA-*", b"ACACACACACACACACACACACACA"]
MARKS = [b"@@+;hk", b"~", b"+" * 18, b">" * 25]


def fasta(end: bytes = b"\n", width: int = 9, last: bytes | None = None, blank: bool = False) -> bytes:
    """The records above as FASTA; blank: an empty line after every line of sequence; last: what ends the input."""
    out = []
    for name, seq in zip(NAMES, BASES, strict=True):
        out += [b">" + name] + [x for i in range(0, len(seq), width) for x in ([seq[i : i + width]] + [b""] * blank)]
    return end.join(out) + (end if last is None else last)


def fastq(end: bytes = b"\n", between: int = 0, last: bytes | None = None) -> bytes:
    """The records above as FASTQ, with so many blank lines between two."""
    out = [end.join((b"@" + n, s, b"+" + n[:3], q)) for n, s, q in zip(NAMES, BASES, MARKS, strict=True)]
    return (end * (1 + between)).join(out) + (end if last is None else last)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
@pytest.mark.parametrize("width", [1, 4, 9, 100])
def test_fasta_lines_of_any_width(size, end, width):
    for data in (fasta(end, width), fasta(end, width, last=b""), fasta(end, width, blank=True)):
        assert fields(data, size) == list(zip(NAMES, BASES, [None] * 4, strict=True))


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
def test_fastq_four_lines_and_qualities_of_any_length(size, end):
    for data in (fastq(end), fastq(end, 1), fastq(end, 3, end * 2)):
        assert fields(data, size) == list(zip(NAMES, BASES, MARKS, strict=True))
    assert fields(fastq(end, last=b""), size) == list(zip(NAMES, BASES, MARKS, strict=True))


@pytest.mark.parametrize("size", SIZES)
def test_sequences_may_be_empty(size):
    assert fields(b">p\n>q\n\n>r\nGG\n>s\n", size) == [(b"p", b"", None), (b"q", b"", None), (b"r", b"GG", None), (b"s", b"", None)]
    assert fields(b"@p\n\n+\n\n@q\nTG\n+\n#\n@r\n\n+\n\n", size) == [(b"p", b"", b""), (b"q", b"TG", b"#"), (b"r", b"", b"")]
    assert fields(b"", size) == []


@pytest.mark.parametrize("size", SIZES)
def test_a_carriage_return_within_a_line_is_a_residue(size):
    assert fields(b">k\nAT\rGC\n\rT\n", size) == [(b"k", b"AT\rGC\rT", None)]
    assert fields(b">k\n" + b"T" * 200 + b"\n\r" + b"G" * 70 + b"\n", size) == [(b"k", b"T" * 200 + b"\r" + b"G" * 70, None)]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("first", [b"#", b"A", b"\n", b" ", b"\r", b";"])
def test_the_first_byte_tells_the_format(first, size):
    for rest in (b"", fasta(), fastq()):
        records, error = parse(first + rest, size)
        assert records == [] and isinstance(error, InvalidRecordStart) and error.byte == first[0]


@pytest.mark.parametrize("size", SIZES)
def test_an_input_that_ends_within_a_record(size):
    """Every cut within the last record's lines but its quality, and a quality shorter than its sequence."""
    whole = fastq() + b"@final\nTTAGG\n+\n????"
    begin = len(fastq())
    for cut in range(begin + 1, len(whole) + 1):
        good, error = parse(whole[:cut], size)
        assert len(good) == 4 and isinstance(error, TruncatedRecord)
    assert len(fields(whole + b"?", size)) == 5


@pytest.mark.parametrize("size", SIZES)
def test_the_marker_is_looked_at_after_blank_lines_only(size):
    good, error = parse(fastq(last=b"\n\n") + b"=odd\nA\n+\nB\n", size)
    assert len(good) == 4 and isinstance(error, InvalidRecordStart) and error.byte == ord("=")
    assert fields(fastq() + b"=odd\nA\n+\nB\n", size)[4] == (b"odd", b"A", b"B")


def test_ranges_cover_the_records():
    for data in (fasta(), fasta(b"\r\n"), fastq(), fastq(b"\r\n")):
        records, _ = parse(data)
        assert records[0][3] == 0 and records[-1][4] == len(data)
        assert all(a[4] == b[3] for a, b in zip(records, records[1:], strict=False))
        assert all(data[r[3] : r[3] + 1] in (b">", b"@") for r in records)


def test_mixed_line_ends_dont_crash():
    parse(b">m\r\nTT\n>n\nGG\r\n>\r\n")


def test_search_for_a_record_start():
    """From every place of an input whose qualities begin with the marker."""
    records = [(b"one", b"GGC", b"@=="), (b"two", b"T", b"@"), (b"three", b"CATCAT", b"@@@@@@"), (b"four", b"AA", b"??")]
    data, starts = b"", []
    for name, seq, quality in records:
        starts.append(len(data))
        data += b"@" + name + b"\n" + seq + b"\n+\n" + quality + b"\n"
    for pos in range(len(data)):
        assert find_record_start("fastq", data, pos) == next((s for s in starts if s - 1 >= pos), None), pos
    plain = b">u>v\nGT>\n>w\nC\n"
    assert [find_record_start("fasta", plain, p) for p in (0, 8, 9)] == [9, 9, None]


def slow_fasta(data: bytes):
    out = []
    for line in data.split(b"\n"):
        if line.startswith(b">"):
            out.append([line[1:], b""])
        else:
            out[-1][1] += line
    return [tuple(x) for x in out]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([1, 5, 64, 1000]))
def test_random_fasta_like_the_slow_parser(seed, size):
    rng = random.Random(seed)
    data = b""
    for _ in range(rng.randint(1, 6)):
        data += b">" + bytes(rng.choices(b"ab >@", k=rng.randint(0, 5))) + b"\n"
        for _ in range(rng.randint(0, 4)):
            data += bytes(rng.choices(b"ACGTNacgtn-*", k=rng.randint(0, 130))) + b"\n"
    data = data[: len(data) - rng.randint(0, 1)]
    assert [f[:2] for f in fields(data, size)] == slow_fasta(data)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([1, 5, 64, 1000]))
def test_random_fastq_round_trip_and_damage(seed, size):
    rng = random.Random(seed)
    records = []
    for _ in range(rng.randint(1, 6)):
        n = rng.choice([0, 1, 2, 62, 63, 64, 65, 200])
        records.append((bytes(rng.choices(b"abc @+", k=rng.randint(1, 9))), bytes(rng.choices(b"ACGTN", k=n)), bytes(rng.choices(b"@+!I", k=n))))
    end = rng.choice([b"\n", b"\r\n"])
    data = b"".join(b"@" + h + end + s + end + b"+" + end + q + end for h, s, q in records)
    assert fields(data, size) == records
    damaged = bytearray(data)
    for _ in range(rng.randint(1, 8)):
        damaged[rng.randrange(len(damaged))] = rng.choice(b"\n\r@>+AN")
    assert parse(bytes(damaged), size)[0] == parse(bytes(damaged))[0]
