"""FASTA and FASTQ grammar: bytes in, columns of records out.

The scanners are fed bytes in pieces of any size and hand back whole records as they become complete, so a stream of any
length needs no more memory than a piece and one record. Lines are split and joined by bytes methods or array operations
on whole pieces, never one by one.

Rules. The first byte tells the format; an empty input is valid. A FASTA record starts at a > that begins a line, its
header is the rest of that line, and the lines up to the next record are its sequence, blank ones skipped. A FASTQ record
is four lines; the third is not looked at, and a quality of another length is accepted. Between FASTQ records blank lines
are skipped, and what follows them must be an @. The line ending is taken from the first header and holds for the input;
a carriage return anywhere else is a residue.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..errors import FastxError, InvalidRecordStart, TruncatedRecord

MARKERS = {ord(">"): "fasta", ord("@"): "fastq"}


def format_of(first: int) -> str:
    """The format that an input's first byte announces."""
    if first not in MARKERS:
        raise InvalidRecordStart("'>' or '@'", first, 0)
    return MARKERS[first]


def is_crlf(head: bytes) -> bool:
    """Whether the first line of an input ends in a carriage return and a line feed."""
    at = head.find(b"\n")
    return at > 0 and head[at - 1] == 13


@dataclass
class Records:
    """Columns of consecutive records, lists or Arrow arrays of bytes; quality is None for FASTA, starts and ends are byte
    offsets in the input."""

    headers: list[bytes] | pa.Array = field(default_factory=list)
    seqs: list[bytes] | pa.Array = field(default_factory=list)
    quals: list[bytes] | pa.Array | None = None
    starts: list[int] | np.ndarray = field(default_factory=list)
    ends: list[int] | np.ndarray = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.starts)

    def cut(self, n: int) -> Records:
        return Records(self.headers[:n], self.seqs[:n], None if self.quals is None else self.quals[:n], self.starts[:n], self.ends[:n])


def concatenated_records(parts: list[Records]) -> Records:
    """The records of several inputs of one format, one after another."""
    if len(parts) == 1:
        return parts[0]

    def joined(columns: list[list[bytes] | pa.Array]) -> pa.Array:
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.binary()) for c in columns]
        kind = pa.large_binary() if sum(a.nbytes for a in arrays) >= 1 << 31 else pa.binary()
        return pa.concat_arrays([a.cast(kind) for a in arrays])

    quals = None if parts[0].quals is None else joined([p.quals for p in parts])
    bounds = [np.concatenate([np.asarray(c, np.int64) for c in side]) for side in ([p.starts for p in parts], [p.ends for p in parts])]
    return Records(joined([p.headers for p in parts]), joined([p.seqs for p in parts]), quals, *bounds)


class FastaScanner:
    """Give it bytes from a record's > on; `offset` is where that byte stands in the input."""

    format = "fasta"

    def __init__(self, offset: int = 0, crlf: bool = False, checked: bool = True, with_seqs: bool = True):
        self.offset, self.crlf, self.checked, self.with_seqs = offset, crlf, checked, with_seqs
        self.held: list[bytes] = []

    def feed(self, piece: bytes) -> Records:
        if not piece:
            return Records()
        last = self.held[-1] if self.held else b""
        self.held.append(piece)
        if b"\n>" not in piece and not (last.endswith(b"\n") and piece.startswith(b">")):
            return Records()
        whole = b"".join(self.held)
        cut = whole.rfind(b"\n>") + 1
        self.held = [whole[cut:]]
        return self.records(whole[:cut])

    def finish(self) -> Records:
        rest, self.held = b"".join(self.held), []
        return self.records(rest) if rest else Records()

    def records(self, whole: bytes) -> Records:
        if self.checked:
            if whole[0] != ord(">"):
                raise InvalidRecordStart("'>'", whole[0], self.offset)
            self.checked = False
        parts = whole[1:].split(b"\n>")
        sizes = [len(p) + 2 for p in parts]
        sizes[-1] -= 1
        bounds = (self.offset + np.concatenate([[0], np.cumsum(sizes)])).tolist()
        self.offset = bounds[-1]
        last = len(parts) - 1
        parts = [p if i == last else p + b"\n" for i, p in enumerate(parts)]
        split = [p.partition(b"\n") for p in parts]
        if not self.with_seqs:
            headers, seqs = [h.removesuffix(b"\r") if self.crlf else h for h, _, _ in split], []
        elif self.crlf:
            headers = [h.removesuffix(b"\r") for h, _, _ in split]
            seqs = [s.replace(b"\r\n", b"").replace(b"\n", b"") for _, _, s in split]
        else:
            headers = [h for h, _, _ in split]
            seqs = [s.replace(b"\n", b"") for _, _, s in split]
        return Records(headers, seqs, None, bounds[:-1], bounds[1:])


class FastqScanner:
    """Give it bytes from a record's @ on; `offset` is where that byte stands in the input."""

    format = "fastq"

    def __init__(self, offset: int = 0, crlf: bool = False, checked: bool = True, with_seqs: bool = True):
        self.offset, self.crlf, self.checked, self.with_seqs = offset, crlf, checked, with_seqs
        self.held = b""
        self.after_blank = checked
        self.waiting: list[bytes] = []
        self.feeds = 0

    def feed(self, piece: bytes) -> Records:
        self.waiting.append(piece)
        self.feeds += piece.count(b"\n")
        first = self.held[:1] or next((w[:1] for w in self.waiting if w), b"")
        if self.feeds < 4 and (not self.after_blank or first == b"@"):
            return Records(quals=[])  # no record can be whole yet
        self.gather()
        out = self.plain_records() or self.scan(final=False)
        self.feeds = self.held.count(b"\n")
        return out

    def finish(self) -> Records:
        self.gather()
        return self.scan(final=True)

    def gather(self) -> None:
        """Joins what has come in: once a record, however many pieces that is of."""
        self.held = b"".join([self.held, *self.waiting])
        self.waiting = []

    def plain_records(self) -> Records | None:
        """The whole records at hand, cut out by their line ends as Arrow arrays: the common case of line feeds only and no
        blank line between records. None if it isn't that case, or there is no whole record."""
        if self.crlf or (self.after_blank and self.held[:1] != b"@"):
            return None
        feeds = np.flatnonzero(np.frombuffer(self.held, np.uint8) == 10)
        n = len(feeds) // 4
        feeds = feeds[: 4 * n].reshape(n, 4)
        begin = np.concatenate([[0], feeds[:-1, 3] + 1]) if n else feeds[:, 0]
        if not n or (feeds[:, 0] == begin).any():
            return None
        # Nine stretches a record: marker, header, feed, sequence, feed, plus line, feed, quality, feed.
        bounds = np.stack([begin, begin + 1, feeds[:, 0], feeds[:, 0] + 1, feeds[:, 1], feeds[:, 1] + 1, feeds[:, 2], feeds[:, 2] + 1, feeds[:, 3]], axis=1)
        used = int(feeds[-1, 3]) + 1
        offsets = np.append(bounds.ravel(), used).astype(np.int32 if used < 1 << 31 else np.int64)
        kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
        stretches = pa.Array.from_buffers(kind, 9 * n, [None, pa.py_buffer(offsets), pa.py_buffer(self.held)])
        header, seq, quality = (stretches.take(pa.array(np.arange(i, 9 * n, 9))) if i == 1 or self.with_seqs else [] for i in (1, 3, 7))
        out = Records(header, seq, quality, begin + self.offset, feeds[:, 3] + 1 + self.offset)
        self.held, self.offset, self.after_blank = self.held[used:], self.offset + used, False
        return out

    def stripped(self, lines: list[bytes]) -> list[bytes]:
        return [x.removesuffix(b"\r") for x in lines] if self.crlf else lines

    def scan(self, final: bool) -> Records:
        out = Records(quals=[])
        blanks = (b"", b"\r") if self.crlf else (b"",)
        lines = self.held.split(b"\n")
        rest = lines.pop()
        ends = np.cumsum([len(x) + 1 for x in lines]) if lines else np.zeros(0, np.int64)
        at, start = 0, 0

        def take(n: int) -> None:
            nonlocal at
            if n:
                out.headers += [h[1:] for h in self.stripped(lines[at : at + 4 * n : 4])]
                if self.with_seqs:
                    out.seqs += self.stripped(lines[at + 1 : at + 4 * n : 4])
                    out.quals += self.stripped(lines[at + 3 : at + 4 * n : 4])
                stops = (ends[at + 3 : at + 4 * n : 4] + self.offset).tolist()
                begin = int(ends[at - 1]) if at else 0
                out.starts += [begin + self.offset, *stops[:-1]]
                out.ends += stops
                at += 4 * n

        try:
            while True:
                while at < len(lines) and lines[at] in blanks:
                    at, self.after_blank = at + 1, True
                start = int(ends[at - 1]) if at else 0
                first = lines[at] if at < len(lines) else rest
                if not first or (self.crlf and at >= len(lines) and first == b"\r"):
                    break
                if self.after_blank and first[0] != ord("@"):
                    raise InvalidRecordStart("'@'", first[0], self.offset + start)
                heads = lines[at : max(at, len(lines) - 3) : 4]
                whole = next((i for i, h in enumerate(heads) if h in blanks), len(heads)) if any(b in heads for b in blanks) else len(heads)
                take(whole)
                if whole:
                    self.after_blank = False
                    start = int(ends[at - 1])
                if whole == len(heads):
                    break
            if final and start < len(self.held):
                self.last(out, lines[at:], rest, start)
                start = len(self.held)
        except FastxError as error:
            error.records = out
            raise
        self.held, self.offset = self.held[start:], self.offset + start
        return out

    def last(self, out: Records, lines: list[bytes], rest: bytes, start: int) -> None:
        """The record that the input ends in, without a line feed after its quality."""
        if all(x in (b"", b"\r") for x in (*lines, rest)) and not lines[1:]:
            return
        if len(lines) < 3:
            raise TruncatedRecord(self.offset + start)
        head, seq = self.stripped(lines[:2])
        if len(rest) < len(seq):
            raise TruncatedRecord(self.offset + start)
        out.headers.append(head[1:])
        out.seqs.append(seq)
        out.quals.append(rest)
        out.starts.append(self.offset + start)
        out.ends.append(self.offset + len(self.held))


def scanner(format_: str, offset: int = 0, crlf: bool = False, checked: bool = True, with_seqs: bool = True) -> FastaScanner | FastqScanner:
    """with_seqs: whether sequences and qualities are wanted; without, the records have none."""
    return (FastaScanner if format_ == "fasta" else FastqScanner)(offset, crlf, checked, with_seqs)


def scan_pieces(pieces: Iterator[bytes], with_seqs: bool = True) -> Iterator[tuple[str, Records]]:
    """(format, records) of a whole input that comes in pieces. An error carries the good records before it as `records`."""
    held = b""
    scan = None
    for piece in pieces:
        if scan is None:
            held += piece
            if b"\n" not in held:
                continue
            format_ = format_of(held[0])
            scan, piece = scanner(format_, 0, is_crlf(held), True, with_seqs), held
        yield scan.format, scan.feed(piece)
    if scan is None:
        if not held:
            return
        scan = scanner(format_of(held[0]), 0, False, True, with_seqs)
        yield scan.format, scan.feed(held)
    yield scan.format, scan.finish()


def scan_bytes(data: bytes) -> Iterator[tuple[str, Records]]:
    return scan_pieces(iter([data] if data else []))


class FastqSync:
    """Finds where records start when reading begins in the middle of a FASTQ input.

    The first whole line can be a header, a sequence, a plus line or a quality. All four readings are followed side by side,
    line by line, and those that the lines contradict are dropped: a header begins with @, a plus line with +, a quality is as long
    as its sequence, and blank lines stand only where a header is due. `start` is set once every reading that is left has
    the same first header. Letters prove nothing by themselves, so sequences and qualities may begin with @ or +.
    """

    HEADER, SEQUENCE, PLUS, QUALITY = range(4)

    def __init__(self, crlf: bool = False):
        self.crlf = crlf
        #: Of each reading: what the next line is, the length of its sequence if known, and where its first header starts.
        self.readings: list[tuple[int, int | None, int | None]] = [(kind, None, None) for kind in range(4)]
        self.start: int | None = None

    def line(self, begin: int, text: bytes) -> None:
        """The next line, without its line feed."""
        if self.crlf:
            text = text.removesuffix(b"\r")
        left = []
        for kind, length, first in self.readings:
            if kind == self.HEADER:
                if not text:
                    left.append((kind, None, first))
                elif text[:1] == b"@":
                    left.append((self.SEQUENCE, None, begin if first is None else first))
            elif kind == self.SEQUENCE:
                left.append((self.PLUS, len(text), first))
            elif kind == self.PLUS:
                if text[:1] == b"+":
                    left.append((self.QUALITY, length, first))
            elif length is None or length == len(text):
                left.append((self.HEADER, None, first))
        self.readings = list(dict.fromkeys(left))
        self.settle()

    def settle(self) -> None:
        starts = {first for _, _, first in self.readings}
        if len(starts) == 1:
            self.start = starts.pop()

    def end(self, rest: bytes) -> None:
        """The input ends, with a line that has no line feed: a record must end there, too."""
        if rest.removesuffix(b"\r" if self.crlf else b""):
            self.line(-1, rest)
        whole = [r for r in self.readings if r[0] == self.HEADER and r[2] is not None]
        if whole and self.start is None:
            self.start = min(first for _, _, first in whole)

    def earliest(self, begin: int, head: bytes) -> int | None:
        """The first place where a record could still start, given where the next line begins and its first byte, if known."""
        open_header = head in (b"", b"@", b"\r", b"\n")
        places = [begin if first is None and kind == self.HEADER and open_header else first for kind, _, first in self.readings]
        return min((p for p in places if p is not None), default=None)

    @property
    def lost(self) -> bool:
        """Whether no reading is left: the input has records that are no regular FASTQ."""
        return not self.readings


def find_record_start(format_: str, data: bytes, pos: int = 0, crlf: bool = False, final: bool = True) -> int | None:
    """The first record start behind a line feed at or after pos. FASTA: a > that begins a line. FASTQ: see FastqSync; None if
    data doesn't tell. final: whether the input ends with data, and a record therefore, too."""
    if format_ == "fasta":
        at = data.find(b"\n>", pos)
        return None if at < 0 else at + 1
    at = data.find(b"\n", pos)
    if at < 0:
        return None
    sync, begin = FastqSync(crlf), at + 1
    while sync.start is None and not sync.lost:
        end = data.find(b"\n", begin)
        if end < 0:
            if final:
                sync.end(data[begin:])
            break
        sync.line(begin, data[begin:end])
        begin = end + 1
    return irregular_record_start(data, at) if sync.lost else sync.start


def irregular_record_start(data: bytes, pos: int = 0) -> int | None:
    """For FASTQ with plus lines without + or qualities of another length than the sequence: an @ that begins a line, if
    the next line begins with something else. None if data doesn't reach far enough to tell."""
    at = data.find(b"\n@", pos)
    while at >= 0:
        end = data.find(b"\n", at + 1)
        if end < 0 or end + 1 >= len(data):
            return None
        if data[end + 1] != ord("@"):
            return at + 1
        at = data.find(b"\n@", at + 1)
    return None
