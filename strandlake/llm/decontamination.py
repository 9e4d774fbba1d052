"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, and verification by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import pieces, text_bytes

#: Length of the q-grams: eight bytes, so that a gram is a 64-bit number and equality is exact.
Q = 8

#: Length and stride of the windows by which items are looked for: a quotation of WINDOW + STRIDE - 1 bytes or more holds a
#: whole window wherever it begins.
WINDOW, STRIDE = 150, 50

#: Shared grams and band counts that are held at a time.
HELD = 1 << 18

#: a-z, 0-9 and the bytes of multi-byte characters stand for themselves, all else for a blank.
FOLDED = np.array([b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)], np.uint8)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with runs of blanks made one and none at a text's start, and their new offsets."""
    data = FOLDED[data]
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep[edge[:-1]] = True
    keep &= ~(blank & edge[:-1])
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes at every place as one number."""
    two = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
    four = (two[:-2].astype(np.uint32) << np.uint32(16)) | two[2:]
    return (four[:-4].astype(np.uint64) << np.uint64(32)) | four[4:]


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int]:
    """The least edit distance of pattern to a stretch of text, over alignments within diagonals low..high, and the end of
    such a stretch; budget + 1 if it is above budget. Diagonal d puts pattern[i] at text[i + d]."""
    width, n = high - low + 1, len(text)
    over = budget + 1
    steps = np.arange(width)
    places = low + steps
    line = np.where((places >= 0) & (places <= n), 0, over)
    for i, letter in enumerate(pattern.tolist()):
        at = places + i
        inside = (at >= 0) & (at < n)
        differ = np.ones(width, np.int64)
        differ[inside] = text[at[inside]] != letter
        new = np.where(inside, line + differ, over)
        new[:-1] = np.minimum(new[:-1], line[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        new[(at + 1 < 0) | (at + 1 > n)] = over
        line = np.minimum(new, over)
        if line.min() > budget:
            return over, -1
    best = int(line.argmin())
    return int(line[best]), low + best + len(pattern)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


class Tally:
    """Counts by key, summed up whenever many have come together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, HELD

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > self.most:
            self.parts = [merged(self.parts)]
            self.held = len(self.parts[0][0])
            self.most = max(self.most, 2 * self.held)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(self.parts)


class PassageIndex:
    """The q-grams of benchmark items with their places, and the windows that items are looked for by, with edit budgets and
    lemma thresholds.

    An item of up to WINDOW folded bytes is one window; a longer one has a window at each multiple of STRIDE and one at its
    end. Items of less than 2 * Q bytes allow no edit and are looked for as whole words, those of less than `least` not at all.
    """

    def __init__(self, texts: list[str], rate: float, least: int = 0):
        lines: list[np.ndarray] = []
        owner: list[int] = []
        starts: list[int] = []
        self.letters: list[np.ndarray] = []
        plan: list[tuple[int, int]] = []
        numbers: list[int] = []
        #: By length (with a blank on either side), the short items and their numbers.
        self.short: dict[int, list[tuple[bytes, int]]] = {}
        for number, text in enumerate(texts):
            line, _ = folded(*text_bytes(pc.utf8_lower(pa.array([text], pa.string()))))
            line = line[:-1] if len(line) and line[-1] == 32 else line
            if len(line) < max(least, 2 * Q):
                if len(line) and len(line) >= least:
                    self.short.setdefault(len(line) + 2, []).append((b" " + line.tobytes() + b" ", number))
                continue
            strided = list(range(0, len(line) - WINDOW, STRIDE))
            plan.append((len(starts), len(strided)))
            for lo in [*strided, max(0, len(line) - WINDOW)]:
                owner.append(number)
                self.letters.append(line[lo : lo + WINDOW])
                starts.append(lo)
            lines.append(line)
            numbers.append(number)
        self.owner, self.start = np.array(owner, np.int64), np.array(starts, np.int64)
        self.size = np.array([len(p) for p in self.letters], np.int64)
        #: By item, its first window and how many of them lie at multiples of STRIDE; the one at the end follows.
        self.plan = np.array(plan, np.int64).reshape(-1, 2)
        #: Edits allowed, and the q-grams that must be left after so many: one edit spoils Q of them at most.
        self.budget = np.minimum((self.size * rate).astype(np.int64), (self.size - Q) // Q)
        self.least = self.size - Q + 1 - Q * self.budget
        #: The fewest grams that any window of an item asks for.
        self.fewest = np.minimum.reduceat(self.least, self.plan[:, 0]) if len(self.plan) else np.zeros(0, np.int64)
        all_grams = [grams(line) for line in lines]
        flat = np.concatenate([*all_grams, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.item = np.repeat(np.arange(len(lines), dtype=np.int32), [len(g) for g in all_grams])[order]
        self.place = np.concatenate([*[np.arange(len(g), dtype=np.int32) for g in all_grams], np.zeros(0, np.int32)])[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.slots(self.grams)] = True

    @staticmethod
    def slots(g: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def hits(self, data: np.ndarray, window: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in data, item by its number here, place in the item) of all shared q-grams, HELD at a time or those of one
        place."""
        for lo in range(0, len(data) - Q + 1 if len(self.grams) else 0, window):
            g = grams(data[lo : lo + window + Q - 1])
            at = np.flatnonzero(self.filter[self.slots(g)])
            which = np.searchsorted(self.grams, g[at])
            which[which == len(self.grams)] = 0
            real = self.grams[which] == g[at]
            at, which = at[real], which[real]
            many = self.first[which + 1] - self.first[which]
            total = np.concatenate([[0], np.cumsum(many)])
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, total[a] + HELD, "right")) - 1)
                n = many[a:b]
                source = np.repeat(self.first[which[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield np.repeat(at[a:b] + lo, n), self.item[source].astype(np.int64), self.place[source].astype(np.int64)
                a = b

    def within(self, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, passage) of the windows that hold the grams at these places of items."""
        first, strided = self.plan[item].T
        found = [(np.arange(len(item)), first + strided)]
        for back in range(-(-WINDOW // STRIDE)):
            k = place // STRIDE - back
            there = np.flatnonzero((k >= 0) & (k < strided))
            found.append((there, (first + k)[there]))
        which, passage = (np.concatenate(x) for x in zip(*found, strict=True))
        holds = (self.start[passage] <= place[which]) & (place[which] + Q <= self.start[passage] + self.size[passage])
        return which[holds], passage[holds]

    def bands(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, band) where as many grams are shared as the lemma asks for, those with most first.

        The shared grams of an alignment with at most e edits lie on e + 1 neighbouring diagonals, so in one of the bands
        of 2 (e + 1) diagonals that start at each multiple of e + 1. Texts that don't share the fewest grams with an item
        that any of its windows asks for are left out before. Shared grams are counted part by part; if there are too many
        to hold, they are found a second time.
        """
        items, passages = max(len(self.plan), 1), max(len(self.owner), 1)

        def placed() -> Iterator[tuple[np.ndarray, ...]]:
            for at, item, place in self.hits(data):
                row = np.searchsorted(offsets, at, "right") - 1
                inside = at + Q <= offsets[row + 1]
                yield at[inside], item[inside], place[inside], row[inside]

        kept: list[tuple[np.ndarray, ...]] | None = []
        held, shared = 0, Tally()
        for part in placed():
            shared.add(part[3] * items + part[1])
            held += len(part[0])
            kept = [*kept, part] if kept is not None and held <= 4 * HELD else None
        keys, counts = shared.sums()
        live = keys[counts >= self.fewest[keys % items]] if len(keys) else keys
        longest = int(np.diff(offsets).max(initial=0) + self.size.max(initial=0)) + 2
        tally = Tally()
        for at, item, place, row in (placed() if kept is None else kept) if len(live) else ():
            where = np.searchsorted(live, row * items + item)
            where[where == len(live)] = 0
            enough = live[where] == row * items + item
            at, item, place, row = at[enough], item[enough], place[enough], row[enough]
            which, passage = self.within(item, place)
            diagonal = at[which] - offsets[row[which]] - (place[which] - self.start[passage]) + self.size[passage]
            band = diagonal // (self.budget[passage] + 1)
            key = (row[which] * passages + passage) * longest
            tally.add(np.concatenate([key + band, (key + band - 1)[band > 0]]))
        keys, counts = tally.sums()
        row, passage, band = keys // longest // passages, keys // longest % passages, keys % longest
        enough = np.flatnonzero(counts >= self.least[passage]) if len(keys) else np.zeros(0, np.int64)
        enough = enough[np.argsort(-counts[enough], kind="stable")]
        return row[enough], passage[enough], band[enough]

    def whole_words(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, end in the folded text) of the short items, where they stand first in each text as whole words."""
        if not self.short or not len(data):
            return []
        # Each text with a blank before and behind.
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        padded = np.full(len(data) + 2 * len(n) + 2 * Q, 32, np.uint8)
        padded[np.arange(len(data)) + 2 * row + 1] = data
        begins = offsets[:-1] + 2 * np.arange(len(n))
        g = grams(padded)
        raw, found = padded.tobytes(), {}
        for size, items in sorted(self.short.items()):
            shift = np.uint64(8 * max(0, Q - size))
            heads = np.unique(np.array([int.from_bytes(text[:Q], "big") for text, _ in items], np.uint64))
            seen = g >> shift
            near = np.searchsorted(heads, seen)
            near[near == len(heads)] = 0
            by_text: dict[bytes, list[int]] = {}
            for text, number in items:
                by_text.setdefault(text, []).append(number)
            for p in np.flatnonzero(heads[near] == seen).tolist():
                r = int(np.searchsorted(begins, p, "right")) - 1
                if p + size <= begins[r] + n[r] + 2:
                    for number in by_text.get(raw[p : p + size], ()):
                        found.setdefault((r, number), int(p + size - begins[r]) - 2)
        return [(r, number, end) for (r, number), end in found.items()]

    def search(self, data: np.ndarray, offsets: np.ndarray, *, first_only: bool = False) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
        """(text, passage, edits, end in the folded text) of the windows that stand in each text within their budgets, and
        what whole_words finds; with first_only, nothing more of a text once something was found."""
        data, offsets = folded(data, offsets)
        words = self.whole_words(data, offsets)
        raw = data.tobytes()
        best: dict[tuple[int, int], tuple[int, int]] = {}
        done = {r for r, *_ in words}
        for r, i, b in zip(*(x.tolist() for x in self.bands(data, offsets)), strict=True):
            if first_only and r in done:
                continue
            e, size, lo, hi = int(self.budget[i]), int(self.size[i]), int(offsets[r]), int(offsets[r + 1])
            bar = best[r, i][0] - 1 if (r, i) in best else e
            if bar < 0:
                continue
            low = b * (e + 1) - size - e
            high = low + 2 * (e + 1) + 2 * e
            at = raw.find(self.letters[i].tobytes(), max(lo, lo + low), max(lo, min(hi, lo + high + size)))
            edits, end = (0, at - lo + size) if at >= 0 else banded_distance(self.letters[i], data[lo:hi], low, high, bar)
            if edits <= bar:
                best[r, i] = edits, end
                done.add(r)
        return [(r, i, edits, end) for (r, i), (edits, end) in sorted(best.items())], words

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, end, length) of the longest region of each item that overlapping windows found in a text
        cover; edits and end are those of its best window."""
        windows, words = self.search(data, offsets)
        by: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for r, i, edits, end in windows:
            by.setdefault((r, int(self.owner[i])), []).append((int(self.start[i]), int(self.start[i] + self.size[i]), edits, end))
        size_of = {number: size - 2 for size, items in self.short.items() for _, number in items}
        out = [(r, number, 0, end, size_of[number]) for r, number, end in words]
        for (r, number), parts in by.items():
            covers: list[tuple[int, int, tuple[int, int]]] = []
            for lo, hi, edits, end in sorted(parts):
                if covers and lo <= covers[-1][1]:
                    covers[-1] = covers[-1][0], max(covers[-1][1], hi), min(covers[-1][2], (edits, end))
                else:
                    covers.append((lo, hi, (edits, end)))
            lo, hi, (edits, end) = min(covers, key=lambda c: (c[0] - c[1], c[2]))
            out.append((r, number, edits, end, hi - lo))
        return sorted(out)


class Passages:
    """The items of a benchmark in blocks of about block_bytes of text, each block a broadcast of its own: the driver and a
    task hold one at a time, and one pass over the documents goes through all."""

    def __init__(self, benchmark: DataFrame, rate: float, block_bytes: int, item_col: str, text_col: str, least: int = 0):
        items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
        self.rate, self.least, self.item_type = rate, least, items.dtypes[0][1]
        total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, -(-total // block_bytes))
        self.blocks = []
        for k in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
            self.blocks.append(benchmark.sparkSession.sparkContext.broadcast(part.orderBy(F.col("item").asc_nulls_first(), "text").toArrow().combine_chunks()))
        self.built: tuple[int, PassageIndex] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    def indexes(self) -> Iterator[tuple[pa.Array, PassageIndex]]:
        """(item ids, index) of each block; that of a single block is built once."""
        for k, block in enumerate(self.blocks):
            rows = block.value
            if self.built is None or self.built[0] != k:
                self.built = k, PassageIndex(rows.column("text").to_pylist(), self.rate, self.least)
            yield rows.column("item").combine_chunks() if len(rows) else pa.array([], rows.schema.field("item").type), self.built[1]
            if len(self.blocks) > 1:
                vars(block).pop("_value", None)  # a worker keeps what it has read, and would hold all blocks in the end

    def batches(self, batches: Iterator[pa.RecordBatch], text_col: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Batches with the bytes and offsets of their lower-cased texts: small ones for one block, and for several large
        ones, so that the time to build an index is little beside that of its use."""
        for batch in batches:
            data, offsets = text_bytes(pc.utf8_lower(batch.column(text_col)))
            for lo, hi in pieces(offsets, 1 << 20 if len(self.blocks) == 1 else 1 << 26):
                yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, block_bytes: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, edits, end (in the folded text) and length of every benchmark item of which a window of up to WINDOW
    bytes stands in a text of docs with at most rate * its length edits.

    Texts are compared without case, punctuation and differences of white space. One rule holds for items of any length: an
    item is its windows, WINDOW bytes at a stride of STRIDE and one at the end, or as a whole if shorter; so a verbatim
    quotation of WINDOW + STRIDE - 1 bytes is found wherever it begins. Under 2 * Q bytes no edit is allowed and the item
    must stand there as whole words. length is that of the item's longest region found, edits and end those of the best
    window in it.

    A text that quotes an item more than once gives one row, with the best match. Items may have any ids: null ones and those
    that several texts share give their rows each, equal rows of the benchmark count once. Null and empty texts on either
    side have no match; null document ids and repeated rows give their rows each; empty tables give no rows; other columns
    are ignored. The documents are read once, whatever the benchmark's size.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    passages = Passages(benchmark, rate, block_bytes, item_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in passages.batches(batches, 1):
            for items, index in passages.indexes():
                for lo, hi in pieces(offsets, 1 << 20):
                    found = index.regions(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    r, item, edits, end, n = (list(c) for c in zip(*found, strict=True)) if found else ([],) * 5
                    ids = batch.column(0).slice(lo, hi - lo).take(pa.array(r, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, items.take(pa.array(item, pa.int32())), pa.array(edits, pa.int32()), pa.array(end, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "edits", "end", "length"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, item_id {passages.item_type}, edits int, end long, length long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.08, block_bytes: int = 1 << 22, least: int = 0, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs for which find_leaks has no row, all columns as they were; no text is shuffled.

    Items of less than `least` folded bytes are no ground for dropping a text. A benchmark with items like "Yes.", a letter or
    a number, which stand in clean texts as well, needs a `least` above their length, or nothing is left of a corpus.
    """
    at = docs.columns.index(text_col)
    passages = Passages(benchmark, rate, block_bytes, item_col, text_col, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in passages.batches(batches, at):
            clean = np.ones(len(batch), bool)
            for _, index in passages.indexes():
                for lo, hi in pieces(offsets, 1 << 20):
                    windows, words = index.search(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], first_only=True)
                    clean[[lo + r for r, *_ in windows + words]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
