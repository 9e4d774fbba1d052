"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import free_name, pieces as row_ranges
from .support import text_bytes

#: The white-space marker of piece files. Inside this module a blank stands for it, so a marker that a text holds itself
#: isn't taken for one and survives as bytes.
MARKER = "▁"

#: Pieces begin with a run of blanks or have none, and none holds a line feed: no piece crosses these bounds.
UNITS = re.compile(rb" +[^ \n]*|[^ \n]+|\n")

#: What a character that no piece covers costs beyond the rarest piece.
UNKNOWN_PENALTY = 10.0

#: Bytes of units and ids that a worker remembers before it starts afresh, what an entry takes besides, and the longest unit
#: that is remembered: longer ones hardly come again.
REMEMBERED, ENTRY, LONGEST = 32 << 20, 160, 64


class DoubleArray:
    """A trie of byte strings in two arrays: the child of node n by byte b is base[n] + b, if check of it is n."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, key in enumerate(keys):
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            ends[node] = k
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        place, free = {0: 0}, 1
        queue = [0]
        for node in queue:
            at = place[node]
            value[at] = ends.get(node, -1)
            codes = sorted(children[node])
            if not codes:
                continue
            while check[free] >= 0:
                free += 1
            start = max(free - codes[0], 1 - codes[0])
            while any(check[start + c] >= 0 for c in codes):
                start += 1
                if start + 512 > len(check):
                    base += [0] * len(base)
                    value += [-1] * len(check)
                    check += [-1] * len(check)
            base[at] = start
            for c in codes:
                check[start + c] = at
                place[children[node][c]] = start + c
                queue.append(children[node][c])
            while free + 1024 > len(check):
                base += [0] * len(base)
                value += [-1] * len(check)
                check += [-1] * len(check)
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))

    def matches(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key) of every key that stands anywhere in data; ends[i] is where the unit with byte i ends."""
        starts = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        found, depth = [], 0
        while len(starts):
            to = self.base[node] + data[starts + depth]
            ok = (to >= 0) & (to < len(self.check))
            ok[ok] = self.check[to[ok]] == node[ok]
            starts, node = starts[ok], to[ok]
            depth += 1
            key = self.value[node]
            hit = key >= 0
            found.append((starts[hit], starts[hit] + depth, key[hit]))
            more = starts + depth < ends[starts]
            starts, node = starts[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def unit_parts(text: bytes, longest: int) -> Iterator[bytes]:
    """A text in parts of about `longest` bytes; each but the first begins with a blank that no blank precedes."""
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + longest)
        while hi > 0 and text[hi - 1] == 32:
            hi = text.find(b" ", hi + 1)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi]
        lo = hi


@dataclass
class PieceModel:
    """Pieces (blanks for markers) with their ids and log scores, and the ids of the 256 bytes."""

    surface: list[bytes]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: DoubleArray = field(init=False)

    def __post_init__(self) -> None:
        if any(b" " in p.lstrip(b" ") or b"\n" in p for p in self.surface):
            raise ValueError("a piece crosses the bounds of units")
        self.trie = DoubleArray(self.surface)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "held": 0}

    @staticmethod
    def load(path: str) -> PieceModel:
        """The pieces of a model file. Where the file ranks pieces (a BPE file's scores are minus the rank), Zipf's law gives
        them log scores: the piece of rank r has a chance in proportion to 1 / (r + 2)."""
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(file.get_piece_size()) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))]
        byte_ids = np.zeros(256, np.int32)
        for i in range(file.get_piece_size()):
            if file.is_byte(i):
                byte_ids[int(file.id_to_piece(i)[3:5], 16)] = i
        rank = np.argsort(np.argsort([-file.get_score(i) for i in normal], kind="stable"), kind="stable")
        chance = 1.0 / (rank + 2.0)
        surface = [file.id_to_piece(i).replace(MARKER, " ").encode() for i in normal]
        return PieceModel(surface, np.array(normal, np.int32), np.log(chance / chance.sum()), byte_ids)

    def segment(self, units: list[bytes]) -> list[bytes]:
        """The ids, as bytes of int32, of the best segmentation of each unit; all units step forward together."""
        size = np.array([len(u) for u in units], np.int64)
        data = np.frombuffer(b"".join(units), np.uint8)
        first = np.concatenate([[0], np.cumsum(size)])
        unit = np.repeat(np.arange(len(units)), size)
        start, end, key = self.trie.matches(data, first[unit + 1])
        score = self.scores[key]
        # Characters that are no piece may be passed as unknown.
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        lead_end = np.append(lead[1:], len(data))
        char_end = np.zeros(len(data), np.int64)
        char_end[lead] = lead_end
        covered = np.zeros(len(data), bool)
        covered[start[char_end[start] == end]] = True
        bare = ~covered[lead]
        start = np.concatenate([start, lead[bare]])
        end = np.concatenate([end, lead_end[bare]])
        key = np.concatenate([key, np.full(bare.sum(), -1)])
        score = np.concatenate([score, np.full(bare.sum(), self.scores.min() - UNKNOWN_PENALTY)])
        # Places are numbered with one more for each unit, for its end.
        offset = start - first[unit[start]]
        order = np.argsort(offset, kind="stable")
        a, b = (start + unit[start])[order], (end + unit[start])[order]
        score = score[order]
        best = np.full(len(data) + len(units), -np.inf)
        best[first[:-1] + np.arange(len(units))] = 0
        back = np.full(len(best), -1)
        cuts = np.searchsorted(offset[order], np.arange(int(size.max(initial=0)) + 1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            reached = best[a[lo:hi]] + score[lo:hi]
            better = np.flatnonzero(reached > best[b[lo:hi]])
            best[b[lo:hi][better]] = reached[better]
            back[b[lo:hi][better]] = better + lo
        chosen, at = [], (first[1:] + np.arange(len(units)))[size > 0]
        while len(at):
            edge = back[at]
            chosen.append(edge)
            at = a[edge]
            at = at[back[at] >= 0]
        edge = order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)
        edge = edge[np.argsort(start[edge])]
        times = np.where(key[edge] >= 0, 1, end[edge] - start[edge])
        source = np.repeat(start[edge] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        out = np.where(np.repeat(key[edge] >= 0, times), self.ids[np.repeat(key[edge], times)], self.byte_ids[data[source]]).astype(np.int32)
        per_unit = np.bincount(unit[start[edge]], times, len(units)).astype(np.int64)
        raw, cut = out.tobytes(), (4 * np.concatenate([[0], np.cumsum(per_unit)])).tolist()
        return [raw[x:y] for x, y in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: list[bytes], longest: int = 1 << 20) -> list[bytes]:
        """The ids of each text, as bytes of int32. A blank is put before a text that isn't empty. A text of over `longest`
        bytes is encoded in parts that end before the first blank of a unit."""
        if any(len(t) > longest for t in texts):
            return [self.encode([t])[0] if len(t) <= longest else b"".join(self.encode_units([UNITS.findall(p)])[0] for p in unit_parts(b" " + t, longest)) for t in texts]
        return self.encode_units([UNITS.findall(b" " + t) if t else [] for t in texts])

    def encode_units(self, split: list[list[bytes]]) -> list[bytes]:
        """The ids of texts that are lists of units."""
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        new = list(set().union(*split) - self.known.keys())
        sizes = np.concatenate([[0], np.cumsum([len(u) for u in new])]).astype(np.int64)
        long: dict[bytes, bytes] = {}
        for lo, hi in row_ranges(sizes, 1 << 17):
            for unit, ids in zip(new[lo:hi], self.segment(new[lo:hi]), strict=True):
                if len(unit) > LONGEST:
                    long[unit] = ids
                else:
                    self.known[unit] = ids
                    self.held += len(unit) + len(ids) + ENTRY
        if not long:
            get = self.known.__getitem__
            return [b"".join(map(get, units)) for units in split]
        return [b"".join([long[u] if len(u) > LONGEST else self.known[u] for u in units]) for units in split]

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's begin; control pieces have none."""
        surface = dict(zip(self.ids.tolist(), self.surface, strict=True)) | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        line = [surface.get(i, b"") for i in range(max(surface) + 1)]
        return np.frombuffer(b"".join(line), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in line])])


def encode_pieces(docs: DataFrame, model: PieceModel, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), batch_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, pieces (ids) and n_pieces of every row of docs, with the columns named in carry.

    Whole texts are encoded; nothing is normalised, so decoding gives a text back byte for byte. A null or empty text has
    no pieces (an empty list). Null ids and repeated rows give one row each, an empty table none. A carried column with the
    name of one of the result's has underscores behind it there.
    """
    names = ["doc_id", *carry]
    taken, shown = {"doc_id", "pieces", "n_pieces"}, ["doc_id"]
    for name in carry:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        shown.append(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(names)))
            raw = data.tobytes()
            for lo, hi in row_ranges(offsets, batch_bytes):
                at = offsets[lo : hi + 1].tolist()
                ids = model.encode([raw[a:b] for a, b in zip(at, at[1:], strict=False)])
                n = np.array([len(x) // 4 for x in ids], np.int64)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(names))), lists, pa.array(n)], [*shown, "pieces", "n_pieces"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(n) for c, n in zip(carry, shown[1:], strict=True)], F.col(text_col).alias("text_of_"))
    types = ", ".join(f"`{n}` {rows.schema[i].dataType.simpleString()}" for i, n in enumerate(shown))
    return rows.mapInArrow(run, f"{types}, pieces array<int>, n_pieces long")


def decode_pieces(encoded: DataFrame, model: PieceModel, *, pieces_col: str = "pieces") -> DataFrame:
    """encoded with a column decoded: the texts of its lists of ids, blanks for markers and without the one at the start.

    A null list gives null, an empty one the empty text; ids that don't exist or are control pieces give nothing, and
    bytes that aren't UTF-8 give replacement characters. Where encoded has a column of that name already, the new one has
    underscores behind its own. An empty table gives no rows.
    """
    table, begin = model.decoder()
    names, decoded = encoded.columns, free_name(encoded, "decoded")
    at = names.index(pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(whole.column(at)), 0).to_numpy().astype(np.int64))])
            for lo, hi in row_ranges(offsets, 1 << 17):
                batch = whole.slice(lo, hi - lo)
                lists = batch.column(at)
                ids = pc.fill_null(lists.flatten(), -1).to_numpy()
                ids = np.where((ids >= 0) & (ids < len(begin) - 1), ids, len(begin) - 1)
                n = np.append(np.diff(begin), 0)[ids]
                source = np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                raw = table[source].tobytes()
                cut = np.concatenate([[0], np.cumsum(n)])[offsets[lo : hi + 1] - offsets[lo]].tolist()
                out = [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]
                text = pa.array(out, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns, text], [*names, decoded])

    types = ", ".join(f"`{n}` {encoded.schema[n].dataType.simpleString()}" for n in names)
    return encoded.select(*names).mapInArrow(run, f"{types}, `{decoded}` string")
