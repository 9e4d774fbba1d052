"""Near copies by an exact join of word shingle sets: prefix filter, verification of every candidate, components."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .licenses import LOWER
from .support import MULTIPLIER, batch_pieces, cut_lineage, mixed, power_tables, span_hashes, spans

BLANK = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])

#: Least and most words of 64 bits of the filter that tells which sets a verification needs. It has 16 bits a node, up to
#: 32 MB for 16 million nodes; with more of them, false hits become more frequent, which cost rows, not results.
FILTER_WORDS = (1 << 12, 1 << 22)

#: Nodes that a task remembers as already emitted, so that copies of a text are emitted once by a task.
REMEMBERED = 1 << 20

#: How often, at most, nodes are tied to the nearest ones before all pairs are weighed.
NEAREST_ROUNDS = 8

#: Pairs up to which sets are compared without a look at bitmaps, which would cost more than it spares.
FEW_PAIRS = 1 << 10

#: Pairs of nearest nodes up to which all pairs are weighed at once: the square of so few nodes is small.
FEW_NEAREST = 1 << 7

#: Words of 64 bits of the bitmap that bounds what two sets can share, where it goes with every row of a group.
BITMAP_WORDS = 16

#: Most texts of a group that can become pairs of texts and the number of their meetings; larger ones stay rows.
FEW = 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all lower-cased words, where each text's words begin, and a key of each text's words (0 without a word)."""
    data = LOWER[data]
    starts, ends = spans(~BLANK[data], offsets)
    words = mixed(span_hashes(data, starts, ends))
    first = np.searchsorted(starts, offsets)
    up, down = power_tables(len(words) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], dtype=np.uint64, out=prefix[1:])
        return words, first, mixed((prefix[first[1:]] - prefix[first[:-1]]) * down[first[:-1]])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the `width` words that begin at each word, for all but the last ones."""
    n = max(0, len(words) - width + 1)
    out, power = np.zeros(n, np.uint64), 1
    with np.errstate(over="ignore"):
        for k in range(width):
            out += words[k : k + n] * np.uint64(power)
            power = power * MULTIPLIER & ((1 << 64) - 1)
    return mixed(out)


def text_keys(docs: DataFrame, node_col: str, text_col: str = "text", wanted=None) -> DataFrame:
    """docs with node_col, a key of the words of each text; equal words have equal keys. wanted: only rows whose keys it picks."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batch_pieces(batches, at):
            node = word_hashes(data, offsets)[2].view(np.int64)
            rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], [*batch.schema.names, node_col])
            yield rows if wanted is None else rows.filter(pa.array(wanted(node)))

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias(node_col)).schema)


def sets_of(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[tuple[int, np.ndarray]]:
    """(node, sorted set of shingles) of the texts of at least `width` words whose nodes `wanted` picks."""
    seen: set[int] = set()
    for _, data, offsets in batch_pieces(batches, 0):
        words, first, nodes = word_hashes(data, offsets)
        hashes = shingles(words, width)
        nodes = nodes.view(np.int64)
        for r in np.flatnonzero((np.diff(first) >= width) & wanted(nodes)).tolist():
            node = int(nodes[r])
            if node in seen:
                continue
            if len(seen) < REMEMBERED:
                seen.add(node)
            yield node, np.unique(hashes[first[r] : first[r + 1] - width + 1])


def common_shingles(texts: DataFrame, n_nodes: int, width: int, sample: int = 4000, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample share, sorted, and their ranks by frequency.

    They come last in the order of shingles. Any order gives the same pairs, this one fewer candidates."""
    every = max(1, n_nodes // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, found in sets_of(batches, width, lambda x: x.view(np.uint64) % np.uint64(every) == 0):
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), node))], ["shingle", "node"])

    rows = texts.mapInArrow(run, "shingle long, node long").distinct().groupBy("shingle").count().where(F.col("count") >= least)
    top = rows.orderBy(F.desc("count"), "shingle").limit(most).collect()
    values = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], len(top) - order


def prefix_sql(n: str, least: Fraction) -> str:
    """The length of the prefix of a set of n, n - ceil(least * n) + 1."""
    return f"({n} * {least.denominator - least.numerator} div {least.denominator} + 1)"


def after(least: Fraction):
    """What two sets of na and nb can share at most behind the prefix that ends first."""
    return F.greatest(*[F.expr(f"{n} - {prefix_sql(n, least)}") for n in ("na", "nb")])


def postings(texts: DataFrame, width: int, least: Fraction, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(shingle, node, n, pos, rep, block) of the shingles in the prefixes of texts that share them with a text of like size.

    Two sets with a similarity of `least` or more share at least ceil(least * n) of the n shingles of either, so they
    meet in the first n - ceil(least * n) + 1 of each in any fixed order. rep is the least node of a group, null for
    itself and where the sizes rule a pair out. block is the least node of a group of at most FEW, else the shingle: texts
    that share a passage meet in many shingles, but in few blocks.
    """
    hot, rank = common
    p, q = least.numerator, least.denominator

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "node", "n", "pos"])

        for node, found in sets_of(batches, width, lambda x: np.ones(len(x), bool)):
            n = len(found)
            k = n + (-n * p // q) + 1
            if len(hot):
                at = np.searchsorted(hot, found)
                at[at == len(hot)] = 0
                is_hot = hot[at] == found
                if is_hot[:k].any():
                    found = np.concatenate([found[~is_hot], found[is_hot][np.argsort(rank[at[is_hot]], kind="stable")]])
            held.append((found[:k].view(np.int64), np.full(k, node), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)))
            size += k
            if size >= 100_000:
                yield batch()
                size = 0
        if held:
            yield batch()

    def shared(rows: list[np.ndarray]) -> pa.RecordBatch:
        shingle, n, node, pos = rows
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (n[1:] != n[:-1]) | (node[1:] != node[:-1]))
        shingle, n, node, pos = (x[new] for x in (shingle, n, node, pos))
        near = (shingle[1:] == shingle[:-1]) & (n[:-1].astype(np.int64) * q >= n[1:].astype(np.int64) * p)
        keep = np.append(False, near) | np.append(near, False)
        shingle, n, node, pos, new = (x[keep] for x in (shingle, n, node, pos, ~np.append(False, near)))
        starts = np.flatnonzero(new)
        if len(starts):
            order = np.lexsort((node, np.cumsum(new)))
            sizes = np.diff(np.append(starts, len(new)))
            first = np.repeat(order[starts], sizes)
            least_, mine = n[first].astype(np.int64), n.astype(np.int64)
            fits = (node[first] != node) & (np.minimum(least_, mine) * q >= np.maximum(least_, mine) * p)
            rep = pa.array(node[first], mask=~fits)
            block = pa.array(np.where(np.repeat(sizes, sizes) <= FEW, node[first], shingle))
        else:
            rep = block = pa.array([], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(node), pa.array(n), pa.array(pos), rep, block], ["shingle", "node", "n", "pos", "rep", "block"])

    rows = texts.mapInArrow(prefixes, "shingle long, node long, n int, pos int").select("shingle", "n", "node", "pos")
    dealt = rows.repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    return dealt.mapInArrow(lambda batches: map(shared, whole_groups(batches)), "shingle long, node long, n int, pos int, rep long, block long")


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, in parts that hold whole groups of the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        key = held[-1][0]
        last = int(np.searchsorted(key, key[-1]))
        if last == 0 or sum(len(h[0]) for h in held) < least:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = len(whole[0]) - (len(key) - last)
        yield [c[:cut] for c in whole]
        held = [[c[cut:] for c in whole]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def bitmap(items: np.ndarray, words: int = BITMAP_WORDS) -> np.ndarray:
    """A bitmap of a set: each item turns one bit over. The bits in which two bitmaps differ are at most the items that only
    one of the sets has, so two sets of a and b items share at most (a + b - differing bits) / 2."""
    turned = np.bincount((items >> np.uint64(17)) % np.uint64(64 * words), minlength=64 * words) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of as many words of the same set; both numbers of words are powers of 2."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def node_filter(nodes: DataFrame, n_nodes: int | None = None):
    """A test of arrays of nodes that holds for every node of nodes (n_nodes, if that is known), and for few others."""
    least, most = FILTER_WORDS
    size = min(most, max(least, 1 << ((nodes.count() if n_nodes is None else n_nodes) // 4).bit_length()))
    word, bit = F.expr(f"pmod(shiftrightunsigned(node, 6), {size})"), F.expr("shiftleft(1L, cast(node & 63 as int))")
    words = np.zeros(size, np.int64)
    found = nodes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # `size` rows at most
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    filter_ = words.view(np.uint64)

    def wanted(found: np.ndarray) -> np.ndarray:
        x = found.view(np.uint64)
        return (filter_[(x >> np.uint64(6)) % np.uint64(size)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)

    return wanted


def row_pairs(group: np.ndarray, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places (a, b), a before b, with equal values in the sorted group, about `block` at once."""
    if not len(group):
        return
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    stop = np.repeat(np.append(starts[1:], len(group)), np.diff(np.append(starts, len(group))))
    rows = np.arange(len(group))
    work = np.cumsum(stop - rows)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + block, "right")))
        more = stop[lo:hi] - rows[lo:hi] - 1
        yield np.repeat(rows[lo:hi], more), np.repeat(rows[lo:hi] + 1 - (np.cumsum(more) - more), more) + np.arange(more.sum())
        lo = hi


def can_tie(component: np.ndarray, n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether rows a and b of a group, sorted by n, are of two components and leave room for a similarity of `least` by their
    sizes and positions."""
    p, q = least.numerator, least.denominator
    room = np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b])
    return (component[a] != component[b]) & (n[a] * q >= n[b] * p) & (room * (p + q) >= p * (n[a] + n[b]))


def divided(found: DataFrame, least: Fraction, few: int = 0) -> DataFrame:
    """The rows (shingle, n, node, pos, component) of the shingles whose nodes don't all hang together.

    Groups of at most `few` rows are dealt by block and become rows (null, na, a, null, null, b, nb, met), pairs of nodes that
    can be tied and how often they have met in a task, where a block has no more such pairs than rows. So what comes out never
    outnumbers what goes in, however large families grow; texts that share a passage share many shingles and are far fewer pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = MetPairs()

        def pairs() -> pa.RecordBatch:
            a, b, na, nb, times = met.batch().columns
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([none, na.cast(pa.int32()), a, none.cast(pa.int32()), none, b, nb.cast(pa.int32()), times], names)

        for block, *columns in whole_groups(batches):
            shingle, component = columns[0], columns[4]
            starts = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (block[1:] != block[:-1])))
            sizes = np.diff(np.append(starts, len(shingle)))
            apart = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
            keep = np.repeat(apart & (sizes > few), sizes)
            small = np.flatnonzero(np.repeat(apart & (sizes <= few), sizes))
            if len(small):
                group, block = np.repeat(starts, sizes)[small], np.unique(block[small], return_inverse=True)[1]
                tally = block_pairs(group, block, *(c[small].astype(np.int64) for c in columns[1:]), least)
                fewer = np.bincount(tally[:, 0], minlength=block[-1] + 1) <= np.bincount(block)
                keep[small[~fewer[block]]] = True
                met.add(tally[fewer[tally[:, 0]], 1:])
            rows = [pa.array(c[keep]) for c in columns]
            yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(rows[0]), kind) for kind in (pa.int64(), pa.int32(), pa.int64()))], names)
            if met.full():
                yield pairs()
        yield pairs()

    names = ["shingle", "n", "node", "pos", "component", "other", "n_other", "met"]
    key = "block" if few else "shingle"
    dealt = found.select(F.col(key).alias("block"), *names[:5]).repartition("block").sortWithinPartitions("block", "shingle", "n", "node")
    return dealt.mapInArrow(run, "shingle long, n int, node long, pos int, component long, other long, n_other int, met long")


def block_pairs(group: np.ndarray, block: np.ndarray, n: np.ndarray, node: np.ndarray, pos: np.ndarray, component: np.ndarray, least: Fraction) -> np.ndarray:
    """Rows of block, a, b, size of a, size of b, times met: the pairs of each block's groups that can be tied."""
    parts, held = [np.zeros((0, 6), np.int64)], 0
    for a, b in row_pairs(group):
        good = can_tie(component, n, pos, a, b, least)
        a, b = a[good], b[good]
        parts.append(np.concatenate([block[a][:, None], meetings(node, n, a, b)], axis=1))
        held += len(a)
        if held > 1 << 20:
            parts, held = [tallied(np.concatenate(parts), 3)], 0
    return tallied(np.concatenate(parts), 3)


def few_pairs(parts: DataFrame, least: Fraction) -> DataFrame:
    """Of the pairs among the rows of divided, those (a, b) that meet often enough, if they also met in all larger groups in
    which both stand: what is left out here isn't tied."""
    p, q = least.numerator, least.denominator
    crowded = parts.where("shingle is not null").groupBy("node").count()
    pairs = parts.where("shingle is null").groupBy(F.col("node").alias("a"), F.col("other").alias("b"), F.col("n").alias("na"), F.col("n_other").alias("nb")).agg(F.sum("met").alias("met"))
    for end in ("a", "b"):
        pairs = pairs.join(crowded.select(F.col("node").alias(end), F.col("count").alias(f"{end}_rows")), end, "left")
    met = F.col("met") + F.least(*[F.coalesce(f"{end}_rows", F.lit(0)) for end in ("a", "b")])
    return pairs.where((met + after(least)) * (p + q) >= p * (F.col("na") + F.col("nb"))).select("a", "b")


def neighbours(apart: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of nodes that stand next to each other, by size and node, in groups that are still apart and meet in a
    quarter of the shorter prefix or more: no more rows than apart has, and enough to tie most of a family together."""
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, n, node, _, component in whole_groups(batches):
            n = n.astype(np.int64)
            next_ = (shingle[1:] == shingle[:-1]) & (component[1:] != component[:-1]) & (n[:-1] * q >= n[1:] * p)
            at = np.flatnonzero(next_)
            a, b = np.minimum(node[at], node[at + 1]), np.maximum(node[at], node[at + 1])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.minimum(n[at], n[at + 1]))], ["a", "b", "n"])

    dealt = apart.select("shingle", "n", "node", "pos", "component").repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    met = dealt.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.count("*").alias("met"), F.min("n").alias("n"))
    return met.where(F.col("met") * 4 >= F.expr(prefix_sql("n", least))).select("a", "b")


def bitmaps(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, bits) of the texts whose nodes are among nodes, and of few others."""
    return of_texts(texts, width, node_filter(nodes), lambda found: bitmap(found).tobytes(), "bits", "binary", pa.binary())


def meetings(node: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row (a, b, size of a, size of b, 1) for each of rows a with that of rows b; the smaller node comes first."""
    swap = node[a] > node[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return np.stack([node[a], node[b], n[a], n[b], np.ones(len(a), np.int64)], axis=1)


def tallied(rows: np.ndarray, keys: int) -> np.ndarray:
    """One row for those that are equal in the first `keys` columns, with the sum of the last column."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort(rows[:, :keys].T[::-1])]
    new = np.flatnonzero(np.append(True, (rows[1:, :keys] != rows[:-1, :keys]).any(1)))
    out = rows[new]
    out[:, -1] = np.add.reduceat(rows[:, -1], new)
    return out


class MetPairs:
    """How often pairs of nodes have met in a task, summed up whenever many have come together."""

    def __init__(self, most: int = 1 << 18):
        self.parts: list[np.ndarray] = []
        self.held, self.most = 0, most

    def add(self, pairs: np.ndarray) -> None:
        """Rows of a, b, size of a, size of b, times met."""
        if len(pairs):
            self.parts.append(pairs)
            self.held += len(pairs)

    def full(self) -> bool:
        """Whether there are too many distinct pairs to hold."""
        if self.held > self.most:
            self.parts = [self.summed()]
            self.held = len(self.parts[0])
        return self.held > self.most // 2

    def summed(self) -> np.ndarray:
        return tallied(np.concatenate([np.zeros((0, 5), np.int64), *self.parts]), 2)

    def batch(self) -> pa.RecordBatch:
        rows = self.summed()
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["a", "b", "na", "nb", "met"])


def nearest(row: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Of pairs that are sorted by row, the place of each row's least apart."""
    order = np.lexsort((apart, row))
    return order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order


def open_rows(columns: list[np.ndarray], least: Fraction, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (shingle, n, node, pos, component, bits) the places (a, b) of those that meet and hang not together yet, and whose
    sizes, positions and bitmaps leave room for a similarity of `least`, with the bits in which they differ."""
    shingle, n, _, pos, component, bits = columns
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    p, q = least.numerator, least.denominator
    bits = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITMAP_WORDS)
    starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    apart = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
    at = np.flatnonzero(np.repeat(apart, np.diff(np.append(starts, len(shingle)))))
    for a, b in row_pairs(shingle[at], block):
        a, b = at[a], at[b]
        good = can_tie(component, n, pos, a, b, least)
        a, b = a[good], b[good]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
        good = (n[a] + n[b] - differ) * (p + q) >= 2 * p * (n[a] + n[b])
        yield a[good], b[good], differ[good]


def by_shingle(shared: DataFrame, bits: DataFrame) -> DataFrame:
    """shared (shingle, n, node, pos, component) with each node's bits, the rows of a shingle together and sorted."""
    with_bits = shared.join(bits, "node").select("shingle", "n", "node", "pos", "component", "bits")
    return with_bits.repartition("shingle").sortWithinPartitions("shingle", "n", "node")


def hopeful(shared: DataFrame, bits: DataFrame, least: Fraction) -> DataFrame:
    """The rows of shared, each once at most, that stand in a pair which open_pairs can give. What can be told of a pair at one
    meeting holds at all of them, so such a pair keeps all its meetings; most texts that only share a passage have no row left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_groups(batches):
            hit = np.zeros(len(columns[0]), bool)
            for a, b, _ in open_rows(columns, least):
                hit[a] = hit[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in columns[:5]], names)

    names = ["shingle", "n", "node", "pos", "component"]
    return by_shingle(shared, bits).mapInArrow(run, "shingle long, n int, node long, pos int, component long")


def open_pairs(shared: DataFrame, bits: DataFrame, least: Fraction, block: int = 1 << 15, nearest_only: bool = False) -> DataFrame:
    """The pairs (a, b) of shared (shingle, n, node, pos, component) that meet in a shingle, hang not together yet, and
    whose sizes, positions, bitmaps and number of meetings leave room for a similarity of `least`.

    All that two sets share up to the end of the prefix that ends first are meetings, so they share at most the number of
    meetings and what is left of that set. Pairs are weighed in the task where they meet, and a task gives each that is left
    once, with the number of its meetings there.

    nearest_only: of each node in a shingle's group only the pair with that node behind it whose bitmaps differ least, so no
    more pairs than shared has rows, and of those only the ones nearest in about half of the meetings that a tie needs; the
    rest is left to the pass over all pairs. bits: (node, bits) of all nodes."""
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = MetPairs()
        for columns in whole_groups(batches):
            n, node = columns[1].astype(np.int64), columns[2]
            for a, b, differ in open_rows(columns, least, block):
                if nearest_only:
                    best = nearest(a, differ / (n[a] + n[b]))
                    a, b = a[best], b[best]
                met.add(meetings(node, n, a, b))
                if met.full():
                    yield met.batch()
        yield met.batch()

    met = by_shingle(shared, bits).mapInArrow(run, "a long, b long, na long, nb long, met long").groupBy("a", "b", "na", "nb").agg(F.sum("met").alias("met"))
    if nearest_only:
        return met.where(F.col("met") * 4 >= F.expr(prefix_sql("least(na, nb)", least))).select("a", "b")
    return met.where((F.col("met") + after(least)) * (p + q) >= p * (F.col("na") + F.col("nb"))).select("a", "b")


def of_texts(texts: DataFrame, width: int, wanted, value, column: str, kind: str, arrow: pa.DataType, most: int = 1 << 20) -> DataFrame:
    """(node, column) of the texts whose nodes `wanted` picks, column being value(their sorted set of shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        values: list = []
        size = 0
        for node, found in sets_of(batches, width, wanted):
            nodes.append(node)
            values.append(value(found))
            size += len(found)
            if size >= most >> 3:
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(values, arrow)], ["node", column])
                nodes, values, size = [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(values, arrow)], ["node", column])

    return texts.mapInArrow(run, f"node long, {column} {kind}").groupBy("node").agg(F.first(column).alias(column))


def with_both(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with a_column and b_column, what rows (node, column) has for either."""
    for end in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("node").alias(end), F.col(column).alias(f"{end}_{column}")), end)
    return pairs


def screened(pairs: DataFrame, texts: DataFrame, width: int, least: Fraction, n_pairs: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps, of four to eight bits a shingle, leave room for a similarity of `least`: about a byte
    a shingle at most goes with a pair, where the set has eight."""
    p, q = least.numerator, least.denominator

    def sketch(found: np.ndarray) -> bytes:
        return len(found).to_bytes(8, "little") + bitmap(found, max(BITMAP_WORDS, 1 << (len(found) // 16).bit_length())).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for r, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both, words = int(x[0]) + int(y[0]), min(len(x), len(y)) - 1
                differ = int(np.bitwise_count(folded(x[1:], words) ^ folded(y[1:], words)).sum())
                keep[r] = (both - differ) * (p + q) >= 2 * p * both
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    wanted = node_filter(pairs.select(F.explode(F.array("a", "b")).alias("node")), 2 * n_pairs)
    sketches = of_texts(texts, width, wanted, sketch, "bits", "binary", pa.binary())
    return with_both(pairs, sketches, "bits").select("a", "b", "a_bits", "b_bits").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: Fraction) -> DataFrame:
    """The pairs (a, b), as links (u, v), whose sets of shingles have a similarity of `least` or more."""
    n_pairs = pairs.count()
    if n_pairs > FEW_PAIRS:
        pairs = cut_lineage(screened(pairs, texts, width, least, n_pairs))
        n_pairs = pairs.count()
    if not n_pairs:
        return pairs.toDF("u", "v")
    wanted = node_filter(pairs.select(F.explode(F.array("a", "b")).alias("node")), 2 * n_pairs)
    sets = of_texts(texts, width, wanted, lambda found: found.view(np.int64), "items", "array<long>", pa.list_(pa.int64()))
    both = with_both(pairs, sets, "items")
    common = F.size(F.array_intersect("a_items", "b_items"))
    p, q = least.numerator, least.denominator
    return both.where(common * (p + q) >= p * (F.size("a_items") + F.size("b_items"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the component of each node: its own name, if it is tied to none."""
    tied = found.withColumnRenamed("node", "tied")
    return rows.join(tied, rows["node"] == tied["tied"], "left").withColumn("component", F.coalesce("component", "node")).drop("tied")


def again_divided(apart: DataFrame, found: DataFrame, least: Fraction) -> DataFrame:
    """The rows of apart of the shingles whose nodes don't all hang together by the components found."""
    return divided(placed(apart.drop("component"), found), least).select(apart.columns)


def similar_texts(texts: DataFrame, n_nodes: int, *, width: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """(node, component) of every text (column text) that is tied to another, directly or by way of others: two are tied
    if the Jaccard similarity of their sets of `width`-word shingles is `least` or more.

    No tie is missed and none is by chance. Each text is verified first against one representative of each group that it
    meets in. Of groups of few texts that are still apart then, all pairs are counted where they are no more than the rows, and
    those that meet often enough are verified. Of the rest neighbours are compared, rows whose bitmaps tell them from all
    others that they meet are left out, then each node is compared with the one of another component that seems nearest, and at last all pairs that meet and don't hang together yet, so a large family of near copies costs no rows for what
    these ties hold together already. Texts of fewer words are equal or unlike.
    """
    rows = cut_lineage(postings(texts, width, least, common_shingles(texts, n_nodes, width)))
    led = rows.where(F.col("rep").isNotNull()).groupBy(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).agg(F.count("*").alias("met"), F.min("n").alias("n"))
    led = led.where(F.col("met") * 4 >= F.expr(prefix_sql("n", least))).select("a", "b")  # what is left out here is compared below
    links = cut_lineage(verified(cut_lineage(led), texts, width, least))
    found = connected_components(links)
    parts = cut_lineage(divided(placed(rows, found), least, FEW))
    apart = parts.where("shingle is not null").select("shingle", "n", "node", "pos", "component")
    more = cut_lineage(verified(cut_lineage(few_pairs(parts, least).union(neighbours(apart, least)).distinct()), texts, width, least))
    if not more.isEmpty():
        links = links.unionByName(more)
        found = connected_components(links)
        apart = cut_lineage(placed(apart.drop("component"), found).select(apart.columns))
    if apart.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").isEmpty():
        return found
    bits = cut_lineage(bitmaps(texts, apart.select("node").distinct(), width))
    apart = cut_lineage(hopeful(apart, bits, least))
    for _ in range(NEAREST_ROUNDS):
        pairs = cut_lineage(open_pairs(apart, bits, least, nearest_only=True))
        n_pairs = pairs.count()
        if n_pairs <= FEW_NEAREST:
            break
        more = cut_lineage(verified(pairs, texts, width, least))
        n_more = more.count()
        if not n_more:
            break
        links = links.unionByName(more)
        found = connected_components(links)
        apart = cut_lineage(again_divided(apart, found, least))
        if 2 * n_more < n_pairs:  # what is left are mostly pairs that aren't tied, each of which has to be compared
            break
    left = cut_lineage(open_pairs(apart, bits, least))
    if left.isEmpty():
        return found
    more = cut_lineage(verified(left, texts, width, least))
    return found if more.isEmpty() else connected_components(links.unionByName(more))


def near_copies(docs: DataFrame, *, width: int = 5, least: Fraction = Fraction(4, 5), node_col: str = "node", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """docs with the column node_col (a key of each text's words), and (node, component, first_id, n_rows) of all nodes: texts of one
    component are equal in words or tied by a similarity of `least` or more of their sets of `width`-word shingles;
    first_id is the least id of a node's n_rows rows.
    """
    keyed = text_keys(docs, node_col, text_col)
    ids = cut_lineage(keyed.select(F.col(id_col).alias("id"), F.col(node_col).alias("node")).groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("n_rows")))
    tied = similar_texts(docs.select(F.col(text_col).alias("text")), ids.count(), width=width, least=least)
    return keyed, placed(ids, tied).select("node", "component", "first_id", "n_rows")
