"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import StarLinks, connected_components, star
from .shingles import whole_groups
from .support import batch_pieces, cut_lineage

BITS = 64

#: Which of a byte's bits are set, the highest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_PLACE = (256 * np.arange(8, dtype=np.int16))[None, :]


def fingerprint(text: bytes, width: int, seed: int) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    del words
    starts, stops = np.concatenate([[0], ends[: n - 1]]), (ends[width - 1 :] if len(ends) > width else ends[-1:]) - 1
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, n, 1 << 16):
        part = [joined[s:e] for s, e in zip(starts[at : at + (1 << 16)].tolist(), stops[at : at + (1 << 16)].tolist(), strict=True)]
        digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, part, repeat(seed))), np.uint8).reshape(-1, 8)
        counts += np.bincount((digests + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (a signed long of 64 bits) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batch_pieces(batches, 1):
            at = offsets.tolist()
            raw = data.tobytes()
            out = np.array([fingerprint(raw[a:b], width, seed) for a, b in zip(at, at[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, fingerprint long")


@dataclass(frozen=True)
class Partition:
    """A group of bit positions, the most bits in which a probe may differ there, and the expected cost."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    @property
    def flips(self) -> list[int]:
        return [signed(sum(1 << b for b in c)) for n in range(self.threshold + 1) for c in combinations(self.bits, n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j set, for all pairs; tasks send 4096 sums each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            for lo in range(0, len(batch), 1 << 14):
                x = batch.column(0).slice(lo, 1 << 14).to_numpy().view(np.uint64)
                ones = (x[:, None] >> np.arange(BITS, dtype=np.uint64)[None] & np.uint64(1)).astype(np.float32)
                total += ones.T @ ones
                n += len(x)
        if n:
            at = np.arange(BITS * BITS + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n))], ["at", "n"])

    sums = nodes.select("fingerprint").mapInArrow(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BITS * BITS + 1)
    out[sums["at"]] = sums["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(n: int, pairs: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """The bits in `parts` groups of nearly equal number, correlated ones together: each group starts with the bit that
    is tied most strongly to the rest and takes in the bits that are tied most strongly to it."""
    p = np.diag(pairs) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(pairs / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(tie, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts, 0, -1):
        size = len(left) // k
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (tie[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        groups.append(tuple(sorted(group)))
    return groups


def candidate_costs(n: int, p: np.ndarray, bits: tuple[int, ...], equal_pairs: float, most: int, probe_cost: float) -> list[float]:
    """The estimated work of a partition at thresholds -1, 0, 1, ... most: probes sent, and candidate pairs met. Pairs that
    agree on all bits were counted; those within e are scaled from them as independent bits of these frequencies would."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    within = np.cumsum(chance) * n * n / 2
    scale = max(equal_pairs, 1.0) / max(within[0], 1e-9)
    return [0.0] + [probe_cost * n * sum(comb(len(bits), j) for j in range(e + 1)) + max(within[e], within[e] * scale) for e in range(most + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) that sum to `total` at the least cost, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for i, c in enumerate(cost):
                t = i - 1
                if used + t not in following or spent + c < following[used + t][0]:
                    following[used + t] = (spent + c, [*chosen, t])
        best = following
    return best[total]


def plan_partitions(nodes: DataFrame, distance: int, *, part_numbers: tuple[int, ...] = (2, 3, 4), probe_cost: float = 1.0) -> list[Partition]:
    """The partitioning with the least estimated work. Thresholds that sum to distance - parts + 1 lose no pair: were
    every partition over its threshold, the distance would be above `distance`."""
    n, pairs = bit_statistics(nodes)
    plans = []
    grouped = {m: group_bits(n, pairs, m) for m in part_numbers}
    masks = [(m, i, Partition(bits, 0).mask) for m, groups in grouped.items() for i, bits in enumerate(groups)]
    values = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(mask).cast("long")).alias("v")) for k, (_, _, mask) in enumerate(masks)])).alias("x"))
    equal = {r["k"]: r["pairs"] for r in values.groupBy("x.k", "x.v").count().groupBy("k").agg(F.sum(F.expr("double(count) * (count - 1) / 2")).alias("pairs")).collect()}
    p = np.diag(pairs) / max(n, 1)
    for m, groups in grouped.items():
        costs = [candidate_costs(n, p, bits, equal.get(next(k for k, x in enumerate(masks) if x[:2] == (m, i)), 0), distance, probe_cost) for i, bits in enumerate(groups)]
        spent, chosen = allocate(costs, distance - m + 1)
        plans.append((spent, m, [Partition(b, t) for b, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def spanning_links(key_starts: np.ndarray, fps: np.ndarray, own: np.ndarray, distance: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Links (each node to the least one that it hangs together with) of the rows of whole groups.

    Rows of a group start at key_starts; own marks the fingerprints that have the group's value, the others probe it.
    All of own x group is compared, block by block, and only a spanning star of each tie is kept.
    """
    ends = np.append(key_starts[1:], len(fps))
    size = ends - key_starts
    owners = np.add.reduceat(own.astype(np.int64), key_starts) if len(key_starts) else np.zeros(0, np.int64)
    live = (owners > 0) & (size > 1)
    rows = np.flatnonzero(own & np.repeat(live, size))
    group = np.repeat(np.arange(len(size)), size)[rows]
    us, vs = [], []
    work = np.cumsum(size[group])
    lo = 0
    while lo < len(rows):
        done = work[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(work, done + block, "right")))
        n = size[group[lo:hi]]
        a = np.repeat(rows[lo:hi], n)
        b = np.repeat(key_starts[group[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = (popcount(fps[a] ^ fps[b]) <= distance) & (fps[a] != fps[b])
        us.append(fps[a[near]])
        vs.append(fps[b[near]])
        if sum(map(len, us)) > 2 * block:
            us, vs = [[x] for x in star(np.concatenate(us), np.concatenate(vs))]
        lo = hi
    return star(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def near_links(nodes: DataFrame, distance: int, plan: list[Partition], *, most_rows: int = 50_000, most_hot: int = 10_000) -> DataFrame:
    """Links (u, v) that connect just what the pairs of fingerprints within `distance` connect.

    Every fingerprint is filed under its value in each partition and probes the values within the partition's threshold.
    Rows are dealt by (partition, value) and sorted; a task compares what meets there and keeps spanning links only, so
    a large group of near copies costs comparisons in memory, not rows.

    A group of over most_rows rows, or of over its share of all rows where that allows more than most_hot such groups, is
    cut into m blocks: its own rows of each block meet its rows of each block in a task of their own, so a task holds two
    blocks at a time, and a row is sent 2 m times at most.
    """

    def filed_under(k: int, part: Partition) -> Column:
        value = F.col("fingerprint").bitwiseAND(F.lit(part.mask).cast("long"))
        flips = F.array(*[F.lit(f).cast("long") for f in part.flips])
        return F.transform(flips, lambda f: F.struct(F.lit(k).cast("byte").alias("part"), value.bitwiseXOR(f).alias("value"), (f == 0).alias("own")))

    probes = [filed_under(k, part) for k, part in enumerate(plan)]
    filed = nodes.select("fingerprint", F.explode(F.concat(*probes)).alias("x")).select("x.part", "x.value", "x.own", "fingerprint")
    limit = max(most_rows, nodes.count() * sum(len(part.flips) for part in plan) // most_hot)
    sizes = filed.groupBy("part", "value").agg(F.count("*").alias("n"), F.max("own").alias("owned")).where((F.col("n") > limit) & F.col("owned"))
    hot = cut_lineage(sizes.select(F.col("part").alias("hot_part"), F.col("value").alias("hot_value"), F.ceil(F.col("n") / limit).cast("int").alias("m")))
    cell = lambda i, j, own: F.struct(i.alias("i"), j.alias("j"), own.alias("own"))
    whole = F.array(cell(F.lit(0), F.lit(0), F.col("own")))
    if not hot.isEmpty():  # most_hot rows at most
        filed = filed.join(F.broadcast(hot), (F.col("part") == F.col("hot_part")) & (F.col("value") == F.col("hot_value")), "left")
        block, all_ = F.pmod(F.xxhash64("fingerprint"), F.col("m")).cast("int"), F.sequence(F.lit(0), F.col("m") - 1)
        met = F.transform(all_, lambda i: cell(i, block, F.lit(False)))
        cells = F.when(F.col("m").isNull(), whole).when(F.col("own"), F.concat(met, F.transform(all_, lambda j: cell(block, j, F.lit(True))))).otherwise(met)
    else:
        cells = whole
    filed = filed.select("part", "value", "fingerprint", F.explode(cells).alias("c"))
    # Groups whose hashes are equal would be compared as one, which adds comparisons and no link.
    filed = filed.select(F.xxhash64("part", "value", "c.i", "c.j").alias("group"), "c.own", "fingerprint")
    filed = filed.repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = StarLinks()
        for group, own, fps in whole_groups(batches):
            u, v = spanning_links(np.flatnonzero(np.append(True, group[1:] != group[:-1])), fps.view(np.uint64), own, distance)
            found.add(u.view(np.int64), v.view(np.int64))
        yield found.batch()

    return filed.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, *, width: int = 3, seed: int = 42, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs.

    Fingerprints that differ in at most `distance` bits are linked; component_id is the smallest doc_id of all that are
    linked with a row, directly or by way of others. Equal fingerprints are one node from the start, so exact copies
    never meet. Null and empty texts, and texts without a word, have fingerprint 0 and are linked like any other; rows
    with a null id get a component but never name one that has other ids; repeated rows give one row each; an empty
    table gives no rows; other columns of docs are ignored.
    """
    rows = cut_lineage(fingerprints(docs, width=width, seed=seed, id_col=id_col, text_col=text_col))
    nodes = cut_lineage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    links = near_links(nodes, distance, plan_partitions(nodes, distance))
    tied = connected_components(links)
    placed = nodes.join(tied, nodes["fingerprint"] == tied["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    placed = cut_lineage(placed)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut_lineage(placed.select("fingerprint", "component").join(cut_lineage(named), "component").select("fingerprint", "component_id"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return rows.join(named, "fingerprint").select("doc_id", digits.alias("fingerprint"), "component_id")
