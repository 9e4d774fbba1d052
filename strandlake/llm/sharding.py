"""Sharding: sampled splitters cut the key space into ranges of equal weight, and ranges are dealt to shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut_lineage

LEAST = -(1 << 63)


def shard_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the key's first part, a hash of the text: all that sharding needs of a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )


def choose_splitters(keys: np.ndarray, ids: np.ndarray, weights: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (text_key, doc_id) of all ranges but the first, at the quantiles of a weighted sample.

    A text that is hit by one quantile starts a range, so its copies stay in one; a text that is hit by more is
    overfull: its copies get ranges of their own, cut by doc_id at those quantiles.
    """
    order = np.lexsort((ids, keys))
    keys, ids, weights = keys[order], ids[order], weights[order]
    total = np.cumsum(weights)
    at = np.unique(np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges, "left")) if len(keys) else np.zeros(0, int)
    bounds: set[tuple[int, int]] = set()
    for key, cuts in zip(*np.unique(keys[at], return_counts=True), strict=True):
        bounds.add((int(key), LEAST))
        if cuts > 1:
            bounds |= {(int(key), int(d)) for d in ids[at][keys[at] == key]}
            if key < (1 << 63) - 1:
                bounds.add((int(key) + 1, LEAST))
    both = np.array(sorted(bounds), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def range_numbers(keys: np.ndarray, ids: np.ndarray, bound_keys: np.ndarray, bound_ids: np.ndarray) -> np.ndarray:
    """How many lower bounds are at most (key, id)."""
    out = np.searchsorted(bound_keys, keys, "left")
    last = np.searchsorted(bound_keys, keys, "right")
    for i in np.flatnonzero(last > out):
        out[i] += np.searchsorted(bound_ids[out[i] : last[i]], ids[i], "right")
    return out


def deal(sizes: dict[int, int], texts: dict[int, int], shards: int) -> dict[int, int]:
    """Range -> shard, largest unit first to the lightest shard.

    Ranges that hold copies of one text only (texts[range]) form a unit, unless it outweighs a whole shard.
    """
    units: dict[tuple, list[int]] = {}
    for r in sorted(sizes):
        units.setdefault(("text", texts[r]) if r in texts else ("range", r), []).append(r)
    fair = sum(sizes.values()) / shards
    parts = [[r] for u in units.values() if sum(sizes[r] for r in u) > fair for r in u] + [u for u in units.values() if sum(sizes[r] for r in u) <= fair]
    parts.sort(key=lambda u: (-sum(sizes[r] for r in u), u[0]))
    heap, out = [(0, s) for s in range(shards)], {}
    for u in parts:
        load, s = heapq.heappop(heap)
        out |= dict.fromkeys(u, s)
        heapq.heappush(heap, (load + sum(sizes[r] for r in u), s))
    return out


def draw(rows: DataFrame, rate: Column, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text_key, id, weight) of rows drawn with a chance of size times rate, each weighing so that sums are as in rows."""
    drawn = F.shiftrightunsigned(F.xxhash64("text_key", "ident", F.lit(seed)), 11) * F.lit(2.0**-53) < F.col("size") * rate
    sample = rows.where(drawn).select("text_key", "ident", F.greatest(F.col("size").cast("double"), 1 / rate).alias("weight")).toPandas()
    return sample["text_key"].to_numpy(np.int64), sample["ident"].to_numpy(np.int64), sample["weight"].to_numpy(float)


def assign_shards(docs: DataFrame, shards: int = 8, *, ranges_per_shard: int = 256, draws_per_range: int = 16, rounds: int = 16, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its shard (0 to shards-1) and slot, under the law `bytes`: shards of near equal size.

    Columns: doc_id, size (UTF-8 bytes plus 1; a null text has none), text_crc32, law, shard, slot (0, 1, ... in each
    shard, in key order), grown_shard (null), range (the range that the row fell into).

    The key is (hash of the text, number of the row), so equal texts are neighbours and no two rows have one key. Rows are drawn with a chance in proportion to their
    size, shards * ranges_per_shard quantiles of the draws become splitters (a bounded number of rows on the driver, whatever
    the input's size), and ranges are counted exactly. A range of over twice the mean is subdivided: rows are drawn from it
    alone, as many as it is overfull, and their quantiles are splitters as well; so on until none is left that has more than one row, for `rounds` rounds at most. Ranges are dealt to
    shards; copies of one text share a shard unless they alone outweigh one, then their ranges are dealt singly.

    Null or empty texts have size 1 and share the key of the empty text. Rows with repeated ids or without one, and repeated rows,
    are rows like any other, and are cut as other copies of a text are. An empty table gives no rows; other columns of docs are ignored.
    """
    keys = cut_lineage(shard_keys(docs, id_col, text_col).withColumn("ident", F.monotonically_increasing_id()))
    ranges = shards * ranges_per_shard
    total = keys.agg(F.sum("size")).first()[0] or 0
    found = draw(keys, F.lit(ranges * draws_per_range / max(total, 1)), seed)
    bounds = choose_splitters(*found, ranges)

    def placed(bound_keys: np.ndarray, bound_ids: np.ndarray) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                numbers = range_numbers(b.column(3).to_numpy(), b.column(4).to_numpy(), bound_keys, bound_ids)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers.astype(np.int32))], [*b.schema.names, "range"])

        return keys.mapInArrow(place, "doc_id long, size long, text_crc32 long, text_key long, ident long, range int")

    mean = max(1, total / ranges)
    for turn in range(rounds + 1):
        rows = placed(*bounds)
        counts = rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min(F.struct("text_key", "ident")).alias("low"), F.max(F.struct("text_key", "ident")).alias("high")).collect()  # a few times `ranges` rows
        over = {r["range"]: r["size"] for r in counts if r["size"] > 2 * mean and r["low"] != r["high"]}
        if not over or turn == rounds:
            break
        wanted = docs.sparkSession.createDataFrame([(r, draws_per_range / mean) for r in over], "of_range int, rate double")
        again = rows.join(F.broadcast(wanted), rows["range"] == F.col("of_range"))
        more = draw(again, F.col("rate"), seed + 1 + turn)
        old = set(zip(*(b.tolist() for b in bounds), strict=True))
        known = len(old)
        where = range_numbers(more[0], more[1], *bounds)
        for r, size in over.items():
            mine = where == r
            old |= set(zip(*(b.tolist() for b in choose_splitters(*(x[mine] for x in more), int(size / mean) + 1)), strict=True))
        if len(old) == known:
            break  # rows that each outweigh a range
        both = np.array(sorted(old), np.int64).reshape(-1, 2)
        bounds = both[:, 0], both[:, 1]

    bound_keys, bound_ids = bounds
    one_text = {r: int(bound_keys[r - 1]) for r in range(1, len(bound_keys)) if bound_keys[r] == bound_keys[r - 1] or bound_ids[r - 1] != LEAST}
    shard_of = deal({r["range"]: r["size"] for r in counts}, one_text, shards)
    base, dealt = [0] * shards, []
    for r in sorted(counts, key=lambda r: r["range"]):
        s = shard_of[r["range"]]
        dealt.append((r["range"], s, base[s]))
        base[s] += r["n"]
    places = docs.sparkSession.createDataFrame(dealt, "range int, shard int, base long")
    slot = F.row_number().over(Window.partitionBy("range").orderBy("text_key", "ident")) + F.col("base") - 1
    return rows.join(F.broadcast(places), "range").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "range")
