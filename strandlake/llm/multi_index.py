"""Approximate nearest neighbours by an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut_lineage


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of a bounded sample; an empty cluster keeps its place, and no points give one centroid at zero."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = ((centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of both halves, and how many entries each pair of them holds."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The pair of nearest centroids of each vector, as one number."""
        a = ((self.first**2).sum(1)[None] - 2 * x[:, : self.half] @ self.first.T).argmin(1)
        b = ((self.second**2).sum(1)[None] - 2 * x[:, self.half :] @ self.second.T).argmin(1)
        return a * len(self.second) + b

    def traverse(self, q: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the inner products of q's halves with both centroids. A heap holds the frontier: a pair
        enters once its forerunners in both orders have left."""
        u, v = self.first @ q[: self.half], self.second @ q[self.half :]
        a, b = np.argsort(-u, kind="stable").tolist(), np.argsort(-v, kind="stable").tolist()
        u, v = u[a].tolist(), v[b].tolist()
        heap, width = [(-(u[0] + v[0]), 0, 0)], len(self.second)
        left_at = [0] * len(a)  # how many pairs of each line have left
        while heap:
            _, i, j = heapq.heappop(heap)
            yield a[i] * width + b[j]
            left_at[i] = j + 1
            if j + 1 < len(b) and (i == 0 or left_at[i - 1] > j + 1):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if i + 1 < len(a) and left_at[i + 1] == j:
                heapq.heappush(heap, (-(u[i + 1] + v[j]), i + 1, j))

    def visited(self, q: np.ndarray, entries: int) -> list[int]:
        """The cells, none of them empty, that hold the first `entries` entries on q's way."""
        out, seen = [], 0
        for cell in self.traverse(q):
            if self.counts[cell]:
                out.append(cell)
                seen += self.counts[cell]
                if seen >= entries:
                    break
        return out


def matrix(column: pa.Array, floats: str) -> np.ndarray:
    """The vectors in a column of equally long binaries, as doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(column.to_pylist()), floats).reshape(len(column), -1).astype(np.float64)


def float_format(vectors: DataFrame, vector_col: str) -> str:
    """How components are packed: as they are if they are floats, else as doubles."""
    return "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x, row) of the rows that take part, x being the packed components and row a number of the row's own.

    Vectors null, empty or zero, or with null or non-finite components, and rows without an id, take no part.
    """
    floats = float_format(vectors, vector_col)
    size = np.dtype(floats).itemsize

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.columns
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            flat = pc.fill_null(lists.flatten().cast(pa.float64()), np.nan).to_numpy() + 0.0
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            good = (n > 0) & (sums(~np.isfinite(flat)) == 0) & (sums(flat != 0) > 0) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
            raw = pa.py_buffer(np.where(np.isfinite(flat), flat, 0.0).astype(floats).tobytes())
            x = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(at * size), raw])
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([ids.filter(keep), x.filter(keep).cast(pa.binary())], ["vec_id", "x"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(pack, "vec_id long, x binary").withColumn("row", F.monotonically_increasing_id())


def distinct_vectors(packed: DataFrame, keep: int) -> DataFrame:
    """(node, x, ids) of the distinct vectors of packed rows: a number, the vector, and the id and row number, in turn, of the
    `keep` of its rows with the smallest ids.

    No other copy can be among anyone's keep - 1 nearest. Surplus copies are dropped before the shuffle.
    """
    few = packed.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("vec_id", "row"))).where(F.col("n") <= keep)
    pairs = F.sort_array(F.collect_list(F.struct("vec_id", "row")))
    nodes = few.groupBy("x").agg(F.flatten(F.transform(pairs, lambda p: F.array(p["vec_id"], p["row"]))).alias("ids"))
    return cut_lineage(nodes.select(F.monotonically_increasing_id().alias("node"), "x", "ids"))


def fit_index(nodes: DataFrame, floats: str, *, per_cell: int = 48, most_centroids: int = 256, sample: int = 8192, seed: int = 5) -> MultiIndex:
    """An index over all nodes; centroids come from at most `sample` of them, those of least hash. There are so many
    centroids for each half that a cell holds about per_cell entries, most_centroids at most."""
    n = nodes.count()
    rows = nodes.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(sample).select("x").toArrow()
    points = matrix(rows.column("x").combine_chunks(), floats) if n else np.zeros((0, 2))
    half = points.shape[1] // 2
    k = int(min(most_centroids, max(1, round((n / per_cell) ** 0.5))))
    index = MultiIndex(k_means(points[:, :half], k), k_means(points[:, half:], k), np.zeros(0))
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in place(nodes, index, floats).groupBy("cell").count().collect():  # most_centroids**2 rows at most
        counts[r["cell"]] = r["count"]
    return MultiIndex(index.first, index.second, counts)


def place(nodes: DataFrame, index: MultiIndex, floats: str) -> DataFrame:
    """nodes with their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                b = batch.slice(lo, 4096)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.cells(matrix(b.column(1), floats)).astype(np.int32))], ["node", "x", "ids", "cell"])

    return nodes.select("node", "x", "ids").mapInArrow(run, "node long, x binary, ids array<long>, cell int")


def entries_needed(placed: DataFrame, index: MultiIndex, floats: str, k: int, recall: float, queries: int, seed: int = 6) -> int:
    """How many entries the traversal must reach so that a share `recall` of the true k nearest of a sample of queries is
    among them; the sample's true nearest come from a pass over all entries."""
    sample = placed.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(queries).select("node", "x").toArrow()
    names, q = sample.column("node").to_numpy(), matrix(sample.column("x").combine_chunks(), floats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 8192):
                b = batch.slice(lo, 8192)
                score = q @ matrix(b.column(1), floats).T
                score[names[:, None] == b.column(0).to_numpy()[None]] = -np.inf
                top = np.argpartition(-score, min(k, len(b)) - 1, axis=1)[:, :k]
                cell = b.column(3).to_numpy()[top]
                at = np.repeat(np.arange(len(q)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.take_along_axis(score, top, 1).ravel()), pa.array(cell.ravel())], ["q", "score", "cell"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    true = placed.mapInArrow(run, "q long, score double, cell int").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).toPandas()
    needed = []
    for i in range(len(q)):
        seen, upto, cells = 0, {}, true["cell"][true["q"] == i].tolist()
        left = set(cells)
        for cell in index.traverse(q[i]):
            seen += int(index.counts[cell])
            upto[cell] = seen
            left.discard(cell)
            if not left:
                break
        needed += [upto[c] for c in cells]
    return int(np.quantile(needed, recall, method="higher")) if needed else 0


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, recall: float = 0.96, tuning_queries: int = 96, block: int = 8192, query_bytes: int = 8 << 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for each row that is_query holds for.

    Nearness is the largest inner product in double precision; ties go to the smaller id; a query's own row is no
    candidate; fewer candidates than k give fewer rows. Every row is indexed. Only vectors of one length have an inner
    product, so each length that occurs is a search of its own. Repeated ids are rows like any other: each such query row has k
    results, and the other rows of its id are among its candidates. See packed_vectors for
    the rows that take no part; an empty table gives no rows.
    """
    floats = float_format(vectors, vector_col)
    packed = cut_lineage(packed_vectors(vectors, id_col, vector_col))
    sizes = sorted(r["size"] for r in packed.select(F.octet_length("x").alias("size")).distinct().collect())
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for number, size in enumerate(sizes):
        part = search_packed(packed.where(F.octet_length("x") == size), is_query, floats, k, recall, tuning_queries, block, max(1, query_bytes // size))
        out = out.unionByName(part) if number else part
    return out


def search_packed(packed: DataFrame, is_query: Column, floats: str, k: int, recall: float, tuning_queries: int, block: int, query_block: int) -> DataFrame:
    """search over packed vectors of one length.

    Copies of a vector are one entry with its k + 1 rows of smallest ids, which loses nothing, so a hot vector costs no more than
    another. A query goes through the cells of the index in order until it has met as many entries as entries_needed says,
    and all of those are scored exactly. Entries lie in blocks of about `block` in the order of cells; queries that begin in
    neighbouring cells share a chunk of about query_block; a task scores a block by a chunk that visits it. An entry is
    sent to a task for each such chunk, a query for each block on its way.
    """
    nodes = distinct_vectors(packed, k + 1)
    asked = packed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), F.col("x").alias("asked_x"))
    asked = asked.join(nodes.select("node", "x"), F.col("asked_x") == F.col("x")).select("query_id", "own", "node")
    index = fit_index(nodes, floats)
    placed = cut_lineage(place(nodes, index, floats))
    entries = max(50 * k, entries_needed(placed, index, floats, k, recall, tuning_queries))

    # Cells are put into blocks in order; a cell of more than a block is cut into several by hash.
    starts = np.cumsum(index.counts) - index.counts
    low, high = starts // block, np.maximum(starts // block, (starts + index.counts - 1) // block)
    whole = [(int(c), int(low[c]), int(high[c] - low[c] + 1)) for c in np.flatnonzero(index.counts)]
    session = packed.sparkSession
    cells = session.createDataFrame(whole, "cell int, low int, parts int")
    blocked = placed.join(F.broadcast(cells), "cell").withColumn("block", (F.col("low") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                b = batch.slice(lo, 256)
                first, of, blocks, ways = [], [], [], []
                for i, q in enumerate(matrix(b.column(1), floats)):
                    way = np.array(index.visited(q, entries), np.int32)
                    first.append(int(way[0]))
                    way = np.sort(way)
                    # Blocks go up with cells; only the cells that end a block can lie in several.
                    bounds = np.unique(np.concatenate([np.arange(l, h + 1) for l, h in zip(low[way], high[way], strict=True)]) if (low[way] != high[way]).any() else low[way])
                    for x in bounds.tolist():
                        of.append(i)
                        blocks.append(x)
                        ways.append(way[np.searchsorted(high[way], x, "left") : np.searchsorted(low[way], x, "right")])
                at = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(first, pa.int32()).take(at), pa.array(blocks, pa.int32()), pa.array(ways, pa.list_(pa.int32()))], ["query", "q", "first", "block", "cells"])

    query_nodes = placed.join(asked.select("node").distinct(), "node", "left_semi").select("node", "x")
    probes = cut_lineage(query_nodes.mapInArrow(ask, "query long, q binary, first int, block int, cells array<int>"))
    # Chunks take queries by the cell that they begin in; a cell of more than a chunk is cut into several by hash.
    begun = sorted((r["first"], r["n"]) for r in probes.groupBy("first").agg(F.count_distinct("query").alias("n")).collect())  # most_centroids**2 rows at most
    total = np.cumsum([0, *(n for _, n in begun)])
    dealt = [(first, int(lo // query_block), int(-(-n // query_block))) for (first, n), lo in zip(begun, total, strict=False)]
    dealt = session.createDataFrame(dealt, "first int, chunk_low int, chunk_parts int")
    sent = probes.join(F.broadcast(dealt), "first").withColumn("chunk", (F.col("chunk_low") + F.pmod(F.xxhash64("query", F.lit(1)), F.col("chunk_parts"))).cast("int")).select("chunk", "block", "query", "q", "cells")
    wanted = sent.select(F.col("block").alias("to_block"), F.col("chunk").alias("to_chunk")).distinct()
    copies = blocked.join(wanted, F.col("block") == F.col("to_block")).select("to_block", "to_chunk", "cell", "x", "ids")

    def score(entries_: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(entries_) and len(queries):
            cell = entries_.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            entries_ = entries_.take(pa.array(order))
            cell = cell[order]
            x = matrix(entries_.column("x").combine_chunks(), floats)
            longest = np.sqrt((x**2).sum(1).max())
            ids = entries_.column("ids").combine_chunks()
            at = ids.offsets.to_numpy() // 2
            pairs = ids.values.to_numpy().reshape(-1, 2)
            q, names = matrix(queries.column("q").combine_chunks(), floats), queries.column("query").to_numpy()
            ways = queries.column("cells").combine_chunks()
            cuts, way_cells = ways.offsets.to_numpy(), ways.values.to_numpy()
            mark = np.zeros(len(index.counts), bool)
            for lo in range(0, len(q), 128):
                near = q[lo : lo + 128] @ x.T
                # The product of matrices may round otherwise than the sum below; what is within that stays.
                slack = 8 * x.shape[1] * np.finfo(float).eps * longest * np.sqrt((q[lo : lo + 128] ** 2).sum(1))
                for i, line in enumerate(near):
                    way = way_cells[cuts[lo + i] : cuts[lo + i + 1]]
                    mark[way] = True
                    mine = np.flatnonzero(mark[cell])
                    mark[way] = False
                    if not len(mine):
                        continue
                    if len(mine) > k + 1:
                        least = np.partition(line[mine], len(mine) - k - 1)[len(mine) - k - 1]
                        mine = mine[line[mine] >= least - slack[i]]
                    exact = np.einsum("ij,j->i", x[mine], q[lo + i])
                    n = at[mine + 1] - at[mine]
                    source = np.repeat(at[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    s, v, row = np.repeat(exact, n), pairs[source, 0], pairs[source, 1]
                    best = np.lexsort((row, v, -s))[: k + 1]
                    out.append((np.full(len(best), names[lo + i]), v[best], row[best], s[best]))
        columns = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, np.int64, np.float64))]
        return pa.table(columns, ["query", "vec_id", "row", "score"])

    found = copies.groupBy("to_block", "to_chunk").cogroup(sent.groupBy("block", "chunk")).applyInArrow(score, "query long, vec_id long, row long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    mine = asked.join(found, asked["node"] == found["query"]).where("own <> row")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
