"""Centroid clustering by ball k-means: exact k-means that compares a vector with the few centroids that could be nearer.

Vectors are packed in blocks that stay where they were read. In each block the members of a cluster are a ball: their centroid
and the largest distance from it. Another centroid is a neighbour if it is nearer than twice that radius; no member of the ball
can belong to any other. Sorted by distance, the neighbours cut the ball into a stable core, whose members are nearer to
their centroid than half way to the first neighbour, and annuli; members of the j-th annulus are compared exactly with the j
nearest neighbours and no others. Pairs of centroids that both stayed in place are not compared again. All of it is in
integers: squared distances, with 2 d(x, c) < d(c, c') as 4 d(x, c)**2 < d(c, c')**2, and strict, so ties are compared too.

A round adds up each block's sums by cluster (k rows), then those by cluster over all blocks; only k rows reach the driver. Blocks
of a lost executor are made again from their source by the same rounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut_lineage

WIDTH = 64
SCALE = 256
BLOCK_ROWS = 16_384
PART = "array<struct<cluster:int,n:bigint,inertia:bigint,sums:array<bigint>>>"
BLOCK = f"ids array<bigint>, vectors binary, clusters binary, distances binary, parts {PART}"


def most(width: int) -> int:
    """The largest integer component for which four squared distances fit in 64 bits."""
    return math.isqrt((1 << 60) // width) // 2


def fit_columns(vectors: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list array that have `width` components, none null or non-finite, and those as integers floor(SCALE * x)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    if len(rows) == 0:
        return rows, np.zeros((0, width), np.int64)
    values = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
    real = pc.fill_null(values, math.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    whole = np.isfinite(real).all(axis=1)
    scaled = np.floor(real[whole] * SCALE)
    if len(scaled) and np.abs(scaled).max() > most(width):
        raise ValueError(f"a component beyond {most(width) // SCALE}: squared distances would not fit in 64 bits")
    return rows[whole], scaled.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors from one centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, ties to the smaller number, and its squared distance, by comparing all."""
    best, number = squared(x, centroids[0]), np.zeros(len(x), np.int32)
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        nearer = d < best
        best[nearer], number[nearer] = d[nearer], j
    return number, best


def reassign(x: np.ndarray, number: np.ndarray, distance: np.ndarray, centroids: np.ndarray, between: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, from its cluster (number, distance) before the centroids moved; and the number of
    exact comparisons with other centroids that it took."""
    number, distance = number.copy(), distance.copy()
    before, compared = number.copy(), 0
    for i in np.unique(before):
        rows = np.flatnonzero(before == i)
        if moved[i]:
            distance[rows] = squared(x[rows], centroids[i])
        own = distance[rows]
        others = np.flatnonzero((between[i] <= 4 * own.max()) & (moved | moved[i]))
        others = others[others != i]
        others = others[np.argsort(between[i][others], kind="stable")]
        annulus = np.searchsorted(between[i][others], 4 * own, "right")  # 0: the stable core
        order = np.argsort(-annulus, kind="stable")
        rows, annulus = rows[order], annulus[order]
        for t, j in enumerate(others):
            outer = rows[: int(np.searchsorted(-annulus, -t, "left"))]
            if len(outer) == 0:
                break
            d = squared(x[outer], centroids[j])
            compared += len(outer)
            nearer = (d < distance[outer]) | ((d == distance[outer]) & (j < number[outer]))
            distance[outer[nearer]], number[outer[nearer]] = d[nearer], j
    return number, distance, compared


def centroid_gaps(centroids: np.ndarray) -> np.ndarray:
    """Squared distances between all centroids."""
    return np.stack([squared(centroids, c) for c in centroids])


def _parts(x: np.ndarray, number: np.ndarray, distance: np.ndarray) -> list[dict]:
    out = []
    for i in np.unique(number):
        own = number == i
        out.append({"cluster": int(i), "n": int(own.sum()), "inertia": int(distance[own].sum()), "sums": x[own].sum(axis=0).tolist()})
    return out


def _block(ids: pa.Array, x: np.ndarray, number: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    columns = [
        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        pa.array([x.astype(np.int32).tobytes()], pa.binary()),
        pa.array([number.astype(np.int32).tobytes()], pa.binary()),
        pa.array([distance.astype(np.int64).tobytes()], pa.binary()),
        pa.array([_parts(x, number, distance)], pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("sums", pa.list_(pa.int64()))]))),
    ]
    return pa.record_batch(columns, ["ids", "vectors", "clusters", "distances", "parts"])


def _first(centroids: np.ndarray, block_rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0

        def flush():
            x = np.concatenate(vectors)
            return _block(pa.concat_arrays(ids), x, *nearest(x, centroids))

        for batch in batches:
            rows, x = fit_columns(batch.column(1), width)
            if len(rows) == 0:
                continue
            ids.append(batch.column(0).cast(pa.int64()).take(pa.array(rows)))
            vectors.append(x)
            held += len(rows)
            if held >= block_rows:
                yield flush()
                ids, vectors, held = [], [], 0
        if held:
            yield flush()

    return run


def _next(centroids: np.ndarray, moved: np.ndarray):
    between = centroid_gaps(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, vectors, clusters, distances = (batch.column(i)[r] for i in range(4))
                number = np.frombuffer(clusters.as_py(), np.int32)
                x = np.frombuffer(vectors.as_py(), np.int32).reshape(len(number), -1).astype(np.int64)
                number, distance, _ = reassign(x, number, np.frombuffer(distances.as_py(), np.int64), centroids, between, moved)
                yield _block(ids.values, x, number, distance)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            ids, clusters, distances = (batch.column(i)[r] for i in range(3))
            yield pa.record_batch([ids.values, pa.array(np.frombuffer(clusters.as_py(), np.int32)), pa.array(np.frombuffer(distances.as_py(), np.int64))], ["vec_id", "cluster", "distance"])


def starting_centroids(vectors: DataFrame, k: int, seed: int, width: int) -> np.ndarray:
    """The k usable vectors with the smallest SHA-256 of `seed:vec_id`, in that order; repeated ids by their components."""
    usable = vectors.where((F.size("vector") == width) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = usable.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return fit_columns(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width)[1]


def cluster_sums(blocks: DataFrame, width: int) -> dict[int, tuple[int, int, list[int]]]:
    """Number of vectors, inertia and component sums by cluster."""
    part = blocks.select(F.explode("parts").alias("p")).select("p.*")
    sums = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    return {r["cluster"]: (r["n"], r["inertia"], [r[f"s{i}"] for i in range(width)]) for r in sums.collect()}


def cluster_vectors(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The cluster of every usable vector after `rounds` rounds, its squared distance, the sums of those, and the hash of its
    centroid.

    Vectors that are null, of another length, or hold a null or non-finite component take no part and give no row. Repeated rows
    and ids are rows like any other, as are rows without an id. With fewer than k usable vectors each starts a cluster; an empty
    table gives no rows. Components beyond some 260,000 raise ValueError, as squared distances
    wouldn't fit in 64 bits. Other columns are not looked at.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    centroids = starting_centroids(vectors, k, seed, width)
    if len(centroids) == 0:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    blocks = vectors.mapInArrow(_first(centroids, block_rows, width), BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    sums = cluster_sums(blocks, width)
    for _ in range(rounds):
        following = centroids.copy()
        for i, (n, _, total) in sums.items():
            following[i] = [s // n for s in total]
        moved = (following != centroids).any(axis=1)
        if not moved.any():
            break
        centroids, earlier = following, blocks
        blocks = earlier.mapInArrow(_next(centroids, moved), BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
        sums = cluster_sums(blocks, width)
        earlier.unpersist()
    result = cut_lineage(blocks.select("ids", "clusters", "distances"))
    blocks.unpersist()
    whole = sum(inertia for _, inertia, _ in sums.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = result.mapInArrow(_rows, "vec_id bigint, cluster int, distance bigint")
    at = F.col("cluster")
    inertias = F.array(*[F.lit(sums[i][1] if i in sums else 0).cast("bigint") for i in range(len(hashes))])
    return rows.select(
        F.col("vec_id").alias(id_col),
        "cluster",
        "distance",
        F.get(inertias, at).alias("cluster_inertia"),
        F.lit(whole).cast("bigint").alias("inertia"),
        F.get(F.array(*map(F.lit, hashes)), at).alias("centroid_sha256"),
    )
