"""Connected components of a distributed graph by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import cut_lineage


def star(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same ties with one link for each node but a component's least."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(names)))
    return names[label[at]], names[at]


class StarLinks:
    """Links that are gathered in a task and kept as stars, so that they never outnumber the nodes by much."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.size = most, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.parts.append((u, v))
        self.size += len(u)
        if self.size > self.most:
            self.stars()
            self.most = max(self.most, 2 * self.size)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.parts, strict=True) if self.parts else ((), ())))
        self.parts = [star(u, v)]
        self.size = len(self.parts[0][0])
        return self.parts[0]

    def batch(self) -> pa.RecordBatch:
        u, v = self.stars()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def contract(edges: DataFrame) -> DataFrame:
    """Fewer edges (u, v, longs) that connect the same nodes: all edges of a v meet in a task, which keeps stars only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = StarLinks()
        for batch in batches:
            found.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield found.batch()

    return edges.select("u", "v").repartition("v").mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (u, v, longs); a component is named by its smallest node.

    A round takes, for every node, the least label among its neighbours, and then that label's own label. Hubs are
    harmless: minima are combined before each shuffle. Rounds are cut by reliable checkpoints; their number grows with
    the logarithm of the longest path, and running out of them raises an error rather than returning parts.
    """
    few = cut_lineage(contract(edges).where("u <> v"))
    both = cut_lineage(few.union(few.select("v", "u")).distinct())
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels["node"] == near["u"]).select("node", F.col("component").alias("before"), F.least("component", "near").alias("to"))
        stepped = cut_lineage(stepped)
        onward = stepped.select(F.col("node").alias("to"), F.col("to").alias("component"))
        jumped = cut_lineage(stepped.join(onward, "to").select("node", "component", "before"))
        labels = jumped.select("node", "component")
        if jumped.where("component <> before").isEmpty():
            return labels
    raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
