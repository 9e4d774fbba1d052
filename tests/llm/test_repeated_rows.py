"""Rows that are equal in everything: search and sharding against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.llm.multi_index import search
from strandlake.llm.sharding import assign_shards


def plain_search(rows, k):
    """Each query row with its k nearest other rows."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v, j) for j, (v, y) in enumerate(rows) if j != i)
            out += [(q, rank + 1, v, -s) for rank, (s, v, _) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("copies", [25, 3])
def test_op6_repeated_rows_are_candidates_of_each_other(spark, copies):
    rng = random.Random(copies)
    vector = lambda: [float(rng.randrange(-4, 5)) for _ in range(4)]
    hot = [1.0, 2.0, 0.0, -1.0]
    rows = [(20, hot)] * copies + [(i, vector()) for i in range(100, 138)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = search(df, F.col("vec_id") % 20 == 0, block=16, recall=1.0)
    assert sorted(tuple(r) for r in got.collect()) == plain_search(rows, 20)
    per_query = Counter(r["query_id"] for r in got.collect())
    assert per_query[20] == 20 * copies and per_query[100] == 20


def test_op6_one_id_with_several_vectors(spark):
    rng = random.Random(9)
    rows = [(i % 7 * 20, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in search(df, F.col("vec_id") % 20 == 0, k=5, recall=1.0).collect())
    assert got == sorted((q, r, v, round(s, 9)) for q, r, v, s in plain_search(rows, 5))


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: i % 2])
def test_op1_equal_rows_are_dealt_evenly(spark, ids):
    rows = [(ids(i), "the same text " * 20) for i in range(4000)] + [(i, f"text {i} " * 9) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = assign_shards(df, 8).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    mean = sum(load.values()) / 8
    assert len(got) == 5000 and all(abs(v - mean) <= mean / 20 for v in load.values()), load
    slots = Counter((r["shard"], r["slot"]) for r in got)
    assert max(slots.values()) == 1


def test_op1_one_row_that_outweighs_every_range(spark):
    df = spark.createDataFrame([(1, "x" * 1_000_000), (1, "x" * 1_000_000), *((i, "y") for i in range(50))], "doc_id long, text string")
    got = assign_shards(df, 4).collect()
    assert len({r["shard"] for r in got if r["size"] > 1_000_000}) == 2 and len(got) == 52
