"""Quoted parts of benchmark items are found wherever they begin."""

import random

import pytest

from strandlake.llm.decontamination import STRIDE, WINDOW, drop_leaks, find_leaks


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


@pytest.mark.parametrize("size", [300, 700, 3000])
def test_op9_parts_of_items_wherever_they_begin(spark, size):
    rng = random.Random(size)
    item = words(rng, size)[:size].strip()
    least = WINDOW + STRIDE - 1
    cuts = [*range(0, len(item) - least, 17), len(item) - least]
    rows = [(k, words(rng, 60) + " | " + item[lo : lo + least] + " | " + words(rng, 60)) for k, lo in enumerate(cuts)]
    df = spark.createDataFrame([*rows, (-1, words(rng, 150))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = find_leaks(df, bench).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(cuts)))
    assert all(r["edits"] == 0 and WINDOW <= r["length"] <= least + 2 * int(0.08 * WINDOW) for r in found)
    assert [r["doc_id"] for r in drop_leaks(df, bench).collect()] == [-1]
