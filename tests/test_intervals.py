"""Joins of intervals against comparing all, with intervals over many bins, ties, empty and null ones."""

import random

import pytest

from strandlake.operators.intervals import asof, overlaps


def made(n, seed, keys=("x", "y", None), long=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(-200, 2000)
        rows.append((rng.choice(keys), s if rng.random() > 0.05 else None, s + rng.choice([0, 1, 5, 64, long, -3]) if rng.random() > 0.05 else None, i))
    return rows


SCHEMA = "file string, start long, end long, id long"


@pytest.mark.parametrize("width", [1, 64, 1 << 14])
def test_overlaps(spark, width):
    a, b = made(200, 1), made(150, 2, long=1500)
    got = overlaps(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["file"], width=width)
    assert got.columns == ["file", "start", "end", "id", "start_right", "end_right", "id_right"]
    whole = lambda r: None not in r and r[2] > r[1]
    want = sorted((x[3], y[3]) for x in a for y in b if whole(x) and whole(y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert sorted((r["id"], r["id_right"]) for r in got.collect()) == want and len(want) > 500


def test_overlaps_of_repeated_and_clashing_rows(spark):
    rows = [("x", 5, 9, 1)] * 3
    df = spark.createDataFrame(rows, "file string, start long, end long, bin_ long")
    assert overlaps(df, df, ["file"]).count() == 9
    assert overlaps(df, df.limit(0), ["file"]).count() == 0


def test_overlaps_are_a_join_by_equality(spark):
    df = spark.createDataFrame(made(50, 3), SCHEMA)
    plan = overlaps(df, df, ["file"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan


@pytest.mark.parametrize("width", [1, 50, 1 << 14])
def test_asof(spark, width):
    places, marks = made(200, 4), made(60, 5)
    left = spark.createDataFrame([(f, s, i) for f, s, _, i in places], "file string, pos long, id long")
    right = spark.createDataFrame([(f, s, i % 7) for f, s, _, i in marks], "file string, start long, id long")
    got = asof(left, right, ["file"], width=width)
    assert got.columns == ["file", "pos", "id", "start_right", "id_right"]
    want = []
    for f, s, _, i in places:
        found = [(t, j % 7) for g, t, _, j in marks if f is not None and f == g and None not in (s, t) and t <= s]
        want.append((i, *max(found, default=(None, None))))
    key = lambda r: r[0]
    assert sorted(((r["id"], r["start_right"], r["id_right"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_asof_of_nothing(spark):
    left = spark.createDataFrame([("x", 5)], "file string, pos long")
    right = spark.createDataFrame([], "file string, start long, note string")
    assert [tuple(r) for r in asof(left, right, ["file"]).collect()] == [("x", 5, None, None)]
    assert asof(left.limit(0), right, ["file"]).count() == 0
