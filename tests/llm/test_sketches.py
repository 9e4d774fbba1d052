"""Document fingerprints against plain Python, on odd rows, over many ranges, and by functions only."""

import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import sketches
from strandlake.llm.sketches import choose_bounds, fingerprint_documents, kept, likeness, merged, shingle_hashes, sketch, with_next

HIGHEST = (1 << 63) - 1


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_hashes(text, width=5):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"\S{1,24}", text or "", re.ASCII)]
    out = []
    for i in range(max(1, len(words) - width + 1) if words else 0):
        h = 42
        for w in words[i : i + width]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), h)
        out.append(signed(h))
    return out


def plain_sketch(text, fraction=1 / 16, least=64):
    d = sorted(set(plain_hashes(text)))
    return d[: max(least, sum(h <= sketches.threshold(fraction) for h in d))]


def plain_likeness(a, b, fraction=1 / 16, least=64):
    if not a and not b:
        return 1.0
    top = min(HIGHEST if len(s) < least else max(sketches.threshold(fraction), s[-1]) for s in (a, b))
    x, y = {h for h in a if h <= top}, {h for h in b if h <= top}
    return len(x & y) / len(x) if x else 0.0


def plain_rows(rows):
    """rows: (doc_id, text). By descending id, those without one last, copies of an id by their texts' hashes."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, ~(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, other = plain_sketch(text), plain_sketch(edited)
        hexed = lambda s: "".join(f"{h & ((1 << 64) - 1):016X}" for h in s)
        yield i, len(text), hexed(own), hexed(other), plain_likeness(own, other), plain_likeness(own, plain_sketch(after))


def compare(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got]
    assert sorted(got, key=key) == sorted(plain_rows(rows), key=key)


def test_odd_rows(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = ["", None, " \n", "a", "a b c d", "a b c d e", "x" * 5000, "é😀 " * 700, "same words " * 4000, " ".join(words), " ".join(words[:100]), "Ein ganz normaler Satz mit einigen Wörtern."]
    rows = [*enumerate(texts), (3, "a"), (3, "a"), (3, "another"), (None, "no id"), (None, None), (-7, "below")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, fingerprint string, range int, text_ int")
    compare(fingerprint_documents(df).collect(), rows)
    compare(fingerprint_documents(df.where("doc_id = 5")).collect(), [(5, texts[5])])
    assert fingerprint_documents(df.limit(0)).count() == 0


def test_real_texts(spark, documents):
    rows = fingerprint_documents(documents).collect()
    compare(rows, [(r["doc_id"], r["text"]) for r in documents.collect()])
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.55 and sum(r["near_next"] for r in rows) / len(rows) < 0.05


def test_next_row_over_many_ranges_and_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(i, f"text {i} " + "x" * rng.randrange(90)) for i in rng.sample(range(-9000, 9000), 4000)]
    rows += [(None, "no id, same text")] * 2000 + [(77, f"copy {i % 3}") for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    dealt = with_next(df, {}, range_bytes=500).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, ~(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want = sorted((i if i is not None else 1 << 40, t, n) for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((r["id_"] if r["id_"] is not None else 1 << 40, r["text_"], r["next_text_"]) for r in dealt) == want


def test_bounds_cut_a_hot_key_into_even_parts():
    sample = [(0, i, 0, 10) for i in range(500)] + [(0, 600, 9, 10)] * 500
    bounds = choose_bounds(sample, 20)
    assert len(bounds) == 19 and bounds == sorted(bounds)
    assert [b[3] for b in bounds if b[1] == 600] == [i / 10 for i in range(10)]


def test_sketches_merge_and_find_a_short_text_in_a_long_one(spark):
    rng = random.Random(2)
    words = [f"{rng.randrange(10**6)}" for _ in range(40_000)]
    pairs = [(" ".join(words[:20_000]), " ".join(words[20_000:20_400])), (" ".join(words), " ".join(words[500:2500])), ("a b c d e f", ""), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sketch(F.col("a")).alias("s"), sketch(F.col("b")).alias("t"))
    union = kept(F.concat(shingle_hashes(F.col("a")), shingle_hashes(F.col("b"))))
    got = df.select((merged(F.col("s"), F.col("t")) == union).alias("same"), likeness(F.col("t"), F.col("s")).alias("l"), likeness(F.col("s"), F.col("t")).alias("r")).collect()
    assert all(r["same"] for r in got)
    assert got[1]["l"]["containment"] == 1.0 and got[1]["r"]["containment"] == pytest.approx(0.05, abs=0.02)
    assert got[0]["l"]["containment"] == 0.0 and got[2]["l"]["containment"] == 0.0 and got[3]["l"]["containment"] == got[3]["l"]["jaccard"] == 1.0


def test_only_functions_and_one_shuffle_of_texts(documents):
    plan = fingerprint_documents(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan and plan.count("Exchange ") == 1
