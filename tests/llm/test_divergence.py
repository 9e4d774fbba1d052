"""The source divergence audit against plain arithmetic on odd rows, whatever the chunks."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandlake.llm.divergence import PIECE, add_terms, gap, shares, source_divergence


def plain_audit(rows, least=10, top=10):
    counts, docs, groups = {}, {}, {}
    for text, lang, source in rows:
        key = (lang or "", source or "")
        groups.setdefault(key[0], {}).setdefault(key[1], Counter())
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        groups[key[0]][key[1]].update(found)
        docs.setdefault(key[0], Counter()).update(found.keys())
    out = set()
    for lang, by in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        share = lambda c: [1 + 10**9 * (c[t] + 2) // (sum(c[t] for t in kept) + 2 * len(kept)) for t in kept]  # noqa: B023, E731
        p = {s: share(c) for s, c in by.items()}
        q = share(sum(by.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in by if o != s]
            terms = [(t, f(a, b)) for t, a, b in zip(kept, p[s], q, strict=True) if by[s][t] > 0 and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < top}
    return out


def rows_of(df):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    words = ["Alpha", "beta", "été", "Ünder", "中文", "z", "\U0001f600x", "ab`cd", "x1y2", "ａ", "TIE", "tie2x", "née", "ÀB"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(1, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "B", None, "é"])) for _ in range(160)]
    return [*rows, rows[0], rows[0], (None, "en", "empty"), ("", "en", "é"), ("12 .. []", "fr", "none"), ("rare words only", "xx", "one"), ("rare", "xx", "two"), (None, "only", "source"), ("word " * 30_000, "en", "long")]


@pytest.mark.parametrize("chunk_rows", [1, 7, 50_000])
def test_equals_plain_arithmetic(spark, odd, chunk_rows):
    df = spark.createDataFrame([(t, la, s, "x", 1) for t, la, s in odd], "text string, lang string, source string, term string, chunk int").repartition(3)
    got = rows_of(source_divergence(df, chunk_rows=chunk_rows))
    assert len(got) == len(set(got)) and set(got) == plain_audit(odd)


def test_empty_table_and_one_source(spark):
    schema = "text string, lang string, source string"
    assert source_divergence(spark.createDataFrame([], schema)).count() == 0
    assert source_divergence(spark.createDataFrame([("a b", "en", "s")] * 3, schema)).count() == 0
    two = rows_of(source_divergence(spark.createDataFrame([("a b", "en", "s"), (None, "en", "t")], schema)))
    assert sorted(two) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_and_gaps_are_exact_for_large_counts():
    counts = np.array([[0, 1, 10**13, 10**15 + 7, 123_456_789_012]], np.int64)
    total = np.array([[2 * 10**15]], np.int64)
    got = shares(counts, total, 5)
    assert got.tolist() == [[1 + 10**9 * (c + 2) // (2 * 10**15 + 10) for c in counts[0].tolist()]]
    p, q = np.array([10**9, 5, 1]), np.array([1, 10**9, 1])
    assert gap(p, q).tolist() == [(a - b) ** 2 // (a + b) for a, b in zip(p.tolist(), q.tolist(), strict=True)]


def test_long_texts_are_split_between_terms():
    text = ("abc " * (PIECE // 4) + "d" * (PIECE + 3) + " efg abc").encode()
    terms, docs = Counter(), Counter()
    add_terms(text, terms, docs)
    assert terms == {b"abc": PIECE // 4 + 1, b"d" * (PIECE + 3): 1, b"efg": 1} and set(docs.values()) == {1}
