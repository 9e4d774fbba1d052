"""Document fingerprints: threshold-scaled sketches of word shingles, by DataFrame functions only.

A sketch is the sorted list of all shingle hashes that lie in the lowest FRACTION of the 64-bit range, whatever the text's
length, so a text ten thousand times longer has a sketch ten thousand times larger and what a short text shares with it is
still seen. Texts with fewer than LEAST hashes there keep their LEAST smallest instead, which are all they have where they have
no more. The sketch of a union of texts follows from their sketches alone (`merged`), and a hash up to the `bound` of a
sketch is in it if and only if a shingle of the text has it; so two sketches are compared up to the lower of their bounds.

A word is up to 24 visible characters (a longer run, or a script without blanks, is cut in pieces of 24 from its start), a
shingle `width` words (a text of fewer words: all of them). Shingles are chained XXH64 of the words' own XXH64, seed 42. Null
texts count as empty; an empty text has an empty sketch, which is like another empty one (1) and like no other (0).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 5
FRACTION = 1 / 16
LEAST = 64
NO_HASHES = "array<bigint>"


def _let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def threshold(fraction: float) -> int:
    """The largest hash, as a signed number, of the lowest `fraction` of all."""
    return -(1 << 63) + math.ceil(fraction * (1 << 64)) - 1


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """The hash of each shingle, repeats included."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,24}"), F.lit(0))

    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - width, F.lit(0))
        return F.when(F.size(h) == 0, F.array().cast(NO_HASHES)).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        )

    return _let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def kept(hashes: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of a set of hashes."""
    top = F.lit(threshold(fraction))
    return _let(F.sort_array(F.array_distinct(hashes)), lambda d: F.slice(d, F.lit(1), F.greatest(F.lit(least), F.size(F.filter(d, lambda h: h <= top)))))


def sketch(text: Column, width: int = WIDTH, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of a text."""
    return kept(shingle_hashes(text, width), fraction, least)


def merged(one: Column, other: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of the two texts' shingles together, from their sketches."""
    return kept(F.concat(one, other), fraction, least)


def bound(s: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The hash up to which a sketch holds every hash of its text."""
    return F.when(F.size(s) < least, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.lit(threshold(fraction)), F.get(s, F.size(s) - 1)))


def likeness(one: Column, other: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """struct(containment, jaccard): the share of the first text's shingles that the second has, and of all that both have.

    Texts of which no hash lies below the common bound share nothing that could be seen (0), unless both are empty (1).
    """

    def compare(pair: Column) -> Column:
        a, b, top = pair["a"], pair["b"], pair["top"]
        return F.struct(F.filter(a, lambda h: h <= top).alias("a"), F.filter(b, lambda h: h <= top).alias("b"))

    def rates(pair: Column) -> Column:
        both, a, b = F.size(F.array_intersect(pair["a"], pair["b"])), F.size(pair["a"]), F.size(pair["b"])
        return F.struct(
            F.when(a > 0, both / a).otherwise(0.0).alias("containment"),
            F.when(a + b > 0, both / (a + b - both)).otherwise(0.0).alias("jaccard"),
        )

    top = F.least(bound(one, fraction, least), bound(other, fraction, least))
    found = _let(_let(F.struct(one.alias("a"), other.alias("b"), top.alias("top")), compare), rates)
    same = F.struct(F.lit(1.0).alias("containment"), F.lit(1.0).alias("jaccard"))
    return F.when((F.size(one) == 0) & (F.size(other) == 0), same).otherwise(found)


def written(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


#: Key of the order by descending id: rows without an id last, copies of an id by the hash of their texts.
KEY = "last int, id bigint, hash bigint"


def _order_key(id_col: str, text_col: str) -> list[Column]:
    ident = F.col(id_col).cast("bigint")
    return [
        ident.isNull().cast("int").alias("last"),
        F.coalesce(F.bitwise_not(ident), F.lit(0).cast("bigint")).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"),
    ]


def choose_bounds(sample: list[tuple], ranges: int) -> list[tuple]:
    """Lower bounds of all ranges but the first, from (last, id, hash, size) draws: quantiles of the size.

    A key that several quantiles hit holds that many ranges: they differ in a last part from 0 to 1, by which its rows,
    which are equal to each other, are dealt evenly.
    """
    sample.sort()
    total, seen, hits = sum(s[3] for s in sample), 0, {}
    for *key, size in sample:
        first = math.ceil(seen * ranges / total)
        seen += size
        n = len(range(max(first, 1), min(ranges - 1, math.ceil(seen * ranges / total) - 1) + 1))
        if n:
            hits[tuple(key)] = hits.get(tuple(key), 0) + n
    return [(*key, i / n) for key, n in sorted(hits.items()) for i in range(n)]


def with_next(docs: DataFrame, carried: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 2 << 20, max_ranges: int = 4096, draws: int = 32) -> DataFrame:
    """The rows of docs as (id, text and the columns of `carried`), with those of the next row by descending id as next_*.

    After the last row comes the first; a single row is its own next. Rows without an id come last, copies of an id in the
    order of their texts' hashes. Rows are dealt to ranges of about range_bytes of text (of 256 rows at least) by splitters from
    a sample of at most draws * max_ranges keys, so texts move once. A splitter is the key of a row, so the first row of every
    range is known beforehand and goes to the end of the range before it, too.
    """
    key = F.struct(*_order_key(id_col, text_col))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 1
    n, total, first = docs.agg(F.count("*"), F.sum(size), F.min(key)).first()
    ranges = max(1, min((total or 0) // range_bytes, n // 256, max_ranges))
    bounds = []
    if ranges > 1:
        drawn = docs.sample(min(1.0, draws * ranges / n), seed=7).select(*_order_key(id_col, text_col), size.alias("size"))
        bounds = choose_bounds([tuple(r) for r in drawn.collect()], ranges)

    fields = f"struct<{KEY.replace(' ', ':')}>".replace(",:", ",")
    salted = f"struct<{KEY.replace(' ', ':')},salt:double>".replace(",:", ",")
    named = [dict(zip(("last", "id", "hash", "salt"), b, strict=True)) for b in bounds]
    step = max(1, math.isqrt(len(named)))
    blocks = [named[i : i + step] for i in range(0, len(named), step)]
    coarse = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), f"array<{salted}>")
    fine = F.from_json(F.lit(json.dumps(blocks)), f"array<array<{salted}>>")
    heads = F.from_json(F.lit(json.dumps([first.asDict() if first else None, *[{k: b[k] for k in ("last", "id", "hash")} for b in named]])), f"array<{fields}>")

    def below(array: Column, row: Column) -> Column:
        return F.size(F.filter(array, lambda b: b <= row))

    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"), key.alias("key"), F.rand(11).alias("salt"))
    place = F.struct("key.last", "key.id", "key.hash", "salt")
    rows = rows.withColumn("block", below(coarse, place) if bounds else F.lit(0))
    within = below(F.get(fine, F.col("block") - 1), place) if bounds else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("block") == 0, 0).otherwise((F.col("block") - 1) * step + within))
    before = F.when(F.col("range") == 0, len(named)).otherwise(F.col("range") - 1)
    places = F.filter(
        F.array(F.struct(F.col("range"), F.lit(False).alias("ahead")), F.struct(before.alias("range"), F.lit(True).alias("ahead"))),
        lambda p: ~p["ahead"] | (F.get(heads, F.col("range")) == F.col("key")),
    )
    dealt = rows.select("id_", "text_", "key", F.explode(places).alias("place")).select("id_", "text_", "key", "place.*")
    dealt = dealt.repartition(len(named) + 1, "range").select("*", *[c.alias(name) for name, c in carried.items()])
    window = Window.partitionBy("range").orderBy("ahead", "key")
    found = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in ("text_", *carried)])
    return found.where(~F.col("ahead")).drop("ahead", "key", "range")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """Every row's sketch and that of its edited text, and how like they and the next row's are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next row, by
    descending id (see `with_next`). near_* are containments, the share of the text's shingles that the other has; jaccard_* go
    with them. Rows come back one for one, with no other columns of docs; an empty table gives none.
    """
    options = (fraction, least)
    rows = with_next(docs, {"sketch": sketch(F.col("text_"), width, *options)}, id_col, text_col)
    n = F.length("text_")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.left("text_", n - cut), F.left("next_text_", cut)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), width, *options))
    rows = rows.withColumn("as_edited", likeness(F.col("sketch"), F.col("edited_sketch"), *options)).withColumn("as_next", likeness(F.col("sketch"), F.col("next_sketch"), *options))
    return rows.select(
        F.col("id_").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("as_edited.containment").alias("near_edited"),
        F.col("as_next.containment").alias("near_next"),
        F.col("as_edited.jaccard").alias("jaccard_edited"),
        F.col("as_next.jaccard").alias("jaccard_next"),
    )
