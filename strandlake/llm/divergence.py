"""Source divergence audit: which terms, and which other sources, set a source of documents apart within its language.

Every text is counted once, where it lies; terms with their counts by group are then dealt in ranges of UTF-8 order, and walked
through a chunk at a time. A chunk has its distinct terms sorted, keeps those in enough documents, and numbers them by
searchsorted, so that ids ascend as the terms' bytes do; counting by id gives each group's dense vector of the chunk. Once all chunks have said how many terms are
kept and how many occurrences each group has, the shares follow, and with them, chunk by chunk, the sums over pairs of sources
and each source's first terms, ties to the smaller id. A chunk holds about `chunk_rows` rows, however many terms, groups or
documents there are; no vocabulary and no vector of all terms is ever in one place.

All arithmetic is exact, in 64-bit integers: shares of 1,000,000,000 by long division in base 1000, good for up to 9 * 10**15
occurrences in a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import cut_lineage, text_bytes

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
CHUNK_ROWS = 50_000
CHUNK_CELLS = 20_000_000
PIECE = 1 << 20
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
#: A to Z in lower case, other letters and all bytes from 0x80 on as they are, blanks for the rest.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def add_terms(text: bytes, occurrences: Counter, documents: Counter) -> None:
    """Counts a text's terms and, once each, the text; a long text is split a piece at a time, between terms."""
    text = text.translate(TERM_BYTES)
    seen, lo = set(), 0
    while lo < len(text):
        hi = text.find(b" ", lo + PIECE) if len(text) > lo + PIECE else -1
        hi = len(text) if hi < 0 else hi
        terms = text[lo:hi].split()
        occurrences.update(terms)
        seen.update(terms)
        lo = hi
    documents.update(seen)


def _count_terms(flush: int):
    """Arrow batches of (lang, source, text) to counts by group and term; a group without terms has a row with an empty one."""

    def rows(groups: dict) -> pa.RecordBatch:
        keys, terms, n, docs = [], [], [], []
        for key, (occurrences, documents) in groups.items():
            keys += [key] * (len(occurrences) + 1)
            terms += [b"", *occurrences]
            n += [0, *occurrences.values()]
            docs += [0, *(documents[t] for t in occurrences)]
        strings = pa.array(terms, pa.binary()).cast(pa.string())
        return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), strings, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = {}, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            view = memoryview(data)
            for i, (lang, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                occurrences, documents = groups.setdefault((lang or "", source or ""), (Counter(), Counter()))
                before = len(occurrences)
                add_terms(bytes(view[offsets[i] : offsets[i + 1]]), occurrences, documents)
                held += len(occurrences) - before
                if held > flush:
                    yield rows(groups)
                    groups, held = {}, 0
        if groups:
            yield rows(groups)

    return run


def group_counts(docs: DataFrame, flush: int = 100_000) -> DataFrame:
    """Occurrences and documents of each term by (lang, source); nulls are empty strings, and a group without terms is there too,
    with an empty term. Tasks add up what they read before anything is shuffled, `flush` distinct terms at a time."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count_terms(flush), COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), exactly."""
    below = total + 2 * kept
    whole, rest = np.divmod(counts + 2, below)
    out = 1 + whole * 1_000_000_000
    for scale in (1_000_000, 1_000, 1):
        digit, rest = np.divmod(rest * 1000, below)
        out += digit * scale
    return out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def encode_chunk(terms: list[str], sources: list[str], n: np.ndarray, docs: np.ndarray, least: int) -> tuple[list[str], list[str], np.ndarray]:
    """Kept terms of a chunk in UTF-8 order, its sources, and their counts: a dense row of kept ids for each source."""
    encoded = np.array([*(t.encode() for t in terms), None], object)[:-1]
    distinct = np.array([*sorted(set(encoded)), None], object)[:-1]
    ids = np.searchsorted(distinct, encoded)
    keep = np.bincount(ids, docs, len(distinct)) >= least
    kept, on = distinct[keep], keep[ids]
    ids = (np.cumsum(keep) - 1)[ids[on]]
    own, at = np.unique(np.array([s for s, o in zip(sources, on, strict=True) if o], object), return_inverse=True)
    cells = np.zeros(len(own) * len(kept), np.int64)
    np.add.at(cells, at * len(kept) + ids, n[on])
    return [t.decode() for t in kept], own.tolist(), cells.reshape(len(own), len(kept))


VECTORS = "lang string, terms array<string>, sources array<string>, sums array<bigint>, counts array<array<bigint>>"
LONGS = pa.list_(pa.int64())


def _encode(least: int, chunk_rows: int):
    """Rows of (lang, term, source, n, docs) in the order of lang and term, a chunk at a time; a term is in one chunk only."""

    def vectors(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        langs = rows.column(0).combine_chunks()
        for lang in pc.unique(langs).to_pylist():
            _, terms, sources, n, docs = (c.combine_chunks() for c in rows.filter(pc.equal(langs, lang)).columns)
            kept, own, dense = encode_chunk(terms.to_pylist(), sources.to_pylist(), n.to_numpy(), docs.to_numpy(), least)
            if kept:
                columns = [pa.array([lang]), pa.array([kept], pa.list_(pa.string())), pa.array([own], pa.list_(pa.string())), pa.array([dense.sum(axis=1)], LONGS), pa.array([list(dense)], pa.list_(LONGS))]
                yield pa.record_batch(columns, ["lang", "terms", "sources", "sums", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < chunk_rows:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows.column(i)[-1].as_py() for i in (0, 1)]
            same = pc.and_(pc.equal(rows.column(0), last[0]), pc.equal(rows.column(1), last[1]))
            cut = rows.num_rows - pc.sum(same).as_py()
            if cut:
                yield from vectors(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                n -= cut
        if held:
            yield from vectors(pa.Table.from_batches(held))

    return run


def dense_vectors(counts: DataFrame, least: int = LEAST_DOCUMENTS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A row for each chunk: its language, its kept terms in UTF-8 order, the sources that have any, their sums and dense counts.

    Rows are dealt in ranges of (lang, term) and sorted, so a task walks through its range a chunk at a time. With many
    sources chunks are shorter, so that sources times terms stay below CHUNK_CELLS.
    """
    sources = counts.where("term = ''").groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    rows = counts.where("term != ''").select("lang", "term", "source", "n", "docs")
    return rows.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_encode(least, max(1, min(chunk_rows, CHUNK_CELLS // sources))), VECTORS)


PARTS = "lang string, source string, part string, item string, value bigint"


def _compare(top: int, block: int = 64):
    """Chunks with the sizes of their language to partial sums over pairs and the first terms of each source."""

    def blocks(lang, terms, sources, dense, kept, everyone, totals):
        row = {s: i for i, s in enumerate(sources)}
        everyone = sorted(everyone)  # by code points, which is the order of UTF-8
        total = dict(totals)

        def of(names):
            picked = np.zeros((len(names), len(terms)), np.int64)
            for i, s in enumerate(names):
                if s in row:
                    picked[i] = dense[row[s]]
            return shares(picked, np.array([total[s] for s in names], np.int64)[:, None], kept)

        q = shares(dense.sum(axis=0)[None], np.array([[sum(total.values())]], np.int64), kept)[0]
        for lo in range(0, len(everyone), block):
            names = everyone[lo : lo + block]
            p = of(names)
            for at in range(lo, len(everyone), block):
                others = everyone[at : at + block]
                r = p if at == lo else of(others)
                for i, s in enumerate(names):
                    sums = gap(p[i][None], r).sum(axis=1)
                    for other, v in zip(others, sums.tolist(), strict=True):
                        if s < other:
                            yield lang, s, "pair", other, v
                            yield lang, other, "pair", s, v
            for i, s in enumerate(names):
                if s not in row:
                    continue
                ids = np.flatnonzero((dense[row[s]] > 0) & (p[i] > q))
                values = gap(p[i][ids], q[ids])
                for j in np.lexsort((ids, -values))[:top]:
                    yield lang, s, "term", terms[ids[j]], int(values[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rest = Counter(), []

        def flush():
            rows = [(*k, v) for k, v in sums.items()] + rest
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.string()] * 4 + [pa.int64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "source", "part", "item", "value"])

        for batch in batches:
            for r in range(batch.num_rows):
                lang, terms, sources, counts, kept, everyone, totals = (batch.column(i)[r] for i in range(7))
                terms = terms.as_py()
                dense = counts.values.flatten().to_numpy().reshape(len(sources), len(terms)) if len(sources) else np.zeros((0, len(terms)), np.int64)
                names = everyone.as_py()
                for found in blocks(lang.as_py(), terms, sources.as_py(), dense, kept.as_py(), names, zip(names, totals.as_py(), strict=True)):
                    if found[2] == "pair":
                        sums[found[:4]] += found[4]
                    else:
                        rest.append(found)
                if len(sums) + len(rest) > 500_000:
                    yield flush()
                    sums, rest = Counter(), []
        yield flush()

    return run


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` the source's
    `top` terms that it has a larger share of than the language.

    Null text, lang and source are empty strings. Repeated rows and ids are rows like any other. A language of one source has no
    pairs, one without kept terms pairs of value 0 and no terms; an empty table gives no rows. Other columns are not looked at.
    """
    counts = cut_lineage(group_counts(docs))
    vectors = cut_lineage(dense_vectors(counts, least, chunk_rows))
    groups = counts.where("term = ''").select("lang", "source")
    totals = vectors.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("v")).select("lang", F.col("v.sources").alias("source"), F.col("v.sums").alias("n"))
    totals = groups.join(totals.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"])
    kept = vectors.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    sizes = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
    sizes = sizes.join(kept, "lang", "left").select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.col("g.source").alias("everyone"), F.col("g.n").alias("totals"))
    chunks = vectors.join(sizes, "lang").select("lang", "terms", "sources", "counts", "kept", "everyone", "totals")
    parts = chunks.mapInArrow(_compare(top), PARTS).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    empty = sizes.where("kept = 0").select("lang", F.explode("everyone").alias("source"), "everyone").select("lang", "source", F.lit("pair").alias("part"), F.explode("everyone").alias("item"), F.lit(0).cast("bigint").alias("value")).where("source != item")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = parts.unionByName(empty).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
