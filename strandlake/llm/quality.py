"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import batch_pieces, cut_lineage, free_name, mixed, span_hashes, spans

#: Buckets of single tokens and of token pairs, and of both.
HALF = 1 << 14
BUCKETS = 2 * HALF

#: Classes of bytes: 0 white space and controls, 1 of words (lower-cased by LOWER), 2 other signs.
CLASS = np.array([1 if b >= 128 or chr(b).isalnum() else 2 if 32 < b < 127 else 0 for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all tokens and pairs of neighbouring tokens; a token is a run of word bytes or of signs."""
    kind = CLASS[data]
    found = []
    for k in (1, 2):
        found.append(spans(kind == k, offsets))
    starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    row = np.searchsorted(offsets, starts, "right") - 1
    h = span_hashes(LOWER[data], starts, ends)
    same = row[1:] == row[:-1]
    with np.errstate(over="ignore"):
        pair = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
    low = np.uint64(HALF - 1)
    return np.concatenate([row, row[1:][same]]), np.concatenate([mixed(h) & low, (pair & low) + np.uint64(HALF)]).astype(np.int64)


@dataclass(frozen=True)
class Resampler:
    """The log ratio of target to raw frequency by bucket, the n-grams that every text counts for and those that a short one
    is filled up with, and the lowest key kept."""

    log_ratio: np.ndarray
    length: float
    prior: float
    cut: float

    def weights(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log importance weight and the number of n-grams of each text.

        The n-gram models are unigram models, whose log ratio grows with a text's length. All texts are weighed as if they
        had `length` n-grams: that many times the mean log ratio, where `prior` n-grams of ratio 0 are added to each text,
        so a text of a few words is told from the target by no more than it shows.
        """
        row, bucket = gram_buckets(data, offsets)
        n = np.bincount(row, minlength=len(offsets) - 1)
        return self.length * np.bincount(row, self.log_ratio[bucket], len(offsets) - 1) / np.maximum(n + self.prior, 1), n


def gumbel(id_col: str, seed: int) -> Column:
    """A draw from the standard Gumbel distribution that depends on id and seed only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, fan: int = 1024) -> float:
    """The k-th largest value of a column of doubles, exactly; counts of at most `fan` bins reach the driver at a time."""
    df = df.where(F.col(column).isNotNull())
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return math.inf
    k = min(k, n)
    while lo < hi:
        bin_ = F.least(F.floor((F.col(column) - lo) / (hi - lo) * fan), F.lit(fan - 1))
        bins = df.where(F.col(column).between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if k <= b["n"]:
                lo, hi = b["lo"], b["hi"]
                break
            k -= b["n"]
    return lo


def count_grams(docs: DataFrame, text_col: str, group_col: str) -> dict[int | None, np.ndarray]:
    """Counts by bucket, for each value of group_col (a small integer or null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch, data, offsets in batch_pieces(batches, 1):
            row, bucket = gram_buckets(data, offsets)
            group = batch.column(0).fill_null(-1).to_numpy()
            for g in np.unique(group).tolist():
                total[g] = total.get(g, 0) + np.bincount(bucket[group[row] == g], minlength=BUCKETS)
        for g, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["g", "bucket", "n"])

    rows = docs.select(F.col(group_col).cast("int").alias("g"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(count, "g int, bucket int, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for g, part in counts.groupby("g"):
        out[None if g < 0 else int(g)] = np.bincount(part["bucket"], part["n"], BUCKETS)
    return out


def good_share(labels: DataFrame, z: float = 1.0) -> float:
    """The share of labels with quality 1, a standard error (z) up in its Wilson interval, so few labels keep more; 1 without
    a label of quality 1."""
    n, good = labels.where(F.col("quality").isNotNull()).agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1)), F.lit(0))).first()
    if not n or not good:
        return 1.0
    p, zz = good / n, z * z / n
    return min(1.0, (p + zz / 2 + math.sqrt(p * (1 - p) * zz + zz * zz / 4)) / (1 + zz))


def fit_resampler(docs: DataFrame, labels: DataFrame, *, label_bound: int = 20_000, smoothing: float = 0.5, length: float = 256.0, prior: float = 16.0, seed: int = 11, keep: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[Resampler | None, DataFrame]:
    """The resampler for docs, and every row's doc_id, log_weight, n_grams and key (null without a token).

    labels (doc_id, quality 0 or 1): the texts of quality 1 are the target, of at most label_bound labelled rows, those of
    least hash. Raw counts cover all docs. The target model is smoothed by the raw one, which counts `smoothing` times as
    much as the target. Keys are log importance weights (Resampler.weights) plus standard Gumbel noise; the `keep` largest
    are a sample without replacement in proportion to the weights. By default keep is the number of texts with a token times
    good_share(labels), the share of the raw texts that is expected to be of the target. Rows whose keys tie with the last
    one kept are kept too. Without a text of quality 1 there is no model (None): all log weights are 0, all keys are kept.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    few = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(order, "doc_id", "quality").limit(label_bound)
    few = few.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality_"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc_id", "left")
    counts = count_grams(rows, "text", "quality_")
    raw, target = sum(counts.values(), np.zeros(BUCKETS)), counts.get(1, np.zeros(BUCKETS))
    log_ratio = np.zeros(BUCKETS)
    if target.any():
        for half in (slice(0, HALF), slice(HALF, BUCKETS)):
            p, r = target[half] + smoothing * target[half].sum() * raw[half] / max(raw[half].sum(), 1) + 1e-9, raw[half] + 1e-9
            log_ratio[half] = np.log(p / p.sum()) - np.log(r / r.sum())
    model = Resampler(log_ratio, length, prior, -math.inf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batch_pieces(batches, 1):
            weight, n = model.weights(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight, mask=n == 0), pa.array(n)], ["doc_id", "log_weight", "n_grams"])

    scored = rows.select("doc_id", "text").mapInArrow(score, f"doc_id {rows.dtypes[0][1]}, log_weight double, n_grams long")
    keyed = cut_lineage(scored.withColumn("key", F.col("log_weight") + gumbel("doc_id", seed)))
    if not target.any():
        return None, keyed
    if keep is None:
        keep = math.ceil(good_share(labels) * keyed.where("n_grams > 0").count())
    return replace(model, cut=kth_largest(keyed, "key", keep)), keyed


def sample_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, log_weight, n_grams and key of the rows that importance resampling keeps; see fit_resampler.

    Null and empty texts, and texts without a token, are never kept. Null ids share one noise draw; repeated rows are
    kept or go together, as do all rows whose key equals the last one kept, so ties can keep more than `keep` rows; an
    empty table gives no rows. Other columns of docs are ignored.
    """
    model, keyed = fit_resampler(docs, labels, **options)
    return keyed.where(F.col("key").isNotNull() if model is None else F.col("key") >= F.lit(model.cut))


def keep_quality(docs: DataFrame, model: Resampler | None, *, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the resampler keeps, all columns as they were, whatever their names; all rows without a model.

    Texts are scored again, so none is shuffled. Nulls, ties, repeated rows and empty tables are as in sample_quality.
    """
    if model is None:
        return docs
    noise = free_name(docs, "noise")
    at, names = docs.columns.index(text_col), docs.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batch_pieces(batches, at):
            weight, n = model.weights(data, offsets)
            kept = pa.array((n > 0) & (weight + batch.column(len(names)).to_numpy() >= model.cut))
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in batch.columns[: len(names)]], names)

    return docs.withColumn(noise, gumbel(id_col, seed)).mapInArrow(pick, docs.schema)
