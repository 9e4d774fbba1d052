"""Language identification by error-correcting output codes over byte n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import batch_pieces, free_name

UNDETERMINED = "und"

#: Buckets of 1-, 2- and 3-grams of bytes.
BUCKETS = (256, 4096, 8192)
COLUMNS = sum(BUCKETS)

#: a-z and all bytes of multi-byte characters stand for themselves, all else for a separator.
FOLDED = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def gram_histogram(data: np.ndarray, offsets: np.ndarray, window: int = 1 << 19) -> np.ndarray:
    """Counts of hashed n-grams, a line for each text; runs of separators count as one, no gram spans two texts.

    Grams are counted by windows of their first byte, so a long text takes no more memory than its bytes and a window.
    """
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    byte = FOLDED[data]
    keep = byte != 32
    keep[1:] |= byte[:-1] != 32
    byte, row = byte[keep], row[keep]
    out = np.zeros(rows * COLUMNS, np.int64)
    for at in range(0, len(byte), window):
        part, of = byte[at : at + window + 2].astype(np.uint32), row[at : at + window + 2]
        here = min(window, len(part))
        base, code, found = 0, part, []
        for n, size in zip((1, 2, 3), BUCKETS, strict=True):
            if n > 1:
                code = (code[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            first, last = of[: len(part) - n + 1][:here], of[n - 1 :][:here]
            bucket = code[:here] if n == 1 else (code[:here] * np.uint32(2654435761)) >> np.uint32(33 - size.bit_length())
            found.append((first.astype(np.int64) * COLUMNS + base + bucket)[first == last])
            base += size
        out += np.bincount(np.concatenate(found), minlength=rows * COLUMNS)
    return out.reshape(rows, COLUMNS)


def codewords(classes: int, seed: int = 7, per_doubling: int = 10, tries: int = 200) -> np.ndarray:
    """A line of +1/-1 bits for each class: `per_doubling` bits for each doubling of the classes, or as many as there are.

    The bits of a code are different ways to part the classes in two (a bit and its opposite are one way). Of `tries` random
    codes the one whose closest pair of lines is farthest apart is taken.
    """
    if classes < 2:
        return np.ones((classes, 1), np.int8)
    ways = (1 << (classes - 1)) - 1 if classes < 60 else 1 << 60
    bits = min(ways, per_doubling * int(np.ceil(np.log2(classes))))
    rng, best, found = np.random.default_rng(seed), -1, None
    for _ in range(tries):
        chosen: dict[bytes, np.ndarray] = {}
        while len(chosen) < bits:
            way = rng.integers(0, 2, classes)
            way ^= way[0]  # the first class has 0
            if way.any():
                chosen[way.tobytes()] = way
        code = (1 - 2 * np.array(list(chosen.values()))).T.astype(np.int8)
        agree = code.astype(int) @ code.T
        least = (bits - agree[~np.eye(classes, dtype=bool)].max()) // 2
        if least > best:
            best, found = least, code
        if bits == ways:
            break
    return found


@dataclass(frozen=True)
class LanguageModel:
    """Languages in sorted order, their codewords, and a line of n-gram weights for each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def decode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and scores. A bit's margin is the summed evidence of its classifier, shared out over the
        three overlapping n-gram orders; a codeword's loss is the sum of logistic losses of its bits; the score is
        the nearest codeword's share of exp(-loss)."""
        margins = gram_histogram(data, offsets) @ self.weights.T / 6
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        loss -= loss.min(1, keepdims=True)
        return loss.argmin(1), 1 / np.exp(-np.minimum(loss, 700)).sum(1)


def fit_languages(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel | None:
    """A model from all rows of docs with text and language, or None if there are none.

    Each task sums its n-gram counts by language, so the shuffle and the driver get one count for each language and
    bucket at most. Bit classifiers are generative: the log ratio of a bucket's mean frequency over the languages
    with that bit set to that over the others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch, data, offsets in batch_pieces(batches, 1, 1 << 19, 128):
            counts = gram_histogram(data, offsets)
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + counts[langs == lang].sum(0)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    table = np.zeros((len(languages), COLUMNS))
    table[[languages.index(x) for x in counts["lang"]], counts["bucket"].to_numpy(int)] = counts["n"]
    base = 0
    for size in BUCKETS:
        part = table[:, base : base + size] + smoothing
        table[:, base : base + size] = part / part.sum(1, keepdims=True)
        base += size
    code = codewords(len(languages))
    weights = np.zeros((code.shape[1], COLUMNS))
    for bit in range(code.shape[1] if len(languages) > 1 else 0):
        weights[bit] = np.log(table[code[:, bit] > 0].mean(0) / table[code[:, bit] < 0].mean(0))
    return LanguageModel(languages, code, weights)


def identify_languages(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.75, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous (score under ambiguous_below) of every row of docs.

    `und` with score 0, and ambiguous, if the text is null or has no letter, or nothing was learned. Whole texts
    count. A tie goes to the language first in order. Columns named in carry come along; others are ignored, and no
    column but the text has a part in the prediction. Null ids and repeated rows give one row each, an empty table none.
    """
    names = ["doc_id", *carry]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batch_pieces(batches, len(names), 1 << 19, 128):
            known = pc.fill_null(batch.column(len(names) + 1), False).to_numpy(zero_copy_only=False)
            if model is None:
                known = np.zeros(len(known), bool)
                best, score = np.zeros(len(known), int), np.zeros(len(known))
            else:
                best, score = model.decode(data, offsets)
            score = np.where(known, score, 0.0)
            lang = pa.array([model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], pa.string())
            columns = [*batch.columns[: len(names)], lang, pa.array(score), pa.array(score < ambiguous_below)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.lower(text_col).alias("text_"), F.col(text_col).rlike(r"\p{L}").alias("letters_"))
    types = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(predict, f"{types}, lang_pred string, score double, ambiguous boolean")


def keep_languages(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text", ambiguous_below: float = 0.75) -> DataFrame:
    """The rows of docs whose language is told without ambiguity (see identify_languages), all columns as they were, whatever
    their names. Null texts, and texts without a letter, go; rows stand or fall each for itself. Without a model all stay."""
    if model is None:
        return docs
    lowered, letters = free_name(docs, "lowered"), free_name(docs, "letters")
    names = docs.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batch_pieces(batches, len(names), 1 << 19, 128):
            known = pc.fill_null(batch.column(len(names) + 1), False).to_numpy(zero_copy_only=False)
            kept = pa.array(known & (model.decode(data, offsets)[1] >= ambiguous_below))
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in batch.columns[: len(names)]], names)

    return docs.withColumns({lowered: F.lower(text_col), letters: F.col(text_col).rlike(r"\p{L}")}).mapInArrow(pick, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
