"""Token counts: lengths of the token sequences of whole texts, from Arrow batches."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import pieces, text_bytes

#: A space between two visible characters. The byte-level pattern starts a new pre-token at such a space, whatever
#: stands before it, so the counts of the parts add up to the count of the whole.
SAFE = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")

#: Where long texts are cut: before such a space or a line feed after any letter, digit or visible ASCII character; between an
#: ASCII letter and a digit; and between an ideograph, kana or Hangul syllable and a full-width stop, comma or the like. The
#: pattern never joins these, in whatever script, so texts of one endless line have places to be cut, too.
CUTS = re.compile("(?<=[!-~\\w])(?=[ \n][!-~\\w])|(?<=[A-Za-z])(?=[0-9])|(?<=[\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fa5\uac00-\ud7a3])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")

#: Bytes of a worker's table of known parts before it is emptied, what an entry takes besides its characters, and the longest
#: part that is remembered: longer ones hardly come again.
REMEMBERED, ENTRY, LONGEST = 64 << 20, 120, 64

_counters: dict[str, PartCounter] = {}


def safe_parts(text: str, longest: int) -> Iterator[str]:
    """A text in parts of about `longest` characters, cut at CUTS."""
    lo = 0
    while lo < len(text):
        found = CUTS.search(text, lo + longest)
        hi = found.start() if found else len(text)
        yield text[lo:hi]
        lo = hi


class PartCounter:
    """Counts texts as sums over their parts; each distinct part of a batch is encoded once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered = remembered
        self.known: dict[str, int] = {}
        self.held = 0

    def count(self, texts: list[str], longest: int = 1 << 20) -> list[int]:
        """The number of tokens of each text; one of over `longest` characters is counted in safe parts."""
        if any(len(t) > longest for t in texts):
            return [self.count([t])[0] if len(t) <= longest else sum(self.count([p], len(p))[0] for p in safe_parts(t, longest)) for t in texts]
        split = []
        for text in texts:
            first, *rest = SAFE.split(text)
            split.append([first, *[" " + x for x in rest]])
        if self.held > self.remembered:
            self.known, self.held = {}, 0
        new = list(set().union(*split) - self.known.keys())
        encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        found = dict(zip(new, map(len, encoded), strict=True))
        long = {part: n for part, n in found.items() if len(part) > LONGEST}
        for part in long:
            del found[part]
        self.known.update(found)
        self.held += sum(map(len, found)) + ENTRY * len(found)
        if not long:
            get = self.known.__getitem__
            return [sum(map(get, parts)) for parts in split]
        return [sum([long[p] if len(p) > LONGEST else self.known[p] for p in parts]) for parts in split]


def counter(path: str) -> PartCounter:
    """One for each worker process, kept between tasks."""
    if path not in _counters:
        _counters[path] = PartCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    Only lengths leave the workers. Batches hold about batch_bytes of text each, so that a few long texts weigh as
    much as many short ones, and texts are split where the pre-tokenizer always splits: all at SAFE, very long ones in
    parts at CUTS. A null text counts as empty: 0 bytes, 0 tokens, not over. Special strings in a text are handled as the library
    does by default. Null ids and repeated rows give one row each, an empty table none; other columns
    of docs are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            _, offsets = text_bytes(texts)
            for lo, hi in pieces(offsets, batch_bytes):
                n = np.array(counter(tokenizer_path).count(texts.slice(lo, hi - lo).to_pylist()), np.int64)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_bytes long, n_tokens long, over_limit boolean")
