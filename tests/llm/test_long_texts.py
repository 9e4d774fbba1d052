"""Very long texts are worked through in windows, with the same results as in one go."""

import random

import numpy as np
import pytest

from strandlake.llm.decontamination import PassageIndex
from strandlake.llm.language_id import gram_histogram
from strandlake.llm.pieces import PieceModel
from strandlake.llm.registry import tokenizer
from strandlake.llm.simhash import fingerprint
from strandlake.llm.support import span_hashes, spans
from strandlake.llm.token_counts import PartCounter


@pytest.fixture(scope="module")
def text():
    rng = random.Random(1)
    words = ["the", "of", "Ünder", "license", "a", "x" * 70, "漢字", "it's", "12", "&&&", "\n", ""]
    return " ".join(rng.choices(words, k=60_000))


def buffers(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_hashes(text):
    data, offsets = buffers(text, "y" * 5000, text[:999])
    starts, ends = spans(data > 32, offsets)
    whole = span_hashes(data, starts, ends, 1 << 30)
    for window in (64, 1000, 4096):
        assert (span_hashes(data, starts, ends, window) == whole).all()


def test_histograms(text):
    data, offsets = buffers(text[:20_000].lower(), "", "ab", text[50:90])
    whole = gram_histogram(data, offsets)
    for window in (1, 7, 1000):
        assert (gram_histogram(data[: offsets[1]] if window == 1 else data, offsets[:2] if window == 1 else offsets, window) == (whole[:1] if window == 1 else whole)).all()


def test_shared_grams(text):
    index = PassageIndex([text[:300], text[4000:4200]], 0.08)
    data, _ = buffers(text[:30_000].lower())
    hits = lambda *a: [np.concatenate(x).tolist() for x in zip(*index.hits(data, *a), strict=True)]
    assert hits()[0] and all(hits(w) == hits() for w in (50, 999))


def test_tokens_and_pieces(text):
    counter = PartCounter(tokenizer("byte_bpe_50k.json"))
    expected = [len(e) for e in counter.tokenizer.encode_batch([text, "short"], add_special_tokens=False)]
    assert counter.count([text, "short"]) == counter.count([text, "short"], 500) == expected
    model = PieceModel.load(tokenizer("piece_bpe_32k.model"))
    raw = [text.encode(), b"short", b""]
    assert model.encode(raw) == model.encode(raw, 700)


def test_fingerprint_of_many_shingles(text):
    import xxhash

    words = text.encode().lower().split()
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    ones = [(int((hashes >> np.uint64(b) & np.uint64(1)).sum()), b) for b in range(64)]
    assert fingerprint(text.encode(), 3, 42) == sum(1 << b for n, b in ones if 2 * n > len(hashes))
    assert all(fingerprint(t, 3, 42) == (xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 42) if t.split() else 0) for t in (b"a", b"a B", b"", b" \n"))


def test_what_workers_remember_is_bounded_by_bytes():
    """Long parts without blanks are counted and encoded rightly and not kept."""
    from strandlake.llm import pieces, token_counts

    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdef0123456789+/", k=n)) for n in (50, 64, 65, 70, 5000, 100_000)] * 2
    texts = [t + " and " + t[:9] for t in texts]
    counter = PartCounter(tokenizer("byte_bpe_50k.json"), remembered=400)
    whole = [len(e.ids) for e in counter.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [counter.count([t])[0] for t in texts] == whole == counter.count(texts)
    assert max(map(len, counter.known)) <= token_counts.LONGEST and counter.held == sum(map(len, counter.known)) + token_counts.ENTRY * len(counter.known)
    model = PieceModel.load(tokenizer("piece_bpe_32k.model"))
    fresh = PieceModel.load(tokenizer("piece_bpe_32k.model"))
    raw = [t.encode() for t in texts]
    assert model.encode(raw) == [fresh.encode([r])[0] for r in raw]
    assert max(map(len, model.known)) <= pieces.LONGEST and model.held == sum(len(k) + len(v) + pieces.ENTRY for k, v in model.known.items())
