"""Where long texts are cut for counting, items too small to drop a text for, and clashing names of piece columns."""

import base64
import os
import random

import public_tokenizers
import pytest

from strandlake.llm.decontamination import drop_leaks, find_leaks
from strandlake.llm.pieces import PieceModel, decode_pieces, encode_pieces
from strandlake.llm.token_counts import PartCounter, safe_parts


@pytest.fixture(scope="module")
def counter():
    return PartCounter(public_tokenizers.path("byte_bpe_50k.json"))


def size(counter, text):
    return len(counter.tokenizer.encode(text, add_special_tokens=False))


def test_op10_cuts_never_change_a_count(counter):
    rng = random.Random(1)
    letters = "ab Z\u00e99'\u00df_ \n\n\t..!-,\u3002\uff0c\u5b57\u8a9e\u304b\u30ca\ud55c\uae00\u0436\u042f\u00b2\u00bd\u200b\u00a0\u3000e\u0301"
    for i in range(1500):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 120)))
        if i % 5 == 0:
            text = text.replace("\u5b57", "<|endoftext|>")
        parts = list(safe_parts(text, rng.randrange(1, 9)))
        assert "".join(parts) == text and sum(size(counter, p) for p in parts) == size(counter, text), text


@pytest.mark.parametrize(
    "text",
    [
        "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 30_000,
        "\u5929\u5730\u7384\u9ec3\uff0c\u65e5\u6708\u76c8\u6603\u3002" * 30_000,
        base64.b64encode(os.urandom(200_000)).decode(),
        "\u0441\u043b\u043e\u0432\u043e\n" * 60_000,
    ],
    ids=["cyrillic", "chinese", "base64", "lines"],
)
def test_op10_long_texts_of_any_script_are_cut(counter, text):
    parts = list(safe_parts(text, 1 << 14))
    assert len(parts) > len(text) / (1 << 15) and max(map(len, parts)) < 2 << 14
    assert counter.count([text, "a"], 1 << 14) == [size(counter, text), 1]


def test_op9_tiny_items_are_listed_and_drop_nothing_below_a_length(spark):
    docs = spark.createDataFrame([(i, f"A text number {i}. Yes. Nothing else stands in it.") for i in range(50)] + [(50, "here is the long benchmark passage of several words in it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A"), (2, "Yes."), (3, "the long benchmark passage of several words")], "item_id long, text string")
    assert {r["item_id"] for r in find_leaks(docs, items).collect()} == {1, 2, 3}
    assert sorted(r["doc_id"] for r in drop_leaks(docs, items, least=16).collect()) == list(range(50))
    assert drop_leaks(docs, items).count() == 0
    assert drop_leaks(docs, items, least=1000).count() == 51


def test_op4_clashing_names(spark):
    model = PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(1, "a b", [7], "old", "t"), (2, None, None, None, None)], "doc_id long, text string, pieces array<int>, decoded string, text_ string")
    encoded = encode_pieces(df, model, carry=("pieces", "decoded", "text", "text_"))
    assert encoded.columns == ["doc_id", "pieces_", "decoded", "text", "text_", "pieces", "n_pieces"]
    rows = decode_pieces(encoded, model).orderBy("doc_id").collect()
    assert [(r["decoded"], r["decoded_"], r["pieces_"], r["text_"]) for r in rows] == [("old", "a b", [7], "t"), (None, "", None, None)]
    assert decode_pieces(encoded.limit(0), model).count() == 0
