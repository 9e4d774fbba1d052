"""The pipeline as a whole: the rows of its stages one after another, whole texts in the pieces, and no folders left behind."""

import os

import public_tokenizers
import pytest

from strandlake.llm.pieces import PieceModel, decode_pieces
from strandlake.llm.support import shared_folder

pipeline = pytest.importorskip("corpus_pipeline")


def test_run_is_its_stages_in_order(spark, sf_dir, documents):
    def folders():
        root = shared_folder(spark).removeprefix("file:")
        return {f"{root}/{f}" for f in os.listdir(root) if f.startswith("pipeline-")}

    before = folders()
    rows = pipeline.run(spark, sf_dir)
    docs, kept = documents, [documents.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        kept.append(docs.count())
    assert all(a >= b for a, b in zip(kept, kept[1:], strict=False)) and kept[0] > kept[-1] > 0
    decoded = decode_pieces(rows, PieceModel.load(public_tokenizers.path("piece_bpe_32k.model")))
    want = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert sorted((r["doc_id"], r["decoded"]) for r in decoded.collect()) == want
    (folder,) = folders() - before
    assert [f.split("-", 1)[1] for f in os.listdir(folder)] == [pipeline.STAGES[-1][0]]
