"""Every stage of the pipeline on odd rows, extra columns and empty tables, and its near copies at the edge of similarity."""

import random

import pytest
from pyspark.sql import functions as F
from test_near_copies import survivors, words

pipeline = pytest.importorskip("corpus_pipeline")

ODD = ["", None, " ", "a", "A b", "\n\n", "é", "x" * 5000, "word " * 3000, "the same text here again", "the same text here again", "12 34 56"]
CLASHES = lambda: {"node": F.lit(1), "noise": F.lit("x"), "Component": F.lit(None).cast("int"), "lowered": F.lit(2.0), "score": F.array(F.lit(1)), "kept": F.lit(True)}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(10_000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(10_004, "A b", "en", "s", 3)] * 2 + [(None, "no id", None, None, None)] * 2
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return table.unionByName(odd).withColumns(CLASHES()).cache()


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf_dir, docs, name):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    if name != "piece_encoding":
        assert out.schema.names == docs.schema.names
    got = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert stage(spark, docs.where("doc_id is null"), sf_dir).count() <= 2
    times = {d: got.count(d) for d in (10_004, None)}
    if name == "piece_encoding":
        assert len(got) == docs.count()
    elif name == "near_duplicates":
        assert times[10_004] == 1 and times[None] == 1 and sum(10_000 <= (d or 0) for d in got) == len({" ".join((t or "").lower().split()) for t in ODD})
    else:
        assert times[10_004] in (0, 3) and times[None] in (0, 2)
        assert {"language_id": 10_001 not in got, "quality": 10_001 not in got, "decontamination": {10_000, 10_001, 10_008} <= set(got)}[name]


def test_stages_without_anything_to_learn_from(spark, sf_dir, docs):
    blank = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    assert pipeline.language_stage(spark, blank, sf_dir).count() == blank.count()
    assert pipeline.quality_stage(spark, blank, sf_dir).count() == blank.count()


def test_different_texts_of_one_id_stay_and_unlike_short_texts_too(spark, sf_dir):
    rng = random.Random(8)
    rows = [(7, "one text of its own"), (7, "quite another text with no word shared"), *((100 + i, words(rng, 4)) for i in range(3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pipeline.near_duplicate_stage(spark, df, sf_dir).count() == len(rows)


def test_a_family_at_the_edge_of_similarity(spark, sf_dir):
    """Copies with some words replaced, so that similarities of pairs lie on both sides of 0.8."""
    rng = random.Random(9)
    base = words(rng, 120).split()
    rows = []
    for i in range(260):
        copy = list(base)
        for at in rng.sample(range(0, 120, 6), rng.randint(0, 4)):
            copy[at] = words(rng, 1)
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in pipeline.near_duplicate_stage(spark, df, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == survivors(rows)
