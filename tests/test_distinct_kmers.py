"""The exact counts of q_distinct_kmers are taken from distinct words, not from every word twice."""

from strandlake.plans.catalog import QUERIES


def test_words_are_made_distinct_before_the_rollup(spark, sf_dir):
    lines = QUERIES["q_distinct_kmers"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    expands = [i for i, line in enumerate(lines) if "Expand [" in line]
    assert len(expands) == 2
    for i in expands:
        below = lines[i : next(j for j in range(i, len(lines)) if "Generate " in lines[j])]
        assert any("Aggregate [" in line for line in below)
