"""Queries of this subpackage against their SQL."""

import pytest

from strandlake.llm import registry


@pytest.mark.parametrize("name", ["q_license_base", "q_token_bytes", "q_shard_laws", "q_edited_texts", "op12_divergence", "op13_ball_kmeans"])
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    rows = found.fetchall()
    assert key(df.select(columns).collect()) == key(rows) and rows
