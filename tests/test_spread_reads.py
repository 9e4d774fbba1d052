"""Reads are derived by some tasks for each core, and only their keys are shuffled."""

import contextlib
import io

from strandlake.plans import catalog


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_derivation_has_some_tasks_for_each_core(spark, sf_dir):
    rows = catalog.derived(spark, sf_dir)
    assert rows.columns == ["k", "header", "seq", "quality"]
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_tasks_stay_small_however_many_reads(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_READS", 20)
    rows = catalog.derived(spark, sf_dir)
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 20)


def test_texts_shuffle_keys_alone(spark, sf_dir):
    plan = plan_of(catalog.parsed(spark, sf_dir))
    assert plan.count("Exchange") == 1
    below = plan[plan.index("Exchange"):]
    assert "md5" not in below and "md5" in plan
