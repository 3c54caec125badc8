"""The stages on odd rows, and the whole pipeline on the smallest tables."""

from __future__ import annotations

import corpus_pipeline as pipeline
from tests.llm.test_operators import docs


def test_stages_on_odd_rows(spark, small_dir):
    rows = docs(spark).cache()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, rows, small_dir)
        assert out.columns == rows.columns, name
        assert 0 < out.count(), name


def test_run(spark, small_dir):
    got = pipeline.run(spark, small_dir).toPandas()
    assert len(got) and (got.groupby("sequence_id").length.sum() <= 1024).all()
