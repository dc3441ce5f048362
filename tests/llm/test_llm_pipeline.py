"""The pipeline's stages, one after the other, on the smallest data."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {x["doc_id"] for x in pieces.select("doc_id").collect()} == {x["doc_id"] for x in docs.select("doc_id").collect()}


def test_stages_take_columns_that_clash(spark):
    """Names that differ in case alone, and names that the stages use themselves."""
    rows = [(1, "some words of a text", "en", "s", 20, "other", 1, 2, "x"), (1, "some words of a text", "en", "s", 20, "other", 1, 2, "x"), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Text string, __gone int, base_failed int, s string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 3
