"""The pipeline, stage by stage, against what the stages promise."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")


def test_stages(spark):
    from test_free import classes_by_hand

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect()
        after = stage(spark, docs, FOLDER)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(after.columns) == corpus_pipeline.COLUMNS
            docs = corpus_pipeline.keep(after, "stage")
            rows = docs.collect()
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before}
        if name == "quality classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in rows}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.95 * len(good)
        if name == "n-gram Jaccard join":
            before = sorted(before)
            classes = [c for _, c in classes_by_hand([r["text"] for r in before])]
            assert {r["doc_id"] for r in rows} == {before[c]["doc_id"] for c in classes}
        if name == "personal data":
            from test_native import base_spans

            assert len(rows) == len(before) and not any(base_spans(r["text"]) for r in rows)
    pieces = after.collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
    assert max(r["offset"] + r["length"] for r in pieces) <= 2048


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
