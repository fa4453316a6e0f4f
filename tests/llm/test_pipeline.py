"""The pipeline stage by stage on the smallest tables, and what it rests on."""

import re

import pytest
from brute import DOCUMENT, components

import __spark_entry__ as entry
import corpus_pipeline
from passbook.llm import queries
from passbook.llm.common import materialise

FOLDER = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES} == set(range(1, 14))
    assert queries.QUERIES.keys() <= entry.queries().keys() and "pipeline" in entry.queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER), "stage")
        kept.append((name, docs))
        if name != "packing":
            assert docs.columns == columns
    by = dict(kept)
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in by["exact dedup"].collect()]
    assert len(texts) == len(set(texts)) < by["toxicity"].count()
    want = {c for _, _, c, _ in components([(r.doc_id, r.text) for r in by["exact dedup"].collect()])}
    assert {r.doc_id for r in by["near duplicates"].collect()} == want
    assert by["secret scan"].count() == len(want)
    assert {r.doc_id for r in by["packing"].collect()} == want


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_without_rows(spark, stage):
    docs = spark.createDataFrame([], DOCUMENT)
    assert stage(spark, docs, FOLDER).count() == 0


def test_exact_stage_keeps_null_ids(spark):
    rows = [(1, "a  b"), (1, "a b"), (2, "a b"), (None, "c"), (None, "c"), (None, "a b"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENT)
    found = sorted(((r.doc_id, r.text) for r in corpus_pipeline.exact_stage(spark, docs, FOLDER).collect()), key=str)
    assert [(i, t.split() if t else t) for i, t in found] == sorted([(1, ["a", "b"]), (3, None), (None, ["c"])], key=str)
