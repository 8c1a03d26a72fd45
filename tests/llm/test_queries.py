"""Registered queries against their SQL, and the pipeline's contract."""

import os
import sys

import pytest
from helpers import empty, odd_documents

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
import check  # noqa: E402

import corpus_pipeline  # noqa: E402
from clipweave.llm import jaccard_join  # noqa: E402
from clipweave.llm.common import kept  # noqa: E402
from clipweave.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    ok, why, _ = check.compare(spark, check.duck(SF), SF, QUERIES[name], ORACLES[name])
    assert ok, why


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert 0 < out.count() <= n, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema == docs.schema, name
            assert out.exceptAll(docs).count() == 0, name
            docs, n = kept(out), out.count()


def test_pipeline_runs_are_equal(spark):
    a, b = ({tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("make", [odd_documents, empty])
def test_stages_on_odd_documents(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count(), name


def test_keys_that_collide_are_hashed_anew(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b c d e f") for i in range(20)], "doc_id long, text string")
    calls = []

    def once(docs, seed, form=jaccard_join.first_pass):
        calls.append(seed)
        out = form(docs, seed)
        return out.selectExpr("doc_id", "n", "if(slice is null, 5, x) as x", "y", "slice", "counts") if seed == 0 else out

    monkeypatch.setattr(jaccard_join, "first_pass", once)
    assert jaccard_join.join(docs).select("component_id").distinct().count() == 20 and calls == [0, 1]
