"""Every registered query on scale 0.01: against its SQL where there is one, else for its rows and columns."""
from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from noisefleet.llm import registry
from tools.compare import check, connect

SF = "/root/testdata/sf0.01"
WITHOUT_SQL = {"op1_quality_trees", "op3_line_dedup", "op5_onebit_search", "op6_boilerplate_crf", "op8_golay_simhash", "op9_merge_dropout"}


def test_all_ten_are_registered():
    names = registry.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(names) - set(registry.oracles()) == WITHOUT_SQL
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries()) and set(registry.oracles()) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    ok, line = check(spark, connect(SF), SF, name, registry.queries()[name], registry.oracles().get(name))
    assert ok, line


@pytest.mark.parametrize("name", ["op2_license_scan", "op4_mixing", "op7_chat_format"])
def test_native_plans_hold_no_python(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.dtypes == before.dtypes
        if name == "quality_trees":
            assert len(good & {r.doc_id for r in docs.collect()}) > 0.98 * len(good)
        if name == "line_dedup":
            assert counts[-1] == counts[-2]
    assert docs.where("not lossless").count() == 0 and counts[0] > counts[1] >= counts[2] > counts[3]
