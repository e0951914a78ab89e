"""Every query of the subpackage against its SQL, and the pipeline against the operators' brute force."""

import pytest
from compare import connect, differences
from test_dedup import brute_components
from test_hashing import plain_shingles
from test_passages import brute

import corpus_pipeline
from outletry.llm.queries import LLM_ORACLES, LLM_QUERIES

NATIVE = ("op2_line_rules", "op4_url_rules", "op10_licences")


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(spark, connect(sf_dir), name, sf_dir) == []


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, sf_dir, name):
    plan = LLM_QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    steps = []
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = corpus_pipeline.stage(docs, name)
            steps.append({r["doc_id"]: r for r in docs.collect()})
    known, unique, cut, clean = steps
    assert set(known) == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
    top = brute_components([(i, set(plain_shingles(r["text"]))) for i, r in sorted(known.items())], 80)
    assert set(unique) == {i for i in known if top[i] == i}
    assert set(cut) == set(unique)
    assert set(clean) == {i for i, r in cut.items() if not brute(r["text"], items)[1]}
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(clean)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
