"""Plans: no cartesian products, Python only where it is meant, and scans of the columns that are needed."""

import pytest

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries whose results depend on a whole row or group in order, or on matrix products.
PYTHON = {"chunk_adaptive", "code_graph", "def_use_edges", "www_mutations", "compact_session", "tool_compress", "pairwise_cosine", "vector_topk", "turn_graph", "assemble_turn", "tokens_saved", "text_topk"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert not any(k in text for k in ("Python", "Pandas", "InArrow"))


def test_scans_are_pruned(spark):
    text = plan(catalog.queries()["recent_history"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in text
    assert "EqualTo(event_type,error)" in text
