"""The driver contract, with and without the optional subpackage; plans of the main workload."""

import importlib
import re
import sys

from sweepframe import registry
from sweepframe.plans import workflows
from sweepframe.sources import derived

SF = "/root/testdata/sf0.001"


def test_entry_without_the_corpus_operators(monkeypatch):
    import __spark_entry__

    for name in ("sweepframe.llm", "sweepframe.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    bare = importlib.reload(__spark_entry__)
    assert set(bare.queries()) == set(registry.queries()) and set(bare.oracle_sql()) <= set(bare.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_brings_a_frame_together(spark):
    plan = plan_of(workflows.targets(derived.complex_cube(spark, SF), derived.RADAR, 16, 32, 1, 1, 1.5))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # frames of range spectra, then the few detected cells by cluster
    assert [len(re.findall("#", k)) for k in keys] == [3, 2]
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(derived.grid(spark, SF))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan
