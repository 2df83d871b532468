"""Every registered plan runs on the smallest scale; Catalyst-only plans have
no Python evaluation nodes."""

import pytest

from promptspark.plans import oracle_sql, queries
from conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(queries()))
def test_plan_runs(spark, name):
    df = queries()[name](spark, SF_SMALL)
    df.limit(5).collect()
    if not name.startswith(("stream_", "op", "pipeline")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_oracles_are_for_registered_plans():
    assert set(oracle_sql()) <= set(queries())
