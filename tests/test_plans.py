"""Plans of the graph queries: the normalization is stored once and not copied into every view."""

import os
import re

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("name", "most"), [("lineage", 8), ("concept_nodes", 12), ("filter_concepts", 16), ("graph_stats", 12), ("score_groups", 8), ("audit", 20)])
def test_scans(spark, name, most):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < len(re.findall(r"\bRelation \[", plan)) <= most
