"""Views that group a large table: tasks of a bounded number of rows, one shuffle, the same rows."""

import pytest

from panelspark import shipping
from panelspark.plans import registry, testbed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", ["daily", "hourly"])
def test_groups_are_dealt_by_their_number(spark, monkeypatch, view):
    want = getattr(testbed.Testbed(spark, SF), view)
    monkeypatch.setattr(shipping, "ROWS", 50)
    found = getattr(testbed.Testbed(spark, SF), view)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = {"daily": testbed.Testbed(spark, SF).lineitem, "hourly": testbed.Testbed(spark, SF).events}[view].count()
    assert found.rdd.getNumPartitions() == -(-rows // 50) > 8 >= want.rdd.getNumPartitions()
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0


def test_a_query_over_a_dealt_view(spark, monkeypatch):
    want = sorted(registry.QUERIES["O_A15_entity_summary"](spark, SF).collect())
    monkeypatch.setattr(shipping, "ROWS", 50)
    assert sorted(registry.QUERIES["O_A15_entity_summary"](spark, SF).collect()) == want and want
