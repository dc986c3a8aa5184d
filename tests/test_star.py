"""Partitions of the star join follow its rows."""

from __future__ import annotations

import re

from lakeloom.plans import star
from tests import test_oracle


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(star, "TASK_ROWS", 1000, raising=False)
    plan = star.star_revenue(spark, test_oracle.SF)._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet(f"{test_oracle.SF}/lineitem.parquet").count() // 1000)
    dealt = re.findall(r"hashpartitioning\((\w+)#\w+, (\d+)\)", plan)
    # Both sides of all three joins of tables that grow, and none of them is broadcast.
    assert {k for k, _ in dealt} >= {"l_orderkey", "o_orderkey", "l_partkey", "p_partkey", "o_custkey", "c_custkey"}
    assert {int(m) for _, m in dealt} == {n} and n > 8
    assert plan.count("BroadcastHashJoin") <= 2
    # Distinct orders are counted where the join leaves them: orders are in no later shuffle.
    assert not re.search(r"hashpartitioning\([^)]*p_type[^)]*o_orderkey", plan)
    test_oracle.same_rows(spark, "star_revenue")
