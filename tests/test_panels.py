"""Panels: what a check reports, and that a panel is computed once for it."""

from __future__ import annotations

import pytest

from celstack.operators import compose
from celstack.plans import load

PANEL = "project_id bigint, position bigint, name string, visible boolean, opacity int, locked boolean"


def test_panel_check_finds_top_and_owner(spark):
    good = [(1, 1, "S", False, 255, True), (1, 2, "F: a", True, 255, False), (1, 3, "a", True, 255, False), (1, 4, "R", False, 255, False)]
    expected = spark.createDataFrame(good + [(2, *r[1:]) for r in good[:3]] + [(3, *r[1:]) for r in good] + [(4, *r[1:]) for r in good], PANEL)
    read = [r + ("norm",) for r in good] + [(2, *r[1:], "norm") for r in good[:3]] + [(3, *r[1:], "norm") for r in good if r[1] != 3]
    actual = spark.createDataFrame(read + [(4, *good[0][1:], "norm"), (4, 2, "a", True, 255, False, "norm")], PANEL + ", blend string")
    found = compose.panel_check(expected, actual, "S", "F: ", "R").collect()
    assert sorted((r["project_id"], r["position"], r["reason"]) for r in found) == [
        (2, 3, "READ_ME_NOT_LAST"), (3, 2, "FILL_NOT_UNDER_OWNER"), (3, 3, "LAYER_COUNT"),
        (4, 2, "ORDER"), (4, 3, "LAYER_COUNT"), (4, 4, "LAYER_COUNT")]


def test_panel_check_ranks_a_panel_once(spark):
    plan = load()["panel_check"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 0  # the ranked panel is a table that is read again


@pytest.mark.parametrize("name", ["panel_projection", "cross_kind_collisions", "registry_ref_resolves"])
def test_tasks_read_at_most_16_mb(spark, name):
    load()[name].run(spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
