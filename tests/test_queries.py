"""Every registered query: a lint of its physical plan and, where it has one, its SQL twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from celstack.plans import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = load()
# Queries with no SQL twin; each is checked against a second implementation in another test module.
WITHOUT_SQL = {"components4_by_group", "nearest_fill", "layer_textures", "warp_rasters", "pose_coverage"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_listed_queries_lack_sql():
    assert {n for n, q in REGISTRY.items() if q.sql is None} == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    df = REGISTRY[name].run(spark, SF)
    plan = plan_of(df)
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert forbidden not in plan
    if REGISTRY[name].sql is None:
        assert df.count() > 0
        return
    result = con.execute(REGISTRY[name].oracle())
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(names, result.fetchall())


def test_scan_reads_only_needed_columns(spark):
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan_of(REGISTRY["mask_count_above"].run(spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan_of(REGISTRY["draw_order_clashes"].run(spark, SF))


def test_filters_reach_the_scan(spark):
    assert "LessThan(l_quantity,46.0)" in plan_of(REGISTRY["inventory_reconcile"].run(spark, SF))


def test_first_samples_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(REGISTRY["calibrate_sessions"].run(spark, SF))


@pytest.mark.parametrize("name", ["colour_error", "preserve_source", "union_histogram", "generated_exposure"])
def test_exploded_sides_are_not_broadcast_by_estimate(spark, name):
    assert "BroadcastExchange" not in plan_of(REGISTRY[name].run(spark, SF))


@pytest.mark.parametrize("name", ["bundle_verify", "frame_sequence", "frames_vs_report", "neutral_frames_agree"])
def test_small_key_tables_are_dealt_out_before_they_are_exploded(spark, name):
    assert "REPARTITION_BY_NUM" in plan_of(REGISTRY[name].run(spark, SF))
