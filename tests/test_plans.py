"""Plans: filters and columns reach the files, and no join degrades to a nested loop."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewake.operators import audit, diagram
from tablewake.operators import dependents as dep
from tablewake.operators.closure import edge_sides, job_visits, readers, walk
from tablewake.schemas import INVENTORY
from tablewake.sources.events import scan_events
from tablewake.sources.scratch import SETTING, scratch_root


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_event_filters_and_columns_reach_the_files(spark, make, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    path = str(tmp_path / "events")
    make.frame([("e1", "DeleteTable", "glue.amazonaws.com", datetime(2024, 5, 1), "ann", "r", "{}")], INVENTORY["events"]).write.parquet(path)
    found = audit.since(scan_events(spark, path), "DeleteTable", F.lit(datetime(2024, 1, 1)))
    text = plan(found.select("event_id"))
    assert "EqualTo(event_name,DeleteTable)" in text
    assert "GreaterThanOrEqual(event_time" in text
    assert "ReadSchema: struct<event_id:string,event_name:string,event_time:timestamp>" in text


def test_no_nested_loop_joins(make, no_broadcast):
    edges = make.edges(("j1", "read", None, "a"), ("j1", "write", "d", "b"), ("j2", "read", "d", "b"))
    joins = make.joins(("j2", "d", "a", "x", "d", "e", "y"))
    foci, tables, jobs = make.foci(("d", "a"), (None, "e")), make.tables(("d", "a")), make.jobs(("j1", "glue", "one"))
    sides = edge_sides(edges)
    result = walk(sides, foci)
    dag = diagram.lineage_dag(edges, foci)
    frames = {
        "readers": readers(result.placed, sides),
        "visits": job_visits(result),
        "flags": dep.with_dependents_flag(foci, edges, joins),
        "items": dep.report_items(result, joins, jobs, tables),
        "radius": dep.blast_radius(result, joins),
        "layers": dep.lineage_layers(result, tables),
        "arrows": diagram.dag_arrows(dag, jobs, tables),
        "erd": diagram.erd_arrows(foci, joins, jobs, tables),
    }
    for name, df in frames.items():
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_scratch_tables_live_in_the_configured_folder(spark):
    assert scratch_root(spark).startswith(spark.conf.get(SETTING) + "/")
