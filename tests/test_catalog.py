"""Catalog lookups, column search, constraints and job normalisation."""

from __future__ import annotations

import json

from tablewake.functions import names, paths
from tablewake.operators import catalog
from tablewake.schemas import INVENTORY
from tablewake.sources import inventory

ORDERS = (
    "sales", "orders",
    '{"Columns":[{"Name":"id","Type":"bigint"},{"Name":"Customer_ID","Type":"int","Comment":"who"}],"Location":"s3://lake/o"}',
    '[{"Name":"ds","Type":"string"}]',
)


def test_table_columns(make, rows):
    out = catalog.table_columns(make.tables(ORDERS, ("sales", "bare")))
    assert rows(out, "column_name", "column_type", "comment", "is_partition", "position", "location") == [
        ("Customer_ID", "int", "who", False, 1, "s3://lake/o"),
        ("ds", "string", None, True, 0, "s3://lake/o"),
        ("id", "bigint", None, False, 0, "s3://lake/o"),
    ]


def test_search(make, rows):
    tables = make.tables(ORDERS, ("sales", "bare"), ("crm", "people", None, '[{"Name":"DS_2"},{"Name":"ds"},{"Name":""}]'))
    assert rows(catalog.search_columns(tables, " ID ")) == [("sales", "orders", "Customer_ID, id")]
    assert rows(catalog.search_columns(tables, "ds")) == [("crm", "people", "DS_2, ds"), ("sales", "orders", "ds")]
    assert rows(catalog.search_columns(tables, "  ")) == []
    assert rows(catalog.search_columns(tables, "ds", limit=1)) == [("sales", "orders", "ds")]


def test_lookups(make, rows):
    tables = make.tables(ORDERS, ("crm", "people"))
    assert rows(catalog.get_table(tables, "sales", "orders"), "name") == [("orders",)]
    assert rows(catalog.get_table(tables, "crm", "orders")) == []
    databases = make.frame([("sales",), ("empty",)], "name string")
    assert rows(catalog.tables_by_database(databases, tables), "database_name", "tables") == [
        ("crm", "people"), ("empty", ""), ("sales", "orders"),
    ]


def test_readers_and_writers_match_by_name(make, rows):
    edges = make.edges(("j1", "read", "a", "t"), ("j2", "read", None, "t"), ("gone", "write", "a", "t"), ("j1", "write", "b", "t"))
    out = catalog.table_readers_writers(edges, make.jobs(("j1", "glue", "one"), ("j2", "lambda", "two")))
    assert rows(out, "table_name", "direction", "labels") == [
        ("t", "read", "glue: one, lambda: two"), ("t", "write", "glue: one"),
    ]


def test_self_join_edge_is_listed_once(make):
    joins = make.joins(("j", "a", "t", "x", "a", "t", "y"), ("j", "a", "t", "x", "a", "u", "y"))
    assert catalog.join_edges_of_tables(joins, make.foci(("a", "t"))).count() == 2


def test_constraints(make, rows):
    databases = make.frame([("a",), ("a",)], "name string")
    events = make.frame([(None, "DeleteTable"), ("e", None)], "event_id string, event_name string")
    extractions = make.frame([("j1",), ("j1",)], "job_id string")
    out = catalog.check_constraints(
        databases, make.tables(("b", "t"), ("b", "t")), make.jobs(("j1", "glue", "x")),
        make.edges(("nope", "read", "a", "t")), events, extractions,
    )
    assert rows(out) == [
        ("databases.unique", "a", 2), ("edges.job", "nope", 1), ("events.not_null", "event_id", 1),
        ("events.not_null", "event_name", 1), ("extractions.unique", "j1", 2), ("tables.database", "b", 1),
        ("tables.unique", "b.t", 2),
    ]


def test_constraints_of_joins_artifacts_and_the_log(make, rows):
    artifacts = make.frame([("j1", "a"), ("j1", "a"), ("gone", None)], "job_id string, reference string")
    log = make.frame([("e", "t"), ("e", "t"), ("e", "u")], "event_id string, table_name string")
    joins = "job_id string, left_table string, left_column string, right_table string, right_column string, evidence string"
    out = catalog.check_constraints(
        make.frame([("b",)], "name string"), make.tables(("b", "t")), make.jobs(("j1", "glue", "x")),
        make.edges(("j1", "read", "b", "t")), make.frame([("e", "x")], "event_id string, event_name string"),
        make.frame([("lost",)], "job_id string"), make.frame([("gone", "t", None, "u", "c", "x")], joins), artifacts, log,
    )
    assert rows(out) == [
        ("artifacts.job", "gone", 1), ("artifacts.not_null", "reference", 1), ("artifacts.unique", "j1: a", 2),
        ("extractions.job", "lost", 1), ("joins.job", "gone", 1), ("joins.not_null", "left_column", 1), ("log.unique", "e: t", 2),
    ]


def inventory_frame(spark, kind, *records):
    schema = spark.createDataFrame([], INVENTORY[kind]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in records], schema)


def test_jobs_and_artifacts(spark, rows):
    glue = inventory_frame(
        spark, "glue_jobs",
        {"name": "etl", "command": '{"ScriptLocation":"s3://c/etl.py","PythonVersion":"3"}', "max_capacity": 2.0,
         "default_arguments": '{"--extra-py-files":"s3://c/a.py, s3://c/etl.py ,,s3://c/b.zip"}'},
        {"name": "bare", "command": "", "default_arguments": "broken"},
    )
    functions = inventory_frame(spark, "lambda_functions", {"name": "fn", "arn": "arn:1", "runtime": "python3.12"}, {"name": "no_arn"})
    jobs = inventory.normalized_jobs(glue, functions)
    assert rows(jobs, "type", "name", "runtime") == [
        ("glue", "bare", None), ("glue", "etl", "3"), ("lambda", "fn", "python3.12"), ("lambda", "no_arn", None),
    ]
    document = json.loads(jobs.where("name = 'etl'").first().attributes)
    assert list(document) == list(inventory.JOB_ATTRIBUTES["glue"])
    assert document["command"] == {"ScriptLocation": "s3://c/etl.py", "PythonVersion": "3"}
    assert document["tags"] is None and document["max_capacity"] == 2.0
    assert rows(inventory.script_uris(glue), "name", "position", "uri") == [
        ("etl", 0, "s3://c/etl.py"), ("etl", 1, "s3://c/a.py"), ("etl", 2, "s3://c/etl.py"), ("etl", 3, "s3://c/b.zip"),
    ]
    assert rows(inventory.job_artifacts(glue, functions), "reference", "position") == [
        ("arn:1", 0), ("s3://c/a.py", 1), ("s3://c/b.zip", 3), ("s3://c/etl.py", 0),
    ]


def test_paths(make, rows):
    authored = ["a.py", "app/main.py", "app/lib/x.py", "x/python/y.py", "my_tests.py", "tests"]
    dropped = [
        ".env/a.py", "a/.b.py", "__pycache__/a.py", "x.dist-info/a.py", "a/x.egg-info/b.py", "a/site-packages/b.py",
        "bin/a.py", "lib/a.py", "lib64/a.py", "venv/a.py", "python/a.py", "a/test/b.py", "tests/a.py",
        "conftest.py", "test_a.py", "a/b_test.py", "q_test.sql",
    ]
    from pyspark.sql import functions as F

    df = make.frame([(p,) for p in authored + dropped], "path string")
    assert rows(df.where(paths.is_authored_path(F.col("path")))) == sorted((p,) for p in authored)


def test_uris_and_ignored_jobs(make, rows):
    from pyspark.sql import functions as F

    uris = make.frame([("s3://b/k/x.py",), ("s3://b/",), ("s3://b",), ("http://b/k",), ("s3:///k",)], "u string")
    out = uris.select(names.s3_bucket(F.col("u")), names.s3_key(F.col("u")))
    assert rows(out) == sorted([("b", "k/x.py")] + [(None, None)] * 4, key=repr)
    jobs = make.frame([("MyStack-LogRetention1",), ("etl",), (None,)], "name string")
    assert rows(jobs.where(paths.is_ignored_job(F.col("name")))) == [("MyStack-LogRetention1",)]
    assert jobs.where(paths.is_ignored_job(F.col("name"), "")).count() == 0
    assert rows(jobs.where(paths.is_ignored_job(F.col("name"), "tl$"))) == [("etl",)]


def test_script_uris_lose_white_space_of_any_kind(spark, rows):
    arguments = '{"--extra-py-files": " s3://b/x.py,\\\\n s3://b/y.py\\\\t,\\\\r\\\\n"}'.replace("\\\\", "\\")
    glue = spark.createDataFrame([("j", '{"ScriptLocation": "s3://b/main.py\\n"}', arguments)], "name string, command string, default_arguments string")
    assert rows(inventory.script_uris(glue), "position", "uri") == [(0, "s3://b/main.py"), (1, "s3://b/x.py"), (2, "s3://b/y.py")]


def test_constraints_read_each_child_table_once(make, rows, spark):
    scans = spark.sparkContext.accumulator(0)
    edges = make.edges(("j1", "read", "d", "a"), ("gone", "write", "d", "b"), ("gone", "write", "d", "c"))

    def seen(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    counted = edges.mapInArrow(seen, edges.schema)
    out = catalog.check_constraints(
        make.frame([("d",)], "name string"), make.tables(("d", "a")), make.jobs(("j1", "glue", "one")), counted,
        make.frame([("e", "n")], "event_id string, event_name string"),
        make.frame([("j1", "{}"), ("j1", None), (None, "{}"), ("gone", "{}")], "job_id string, extraction string"),
    )
    assert rows(out) == [
        ("edges.job", "gone", 1), ("extractions.job", "gone", 1), ("extractions.not_null", "extraction", 1),
        ("extractions.not_null", "job_id", 1), ("extractions.unique", "j1", 2),
    ]
    assert scans.value == 3
