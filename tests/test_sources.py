"""Scripts and packages read from files, and the streaming audit."""

from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewake.plans.audit_run import REPORT_ORDER
from tablewake.plans.registry import _all_tables
from tablewake.schemas import CATALOG, INVENTORY
from tablewake.sources import code, snapshot
from tablewake.sources.inventory import scan_inventory
from tablewake.streaming import deletions as stream


def test_scripts_from_landed_objects(spark, make, rows, tmp_path):
    bucket = tmp_path / "objects" / "bucket" / "jobs"
    bucket.mkdir(parents=True)
    (bucket / "etl.py").write_bytes(b"good \xff\xfe bad")
    (bucket / "lib.zip").write_bytes(b"zip")
    root = str(tmp_path / "objects")
    jobs = make.frame(
        [
            ("etl", '{"ScriptLocation":"s3://bucket/jobs/etl.py"}', '{"--extra-py-files":"s3://bucket/jobs/lib.zip,s3://bucket/gone.py,broken.py"}'),
            ("none", None, None),
        ],
        "name string, command string, default_arguments string",
    )
    files = code.script_files(jobs, code.scan_objects(spark, root), root)
    expected = b"good \xff\xfe bad".decode("utf-8", "replace")
    assert rows(files, "path", "contents") == [("s3://bucket/jobs/etl.py", expected)]
    assert rows(code.bad_uris(jobs), "uri") == [("broken.py",)]


def package(members: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return data.getvalue()


def test_packages(make, rows):
    zipped = package(
        {
            "app/": "", "main.py": "print(1)", "q.sql": "SELECT 1", "notes.txt": "no", "tests/t.py": "no",
            "six.py": "dep", "six-1.dist-info/RECORD": "six.py,sha256=x,3\n", "vend/lib.py": "dep", "vend/own.py": "own",
            "vend/lib-2.dist-info/RECORD": "lib.py,,\r\n  \n",
        }
    )
    packages = make.frame(
        [("fn", "Zip", bytearray(zipped)), ("img", "Image", bytearray(b"not a zip")), ("odd", None, None)],
        "name string, package_type string, content binary",
    )
    files = code.authored_members(code.package_members(packages))
    assert rows(files, "name", "path", "contents") == [
        ("fn", "main.py", "print(1)"), ("fn", "q.sql", "SELECT 1"), ("fn", "vend/own.py", "own"),
    ]
    assert code.source_files({"lambda": (packages,)}).count() == 3


def test_broken_packages_are_rejected(make, rows):
    good = package({"main.py": "print(1)", "q.sql": "SELECT 1"})
    damaged = bytearray(good)
    damaged[damaged.index(b"print(1)")] ^= 1  # the checksum no longer fits
    packages = make.frame(
        [("ok", "Zip", bytearray(good)), ("bad", "Zip", bytearray(b"no zip")), ("none", "Zip", None), ("part", "Zip", damaged)],
        "name string, package_type string, content binary",
    )
    members = [("ok", "main.py"), ("ok", "q.sql"), ("part", "q.sql")]
    assert rows(code.package_members(packages), "name", "path") == members
    assert rows(code.package_rejects(packages), "name", "path") == [("bad", None), ("none", None), ("part", "main.py")]


def test_package_claims_stay_inside_the_package(make, rows):
    one = package({"six.py": "dep", "six-1.dist-info/RECORD": "six.py,,\n"})
    two = package({"six.py": "mine"})
    packages = make.frame([("a", "Zip", bytearray(one)), ("b", "Zip", bytearray(two))], "name string, package_type string, content binary")
    assert rows(code.authored_members(code.package_members(packages)), "name", "path") == [("b", "six.py")]


def test_inventory_scan(spark, make, tmp_path):
    landing = str(tmp_path)
    for kind in ("databases", "tables", "glue_jobs", "lambda_functions"):
        make.frame([("x",)], "name string").write.json(f"{landing}/{kind}")
    found = scan_inventory(spark, landing, "json")
    assert {k: len(v.columns) for k, v in found.items()} == {
        "databases": 6, "tables": 22, "glue_jobs": 24, "lambda_functions": 32,
    }


def test_failed_snapshot_leaves_the_old_one_current(spark, make, tmp_path):
    root = str(tmp_path)
    snapshot.write_snapshot(spark, root, _all_tables({"jobs": make.jobs(("j1", "glue", "one"))}))
    broken = _all_tables({"jobs": make.jobs(("j2", "glue", "two"))})
    broken["table_join_edges"] = make.joins().select(F.raise_error(F.lit("lost")).alias("job_id")).unionByName(
        spark.range(1).select(F.raise_error(F.lit("lost")).alias("job_id"))
    )
    try:
        snapshot.write_snapshot(spark, root, broken)
        raise AssertionError("the write should have failed")
    except Exception as error:
        assert "lost" in str(error)
    assert [r.id for r in snapshot.read_snapshot(spark, root)["jobs"].collect()] == ["j1"]


def event(event_id, table, hour):
    body = json.dumps({"requestParameters": {"databaseName": "a", "name": table}})
    return (event_id, "DeleteTable", "glue.amazonaws.com", datetime(2024, 5, 1, hour), "ann", "r", body)


def test_stream_dedup(spark, make, rows, tmp_path):
    landed, out = str(tmp_path / "events"), str(tmp_path / "out")
    make.frame([event("e1", "t", 1), event("e1", "t", 2), event("e2", "t", 3)], INVENTORY["events"]).write.parquet(landed)
    deletions = stream.stream_deletions(stream.read_event_stream(spark, landed))

    def run():
        query = stream.stream_dedup(deletions).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s"))
        query.option("path", out).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(out), "event_id", "table_name")

    assert run() == [("e1", "t"), ("e2", "t")]
    make.frame([event("e2", "t", 4), event("e3", "t", 5)], INVENTORY["events"]).write.mode("append").parquet(landed)
    assert run() == [("e1", "t"), ("e2", "t"), ("e3", "t")]


def test_stream_audit_reports_each_event_once(spark, make, rows, tmp_path):
    root, log, reports, landed = (str(tmp_path / n) for n in ("catalog", "log", "reports", "events"))
    tables = _all_tables({"job_table_edges": make.edges(("j1", "read", "a", "used"))})
    snapshot.write_snapshot(spark, root, tables)
    state = str(tmp_path / "state")

    def run():
        events = stream.read_event_stream(spark, landed)
        stream.stream_audit(events, root, log, reports, state).awaitTermination()
        return rows(snapshot.read_audit_log(spark, log), "event_id", "table_name", "flagged")

    make.frame([event("e1", "used", 1), event("e2", "free", 2)], INVENTORY["events"]).write.parquet(landed)
    first = [("e1", "used", True), ("e2", "free", False)]
    assert run() == first
    make.frame([event("e1", "used", 1), event("e3", "used", 3)], INVENTORY["events"]).write.mode("append").parquet(landed)
    assert run() == [*first, ("e3", "used", True)]
    text = [r.value for r in spark.read.text(f"{reports}/batch=1").collect()]
    assert text[0] == "audit: 1 glue deletion(s) in the last 24h, 1 table(s) deleted with dependents"

    # The same batch again, as after a failure between log and commit: nothing changes.
    again = make.frame([event("e1", "used", 1), event("e3", "used", 3)], INVENTORY["events"])
    stream.audit_batch(spark, again, root, log, reports, 1)
    assert rows(snapshot.read_audit_log(spark, log), "event_id", "table_name", "flagged") == [*first, ("e3", "used", True)]
    assert [r.value for r in spark.read.text(f"{reports}/batch=1").collect()] == text
    assert REPORT_ORDER[0] == "finding_rank"


def test_a_snapshot_completed_meanwhile_is_not_overwritten(spark, make, tmp_path):
    root = str(tmp_path / "catalog")
    empty = {t: spark.createDataFrame([], ddl) for t, ddl in CATALOG.items()}

    def tables(name):
        row = {f.name: None for f in empty["databases"].schema.fields} | {"id": "i", "name": name}
        return {**empty, "databases": spark.createDataFrame([row], empty["databases"].schema)}

    names = lambda: [r.name for r in snapshot.read_snapshot(spark, root)["databases"].collect()]
    snapshot.write_snapshot(spark, root, tables("first"))
    original = snapshot._current
    calls = []

    def other_writer(session, path):
        calls.append(path)
        if len(calls) == 2:  # just before the slow writer marks itself
            snapshot._current = original
            snapshot.write_snapshot(session, path, tables("other"))
        return original(session, path)

    snapshot._current = other_writer
    try:
        with pytest.raises(snapshot.SnapshotTaken):
            snapshot.write_snapshot(spark, root, tables("slow"))
    finally:
        snapshot._current = original
    assert names() == ["other"] and snapshot.current_snapshot(spark, root) == 1
    assert snapshot.write_snapshot(spark, root, tables("next")) == 2 and names() == ["next"]


def test_written_tables_leave_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from tablewake.sources.scratch import CLEANUP, cut

    before = spark.conf.get(CLEANUP, None)
    tracked = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    spark.range(1000).groupBy(F.col("id") % 7).count().write.format("noop").mode("overwrite").save()
    n = tracked()
    assert cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert tracked() <= n + 1  # that of the count alone
    assert spark.conf.get(CLEANUP, None) == before


def test_views_are_made_from_written_ones(spark, tmp_path):
    from tablewake.plans.views import view

    rows = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame([(1, 5, 1, k, 1.0) for k in (2, 3, 5)], rows).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = view(spark, str(tmp_path), "lk_edges")
    plain, few = (view(spark, str(tmp_path), "lk_join_edges", **own) for own in ({}, {"lk_edges": edges.where("false")}))
    assert plain.where("evidence <> 'df merge'").count() == 0 and few.count() == 3


def test_a_batch_deals_out_its_events_and_writes_no_stored_edges_again(spark, make, tmp_path, monkeypatch):
    from tablewake.plans import audit_run

    written, plain = [], audit_run.cut
    monkeypatch.setattr(audit_run, "cut", lambda df: written.append(df) or plain(df))
    root = str(tmp_path / "catalog")
    snapshot.write_snapshot(spark, root, _all_tables({"job_table_edges": make.edges(("j1", "read", "a", "used"))}))
    events = make.frame([event(f"e{k}", "used", k) for k in range(8)], INVENTORY["events"]).coalesce(1)
    stream.audit_batch(spark, events, root, str(tmp_path / "log"), str(tmp_path / "reports"), 1)
    assert not any("direction" in df.columns or "left_table" in df.columns for df in written)
    dealt = next(df for df in written if "cloud_trail_event" in df.columns)
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert snapshot.read_audit_log(spark, str(tmp_path / "log")).count() == 8
