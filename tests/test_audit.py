"""Deletion events: parsing, filters, grouping, text and the log."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewake.operators import audit
from tablewake.plans.audit_run import REPORT_ORDER, audit_run
from tablewake.schemas import AUDIT_LOG, INVENTORY
from tablewake.sources.snapshot import read_audit_log, write_audit_log

T1, T2 = datetime(2024, 5, 1, 10), datetime(2024, 5, 1, 12)


def event(event_id="e1", name="DeleteTable", source="glue.amazonaws.com", time=T1, user="ann",
          region="eu-west-1", payload=None, **parameters):
    text = payload if payload is not None else json.dumps({"requestParameters": parameters})
    return (event_id, name, source, time, user, region, text)


@pytest.fixture
def events(make):
    return lambda *rows: make.frame(rows, INVENTORY["events"])


def test_single_and_batch(events, rows):
    out = audit.parse_deletions(
        events(
            ("e1", "DeleteTable", "glue.amazonaws.com", T1, "ann", "r",
             '{"requestParameters":{"databaseName":"db","name":"t"}}'),
            ("e2", "BatchDeleteTable", "glue.amazonaws.com", T2, None, None,
             '{"requestParameters":{"databaseName":"db","tablesToDelete":["a","b",3,"",null]}}'),
            ("e3", "DeleteTable", "s3.amazonaws.com", T1, "ann", "r",
             '{"requestParameters":{"databaseName":"db","name":"t"}}'),
        )
    )
    assert rows(out, "event_id", "database_name", "table_name", "position") == [
        ("e1", "db", "t", 0), ("e2", "db", "a", 0), ("e2", "db", "b", 1),
    ]


@pytest.mark.parametrize(
    ("event_id", "payload", "reason"),
    [
        ("e", None, "malformed"), ("e", "", "malformed"), ("e", "not json", "malformed"),
        ("e", "[1]", "malformed"), ("e", '{"requestParameters":null}', "malformed"),
        ("e", '{"requestParameters":"text"}', "malformed"), (None, '{"requestParameters":{"name":"t"}}', "malformed"),
        ("", '{"requestParameters":{"name":"t"}}', "malformed"), ("e", '{"requestParameters":{}}', "no tables"),
        ("e", '{"requestParameters":{"name":7}}', "no tables"),
    ],
)
def test_malformed_events(events, event_id, payload, reason):
    df = events((event_id, "DeleteTable", "glue.amazonaws.com", T1, "ann", "r", payload))
    assert audit.parse_deletions(df).count() == 0
    assert [r.reason for r in audit.malformed_events(df).collect()] == [reason]


def test_list_that_is_a_string_is_not_read_by_character(events):
    df = events(("e", "BatchDeleteTable", "glue.amazonaws.com", T1, "a", "r", '{"requestParameters":{"tablesToDelete":"abc"}}'))
    assert audit.parse_deletions(df).count() == 0


def test_ignore_pattern(make, rows):
    df = make.foci(("db", "tmp_a"), ("edw", "keep"), (None, "edw.keep"), ("db", "t"))
    assert rows(audit.split_ignored(df, r"^tmp_|^edw\.keep$").where("ignored"), "table_name") == [
        ("edw.keep",), ("keep",), ("tmp_a",),
    ]
    assert audit.split_ignored(df, None).where("ignored").count() == 0
    assert audit.split_ignored(df, "").where("ignored").count() == 0


def batch(event_id, *tables, time=T1, user="ann", region="eu-west-1"):
    body = json.dumps({"requestParameters": {"databaseName": "db", "tablesToDelete": list(tables)}})
    return (event_id, "BatchDeleteTable", "glue.amazonaws.com", time, user, region, body)


def single(event_id, table, time=T1, user="ann", region="eu-west-1"):
    body = json.dumps({"requestParameters": {"databaseName": "db", "name": table}})
    return (event_id, "DeleteTable", "glue.amazonaws.com", time, user, region, body)


@pytest.fixture
def run(make, events):
    def go(*event_rows, log=(), **options):
        edges = make.edges(("j1", "read", "db", "used"), ("j1", "write", "db", "out"))
        return audit_run(
            events(*event_rows), make.frame([(e, *[None] * 8) for e in log], AUDIT_LOG),
            edges, make.joins(), make.jobs(("j1", "glue", "one")), make.tables(("db", "used")),
            **{"now": F.lit(T1 + timedelta(hours=24)), **options},
        )

    return go


def test_audit_run_text(run):
    out = run(
        single("e1", "used", T1), single("e2", "used", T2, user=None, region="us-east-1"),
        single("e3", "used", T2), batch("e4", "free", "tmp_x"), ignore_tables="^tmp_",
    )
    text = "\n".join(r.line for r in out.lines.orderBy(*REPORT_ORDER).collect())
    assert text.splitlines() == [
        "audit: 4 glue deletion(s) in the last 24h, 1 table(s) deleted with dependents",
        "",
        "DELETED WITH DEPENDENTS: db.used",
        "  3 deletion(s): DeleteTable by ann (2), DeleteTable by unknown (1)",
        "  when: 2024-05-01T10:00:00 to 2024-05-01T12:00:00 (eu-west-1, us-east-1)",
        "",
        "db.used has dependents:",
        "",
        "  jobs reading db.used (1):",
        "    - glue: one",
        "  tables written by those jobs (1):",
        "    - db.out",
        "",
        "NOT SAFE: deleting db.used breaks 1 job(s) and orphans 1 table(s)",
    ]
    assert out.totals.first().asDict() == {
        "deletions": 4, "flagged_tables": 1, "ignored_deletions": 1, "ignored_tables": 1,
    }


def test_audit_run_keeps_to_its_look_back_and_to_deletions(run, rows):
    old, other = single("e1", "used", T1 - timedelta(hours=1)), event("e2", "CreateTable")
    out = run(old, other, single("e3", "used", T2))
    assert rows(out.flagged, "event_id") == [("e3",)]
    assert out.totals.first().deletions == 1
    assert rows(run(old, hours=25).flagged, "event_id") == [("e1",)]
    assert rows(run(old, now=None).flagged, "event_id") == []


def test_clean_run(run):
    out = run(single("e1", "free"))
    lines = [r.line for r in out.lines.orderBy(*REPORT_ORDER).collect()]
    assert lines == [
        "audit: 1 glue deletion(s) in the last 24h, 0 table(s) deleted with dependents", "",
        "none had dependents",
    ]


def test_seen_events_are_reported_again_only_on_request(run, rows):
    events = [single("old", "used"), single("new", "used")]
    assert rows(run(*events, log=["old"]).flagged, "event_id") == [("new",)]
    again = run(*events, log=["old"], show_all=True)
    assert rows(again.flagged, "event_id") == [("new",), ("old",)]
    assert again.totals.first().deletions == 2
    assert rows(again.records, "event_id", "flagged") == [("new", True)]


def test_last_record_of_an_event_and_table_wins(make, events, run, rows):
    first = single("e1", "used", T1, user="first")
    second = single("e1", "used", T2, user="second")
    out = run(first, second, batch("e2", "used", "free"))
    assert rows(out.records, "event_id", "table_name", "username", "flagged") == [
        ("e1", "used", "second", True), ("e2", "free", "ann", False), ("e2", "used", "ann", True),
    ]


def test_log_refuses_duplicates_and_repeated_runs(spark, run, rows, tmp_path):
    path = str(tmp_path / "log")
    records = run(single("e1", "used"), batch("e2", "free", "used")).records
    write_audit_log(spark, path, records, "a")
    write_audit_log(spark, path, records, "a")
    write_audit_log(spark, path, records, "b")
    log = read_audit_log(spark, path)
    assert rows(log, "event_id", "table_name") == [("e1", "used"), ("e2", "free"), ("e2", "used")]
    assert log.where("reported_at IS NULL").count() == 0
    assert read_audit_log(spark, path, but_not="a").count() == 0


def test_look_back_is_inclusive(events):
    df = events(single("e1", "t", T1), batch("e2", "t", time=T2), event("e3", "CreateTable"))
    found = audit.deletions_since(df, F.lit(T1))
    assert sorted(r.event_id for r in found.collect()) == ["e1", "e2"]
    assert [r.event_id for r in audit.deletions_since(df, F.lit(T2)).collect()] == ["e2"]


def test_tables_are_tested_once_for_all_a_run_does(run, rows, monkeypatch):
    asked = []
    flag = audit.with_dependents_flag
    monkeypatch.setattr(audit, "with_dependents_flag", lambda *a: asked.append(1) or flag(*a))
    result = run(single("e1", "used"), single("e2", "nobody"))
    assert rows(result.records, "event_id", "flagged") == [("e1", True), ("e2", False)]
    assert result.totals.first()["flagged_tables"] == 1
    assert len(asked) == 1


def test_findings_are_numbered_in_order_and_bear_their_own_lines(run):
    other = '{"requestParameters":{"name":"used"}}'
    out = run(
        batch("b", "used", time=T1), ("s", "DeleteTable", "glue.amazonaws.com", T2, "ann", "r", other),
    )
    lines = out.lines.orderBy(*REPORT_ORDER).collect()
    assert out.lines.schema["finding_rank"].dataType.simpleString() == "bigint"
    assert [r.line for r in lines if r.line.startswith("DELETED")] == ["DELETED WITH DEPENDENTS: used", "DELETED WITH DEPENDENTS: db.used"]
    ranks = [r.finding_rank for r in lines]
    assert ranks == sorted(ranks) and len(set(ranks)) == 3
    assert [r.line for r in lines if r.line.startswith("    - ")] == ["    - glue: one", "    - db.out"] * 2
