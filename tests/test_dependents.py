"""Dependents of a table: small graphs with exact results."""

from __future__ import annotations

import pytest

from tablewake.operators import dependents as dep
from tablewake.operators.closure import job_visits, walk
from tablewake.operators.masks import by_focus, count_bits, named, named_foci
from tablewake.plans.check_delete import dependents_reports

FOCUS = ("sales", "orders")


@pytest.fixture
def report(make):
    """Sections, lines and layers of the report of one focus."""

    def build(edges=(), joins=(), jobs=(), tables=(), focus=FOCUS):
        reports = dependents_reports(
            make.foci(focus), make.edges(*edges), make.joins(*joins), make.jobs(*jobs), make.tables(*tables)
        )
        sections: dict[str, list] = {}
        for r in reports.items.collect():
            value = r.label if r.section.endswith("jobs") else (r.database_name, r.table_name)
            if r.section == "join_refs":
                value = (r.label, r.database_name, r.table_name)
            sections.setdefault(r.section, []).append(value)
        layers: dict[int, list] = {}
        for r in reports.layers.orderBy("layer", "sort_database", "table_name").collect():
            layers.setdefault(r.layer, []).append(r.table_key)
        ordered = reports.lines.orderBy("section", "rank_a", "rank_b").collect()
        return {
            "sections": {k: sorted(v, key=repr) for k, v in sections.items()},
            "layers": [layers[k] for k in sorted(layers)],
            "text": "\n".join(r.line for r in ordered),
            "summary": reports.summary.first(),
        }

    return build


def test_reader_and_written_table(report):
    out = report(
        edges=[
            ("j1", "read", "sales", "orders"), ("j1", "write", "analytics", "summary"),
            ("j0", "write", "sales", "orders"), ("j0", "read", "raw", "feed"),
        ],
        jobs=[("j1", "glue", "sum"), ("j0", "glue", "load")],
    )
    assert out["sections"] == {"direct_jobs": ["glue: sum"], "direct_tables": [("analytics", "summary")]}
    assert out["layers"] == [["analytics.summary"]]


def test_second_hop_is_transitive(report):
    out = report(
        edges=[
            ("j1", "read", "sales", "orders"), ("j1", "write", "a", "mid"),
            ("j2", "read", "a", "mid"), ("j2", "write", "a", "end"),
        ]
    )
    assert out["sections"] == {
        "direct_jobs": ["j1"], "direct_tables": [("a", "mid")],
        "transitive_jobs": ["j2"], "transitive_tables": [("a", "end")],
    }
    assert out["layers"] == [["a.mid"], ["a.end"]]


def test_join_reference_alone_is_a_dependent(report):
    out = report(
        joins=[("j1", "sales", "orders", "id", None, "people", "id")],
        jobs=[("j1", "lambda", "match")], tables=[("crm", "people")],
    )
    assert out["sections"] == {"join_refs": [("lambda: match", "crm", "people")]}
    assert out["summary"].has_dependents


def test_self_join_is_skipped(report):
    out = report(joins=[("j1", "sales", "orders", "id", "sales", "orders", "parent")])
    assert out["sections"] == {}
    assert out["text"] == "sales.orders has no dependents"


def test_cycle_ends_and_focus_is_not_listed(report):
    out = report(
        edges=[
            ("j1", "read", "sales", "orders"), ("j1", "write", "a", "mid"),
            ("j2", "read", "a", "mid"), ("j2", "write", "sales", "orders"),
        ]
    )
    assert out["sections"] == {
        "direct_jobs": ["j1"], "direct_tables": [("a", "mid")], "transitive_jobs": ["j2"],
    }


def test_job_reading_and_writing_the_focus(report):
    out = report(edges=[("j1", "read", "sales", "orders"), ("j1", "write", "sales", "orders")])
    assert out["sections"] == {"direct_jobs": ["j1"]}
    assert out["layers"] == []


def test_unknown_database_filled_from_single_catalog_match(report):
    edges = [("j1", "read", "sales", "orders"), ("j1", "write", None, "out")]
    one = report(edges=edges, tables=[("x", "out")])
    two = report(edges=edges, tables=[("x", "out"), ("y", "out")])
    assert one["sections"]["direct_tables"] == [("x", "out")]
    assert one["layers"] == [["x.out"]]
    assert two["sections"]["direct_tables"] == [(None, "out")]
    assert two["layers"] == [["out"]]


def test_same_name_in_other_database_is_no_dependent(report):
    out = report(
        edges=[("j1", "read", "other", "orders")],
        joins=[("j2", "other", "orders", "id", "x", "people", "id")],
    )
    assert out["sections"] == {}


def test_unknown_database_matches_any(report):
    out = report(edges=[("j1", "read", None, "orders")])
    assert out["sections"] == {"direct_jobs": ["j1"]}
    anywhere = report(edges=[("j1", "read", "b", "orders")], focus=("", "orders"))
    assert anywhere["sections"] == {"direct_jobs": ["j1"]}


def test_join_to_same_name_in_other_database_is_kept(report):
    out = report(joins=[("j1", "sales", "orders", "id", "old", "orders", "id")])
    assert out["sections"] == {"join_refs": [("j1", "old", "orders")]}


def test_concrete_databases_win_over_unknown_in_one_hop(report):
    out = report(
        edges=[
            ("j1", "read", "sales", "orders"), ("j1", "write", None, "t"),
            ("j1", "write", "a", "t"), ("j1", "write", "b", "t"),
        ]
    )
    assert out["sections"]["direct_tables"] == [("a", "t"), ("b", "t")]


def test_wildcard_match_is_not_transitive(report):
    """(null, t) placed first blocks later concrete keys; the walk goes on from (null, t)."""
    out = report(
        edges=[
            ("j1", "read", "sales", "orders"), ("j1", "write", None, "t"),
            ("j2", "read", "b", "t"), ("j2", "write", "a", "t"), ("j2", "write", "a", "end"),
        ]
    )
    assert out["layers"] == [["t"], ["a.end"]]


def test_report_text(report):
    out = report(
        edges=[
            ("j1", "read", "sales", "orders"), ("j1", "write", "a", "mid"),
            ("j2", "read", "a", "mid"), ("j2", "write", "a", "end"),
        ],
        joins=[
            ("j3", "sales", "orders", "id", "crm", "people", "id"),
            ("j3", "crm", "people", "key", "sales", "orders", "key"),
        ],
        jobs=[("j1", "glue", "one"), ("j2", "glue", "two"), ("j3", "lambda", "three")],
    )
    assert out["text"].splitlines() == [
        "sales.orders has dependents:",
        "",
        "  jobs reading sales.orders (1):",
        "    - glue: one",
        "  tables written by those jobs (1):",
        "    - a.mid",
        "  join references (1):",
        "    - lambda: three joins sales.orders <-> crm.people",
        "  transitive blast radius: 1 more table(s), 1 more job(s)",
        "    - a.end",
        "",
        "NOT SAFE: deleting sales.orders breaks 3 job(s) and orphans 2 table(s)",
    ]
    assert out["summary"].n_join_refs == 2
    assert not out["summary"].in_catalog


def test_blast_radius_counts_each_job_once(make):
    edges = make.edges(
        ("j1", "read", "sales", "orders"), ("j1", "write", "a", "mid"), ("j2", "read", "a", "mid")
    )
    joins = make.joins(
        ("j1", "sales", "orders", "id", "x", "y", "id"), ("j9", "sales", "orders", "id", "x", "y", "id")
    )
    out = dep.blast_radius(walk(edges, make.foci(FOCUS, ("x", "none"))), joins)
    assert {(r.focus_table, r.jobs_broken, r.tables_orphaned) for r in out.collect()} == {
        ("orders", 3, 1), ("none", 0, 0),
    }


def test_verdicts_agree_with_direct_readers(make, rows):
    edges = make.edges(("j1", "read", None, "a"), ("j1", "write", "d", "b"))
    joins = make.joins(("j2", "d", "c", "x", "d", "e", "y"))
    foci = make.foci(("d", "a"), ("d", "b"), ("d", "c"), ("z", "e"), (None, "e"))
    verdicts = dep.delete_verdicts(foci, edges, joins)
    assert rows(verdicts, "database_name", "table_name", "safe") == sorted(
        [("d", "a", False), ("d", "b", True), ("d", "c", False), ("z", "e", True), (None, "e", False)],
        key=repr,
    )
    assert rows(dep.direct_readers(edges, foci)) == [("d", "a", "j1")]


def test_hot_names_of_join_references_are_salted_without_a_change(make, rows):
    joins = make.joins(
        *[(f"j{i}", "d", "hub", "id", None if i % 3 else "d", f"t{i % 5}", "id") for i in range(60)],
        ("self", "d", "hub", "a", None, "hub", "b"), ("back", "x", "t1", "id", "d", "hub", "id"), ("null", "d", "hub", "id", "d", None, "id"),
    )
    foci = make.foci(("d", "hub"), (None, "t1"), ("d", "t2"), ("d", "none"))
    plain = rows(dep.join_refs(joins, foci))
    assert rows(dep.join_refs(joins, foci, rows_per_salt=7)) == plain
    assert ("d", "hub", "back", "x", "t1", "t1 = hub") in plain and not any(r[2] in ("self", "null") for r in plain)


def test_labels_and_databases_are_joined_before_a_row_per_focus_is_made(make, rows):
    edges = make.edges(("j1", "read", "d", "a"), ("j1", "write", None, "b"), ("j2", "read", None, "b"), ("j2", "write", None, "c"))
    foci = make.foci(("d", "a"), (None, "a"), ("d", "b"), (None, "c"))
    result = walk(edges, foci)
    visits = job_visits(result)
    assert rows(named(visits.drop("hop"), result.foci)) == rows(named_foci(by_focus(visits.drop("hop")), result.foci))
    plan = dep.report_items(result, make.joins(), make.jobs(("j1", "glue", "n")), make.tables(("d", "b")))
    joined = plan._jdf.queryExecution().optimizedPlan().toString()
    first_rows = joined.index("Generate explode")  # plans print from the result to the scans
    assert "known_name" in joined[first_rows:]
    assert "known_name" not in joined[:first_rows]
    assert "lambda" not in joined


def test_report_text_needs_no_row_per_focus_and_job_reached_later(report, monkeypatch):
    def refused(*_):
        raise AssertionError("jobs by hop were asked for")

    monkeypatch.setattr(dep, "entry_items", lambda entries: entries.foci.where("false").selectExpr("'' AS section"), raising=False)
    monkeypatch.setattr(dep, "job_visits", refused)
    out = report(
        edges=[
            ("j1", "read", "sales", "orders"), ("j1", "write", "a", "mid"), ("j2", "read", "a", "mid"),
            ("j2", "write", "a", "end"), ("j3", "read", None, "end"), ("j3", "read", "sales", "orders"),
        ],
        joins=[("j4", "sales", "orders", "id", "a", "people", "id"), ("j4", "sales", "orders", "x", "a", "people", "x")],
        jobs=[("j1", "glue", "one"), ("j2", "glue", "two"), ("j2", "glue", "twice"), ("j4", "glue", "four")],
    )
    assert out["summary"].asDict() == {
        "focus_database": "sales", "focus_table": "orders", "in_catalog": False, "has_dependents": True, "n_direct_jobs": 2,
        "n_direct_tables": 1, "n_join_refs": 2, "n_transitive_jobs": 2, "n_transitive_tables": 1, "jobs_broken": 4,
        "tables_orphaned": 2,
    }
    assert [x for x in out["text"].splitlines() if x.startswith("    - ") or "reference" in x] == [
        "    - glue: one", "    - j3", "    - a.mid", "  join references (1):", "    - glue: four joins sales.orders <-> a.people",
        "    - a.end",
    ]


def test_bits_of_both_halves_of_a_mask_are_counted(spark, rows):
    df = spark.createDataFrame([(1, -1, 1), (1, 1 << 31, 2), (1, -(1 << 63), 3), (2, 1 << 32, 1)], "block long, mask long, times long")
    found = {f: n for f, n in rows(count_bits(df, "n", times="times"))}
    assert [found[64 + b] for b in (0, 31, 32, 63)] == [1, 3, 1, 4] and found[128 + 32] == 1 and found[128] == 0
