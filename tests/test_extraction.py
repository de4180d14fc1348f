"""Cache keys, prompts, validation, extraction of changed jobs, and catalog rebuilds."""

from __future__ import annotations

import hashlib
import json

import pytest

from tablewake.functions.names import job_id
from tablewake.operators import extraction as ex
from tablewake.plans import rebuild as rb
from tablewake.schemas import CATALOG, INVENTORY, SOURCE_FILES
from tablewake.sources.snapshot import read_snapshot, snapshot_age

FILES = [("j1", "b.py", "two"), ("j1", "a.py", "one"), ("j2", "x.sql", "SELECT 1")]


def key_of(files, version="v", model="m"):
    hashed = lambda text: hashlib.sha256(text.encode()).hexdigest()
    buckets = {}
    for path, contents in sorted(files):
        buckets.setdefault(hashed(path)[:2], []).append(f"{path}\x00{hashed(contents)}\x00")
    return hashed(f"{version}\x00{model}\x00" + "".join(b + hashed("".join(buckets[b])) for b in sorted(buckets)))


def keys(make, files, version="v", model="m"):
    df = ex.cache_key(make.frame(files, SOURCE_FILES), version, model)
    return {r.job_id: r.cache_key for r in df.collect()}


def test_cache_key(make):
    found = keys(make, FILES)
    assert found == {"j1": key_of([("a.py", "one"), ("b.py", "two")]), "j2": key_of([("x.sql", "SELECT 1")])}
    assert keys(make, FILES[::-1]) == found
    assert keys(make, FILES, model="other")["j1"] != found["j1"]
    assert keys(make, [("j1", "b.py", "TWO"), *FILES[1:]])["j1"] != found["j1"]


def test_cache_key_of_a_job_with_very_many_files(make):
    many = [("big", f"f{i}.py", str(i)) for i in range(1500)]
    found = keys(make, many)
    assert found == {"big": key_of([(p, c) for _, p, c in many])}
    assert keys(make, many[::-1]) == found
    changed = [("big", "f7.py", "changed") if p == "f7.py" else (j, p, c) for j, p, c in many]
    assert keys(make, changed) != found


def test_prompt_version_follows_instructions_and_schema():
    first = ex.prompt_version("find edges")
    assert first == ex.prompt_version("find edges") and len(first) == 16
    assert len({first, ex.prompt_version("find all edges"), ex.prompt_version("find edges", "struct<a:int>")}) == 3


def test_prompt(make, rows):
    jobs = make.jobs(("j1", "glue", "etl"), ("j2", "lambda", "fn"))
    prompts = ex.render_prompt(jobs, make.frame(FILES, SOURCE_FILES))
    whole = "job name: etl\njob type: glue\nruntime: unknown\n\n<file path=a.py>\none\n</file>\n\n<file path=b.py>\ntwo\n</file>"
    for pages in (prompts, ex.render_prompt(jobs, make.frame(FILES, SOURCE_FILES), page_chars=2)):
        own = sorted(pages.where("job_id = 'j1'").collect(), key=lambda r: (r.kind, r.path, r.piece))
        assert "".join(r.content for r in own) == whole
    assert max(len(r.content) for r in own if r.kind == ex.FILE) <= 2 + len("\n\n<file path=a.py>\n\n</file>")


def test_pages_of_a_large_job_stream_into_one_call(make, rows):
    jobs = make.jobs(("j1", "glue", "big"), ("j2", "glue", "small"))
    files = make.frame([("j1", f"f{i:04}.py", f"text {i}") for i in range(3000)] + [("j2", "a.py", ""), ("j2", "b.py", "x" * 50)], SOURCE_FILES)

    def extractor(name, pages):
        first, n, digest, most = next(pages), 1, hashlib.sha256(), 0
        assert first.startswith(f"job name: {name}")
        for page in pages:
            n, most = n + 1, max(most, len(page))
            digest.update(page.encode())
        return json.dumps({"table_edges": [{**EDGE, "table": f"{n} {digest.hexdigest()}"}]}) if most < 60 else "too long"

    out = ex.extract(ex.render_prompt(jobs, files, page_chars=20), extractor, 3)
    big = "".join(f"\n\n<file path=f{i:04}.py>\ntext {i}\n</file>" for i in range(3000))
    small = "\n\n<file path=a.py>\n\n</file>\n\n<file path=b.py>\n" + "x" * 50 + "\n</file>"
    want = [(j, f"{n} {hashlib.sha256(t.encode()).hexdigest()}") for j, n, t in (("j1", 3001, big), ("j2", 5, small))]
    assert rows(ex.table_edges(out.where("valid")), "job_id", "table_name") == want


def test_outputs_of_one_job_become_one_extraction(make, rows):
    edge = lambda table, dynamic=False: {**EDGE, "table": table, "is_dynamic": dynamic}
    texts = [
        ("j1", json.dumps({"table_edges": [edge("t"), edge("u", "yes")]})), ("j1", json.dumps({"table_edges": [edge("t")], "join_edges": [JOIN]})),
        ("j1", json.dumps({"table_edges": [edge("u", True)]})), ("j2", json.dumps({"table_edges": [edge("t"), edge("t")]})),
        ("j2", json.dumps({"table_edges": [edge("t"), edge("t")]})), ("j3", json.dumps({})), ("j3", "oops"), ("j4", None),
    ]
    one = ex.one_per_job(ex.validated(make.frame([(j, j, t) for j, t in texts], "job_id string, name string, extraction string")))
    got = {r.job_id: r for r in one.collect()}
    assert len(got) == one.count() == 4
    assert json.loads(got["j1"].extraction) == {"table_edges": [edge("t"), edge("u", True)], "join_edges": [JOIN]}
    assert got["j2"].extraction == texts[3][1]
    assert (got["j3"].valid, got["j3"].extraction, got["j4"].valid) == (False, "oops", False)
    assert rows(ex.table_edges(one.where("valid")), "job_id", "table_name", "is_dynamic") == [
        ("j1", "t", False), ("j1", "u", True), ("j2", "t", False), ("j2", "t", False),
    ]


def test_two_fixture_rows_of_a_name_store_one_extraction(spark, make, rows, tmp_path):
    raw = raw_inventory(spark, make, {"etl": "1"})
    twice = fixture(make, {"etl": "t1"}).unionByName(fixture(make, {"etl": "t2"}))
    rb.rebuild(spark, str(tmp_path / "c"), raw, files_of(make, {"etl": "1"}), rb.by_fixture(twice), "m", "v")
    catalog = read_snapshot(spark, str(tmp_path / "c"))
    assert catalog["job_extractions"].count() == 1
    assert rows(catalog["job_table_edges"], "table_name") == [("t1",), ("t2",)]


EDGE = {"database": None, "table": "t", "direction": "read", "is_dynamic": False, "evidence": "x"}
JOIN = {"left_database": "a", "left_table": "t", "left_column": "c", "right_database": None,
        "right_table": "u", "right_column": "d", "evidence": "x"}


def without(d, key):
    return {k: v for k, v in d.items() if k != key}


@pytest.mark.parametrize(
    ("value", "valid"),
    [
        ({}, True), ({"table_edges": [], "other": 1}, True), ({"table_edges": [EDGE], "join_edges": [JOIN]}, True),
        ({"table_edges": [{**EDGE, "is_dynamic": "yes"}]}, True), ({"table_edges": [{**EDGE, "is_dynamic": 1}]}, True),
        ({"table_edges": [{**EDGE, "is_dynamic": 2}]}, False), ({"table_edges": [{**EDGE, "direction": "scan"}]}, False),
        ({"table_edges": [without(EDGE, "database")]}, False), ({"table_edges": [without(EDGE, "evidence")]}, False),
        ({"table_edges": [{**EDGE, "table": 3}]}, False), ({"table_edges": [{**EDGE, "table": None}]}, False),
        ({"table_edges": None}, False), ({"table_edges": {}}, False), ({"table_edges": ["x"]}, False),
        ({"join_edges": [without(JOIN, "right_database")]}, False), ({"join_edges": [{**JOIN, "left_column": None}]}, False),
        ([], False), ("text", False), (None, False),
    ],
)
def test_validation(make, value, valid):
    df = ex.validated(make.frame([("j", json.dumps(value))], "job_id string, extraction string"))
    assert df.first().valid is valid


def test_broken_text_is_invalid_and_edges_explode(make, rows):
    df = make.frame(
        [("j", "not json"), ("k", json.dumps({"table_edges": [EDGE, {**EDGE, "is_dynamic": "on"}], "join_edges": [JOIN]}))],
        "job_id string, extraction string",
    )
    good = ex.validated(df).where("valid")
    assert rows(ex.table_edges(good), "job_id", "table_name", "is_dynamic") == [("k", "t", False), ("k", "t", True)]
    assert rows(ex.join_edges(good), "left_table", "right_table", "right_column") == [("t", "u", "d")]


def test_unanchored_joins_are_dropped(make, rows):
    edges = make.edges(("j1", "read", "a", "t"), ("j1", "write", None, "u"), ("j2", "read", "a", "df"))
    joins = make.joins(("j1", "x", "t", "c", None, "u", "d"), ("j1", "x", "t", "c", None, "df", "d"))
    assert rows(ex.anchored(edges, joins), "left_table", "right_table") == [("t", "u")]


RAW_JOBS = {"etl": "glue", "fn": "lambda", "LogRetention": "lambda"}


def raw_inventory(spark, make, names):
    def frame(kind, records):
        schema = spark.createDataFrame([], INVENTORY[kind]).schema
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in records], schema)

    return {
        "databases": frame("databases", [{"name": "a"}]),
        "tables": frame("tables", [{"name": "t", "database_name": "a"}]),
        "glue_jobs": frame("glue_jobs", [{"name": n, "command": '{"ScriptLocation":"s3://c/x.py"}'} for n in names if RAW_JOBS[n] == "glue"]),
        "lambda_functions": frame("lambda_functions", [{"name": n, "arn": f"arn:{n}"} for n in names if RAW_JOBS[n] == "lambda"]),
    }


def files_of(make, contents):
    from pyspark.sql import functions as F

    df = make.frame([(RAW_JOBS[n], n, f"{n}.py", text) for n, text in contents.items()], "type string, name string, path string, contents string")
    return df.select(job_id(F.col("type"), F.col("name")).alias("job_id"), "path", "contents")


def fixture(make, tables):
    return make.frame(
        [(n, json.dumps({"table_edges": [{**EDGE, "table": t}], "join_edges": [JOIN]})) for n, t in tables.items()],
        "name string, extraction string",
    )


def test_rebuild_carries_over_and_extracts_changed_jobs_only(spark, make, rows, tmp_path):
    root = str(tmp_path / "catalog")

    def rebuild(contents, tables, ignored=rb.DEFAULT_IGNORED_JOBS):
        raw = raw_inventory(spark, make, contents)
        done = rb.rebuild(spark, root, raw, files_of(make, contents), rb.by_fixture(fixture(make, tables)), "m", "v", ignored)
        catalog = read_snapshot(spark, root)
        named = catalog["job_table_edges"].join(catalog["jobs"].selectExpr("id AS job_id", "name"), "job_id")
        extracted = done.join(catalog["jobs"].selectExpr("id AS job_id", "name"), "job_id")
        return rows(extracted, "name"), rows(named, "name", "table_name"), catalog

    first, edges, catalog = rebuild({"etl": "1", "fn": "1", "LogRetention": "1"}, {"etl": "t1", "fn": "t1", "LogRetention": "t1"})
    assert first == [("etl",), ("fn",)]
    assert edges == [("etl", "t1"), ("fn", "t1")]
    assert set(catalog) == set(CATALOG)
    assert catalog["table_join_edges"].count() == 0
    assert rows(catalog["job_artifacts"], "reference") == [("arn:LogRetention",), ("arn:fn",), ("s3://c/x.py",)]

    # Nothing changed: nothing is extracted. Then one job changes and one disappears.
    again, edges, _ = rebuild({"etl": "1", "fn": "1", "LogRetention": "1"}, {"etl": "t2", "fn": "t2"})
    assert (again, edges) == ([], [("etl", "t1"), ("fn", "t1")])
    changed, edges, catalog = rebuild({"etl": "2", "LogRetention": "1"}, {"etl": "t3"})
    assert (changed, edges) == ([("etl",)], [("etl", "t3")])
    assert catalog["job_extractions"].count() == 1

    # An ignored job keeps the edges it has; an empty pattern ignores nothing.
    kept, edges, _ = rebuild({"etl": "3", "LogRetention": "1"}, {"LogRetention": "t4"}, ignored="^etl$")
    assert (kept, edges) == ([("LogRetention",)], [("LogRetention", "t4"), ("etl", "t3")])
    everything, edges, _ = rebuild({"etl": "4", "LogRetention": "2"}, {"etl": "t5", "LogRetention": "t5"}, ignored="")
    assert (everything, edges) == ([("LogRetention",), ("etl",)], [("LogRetention", "t5"), ("etl", "t5")])

    age = snapshot_age(spark, root).first()
    assert age.snapshot == 4 and -1 < age.hours < 1


def test_job_without_sources_keeps_its_edges(spark, make, rows):
    jobs = make.jobs(("j1", "glue", "etl"))
    old = {
        "job_extractions": make.frame([("j1", "key", "m", "v", "{}", None)], CATALOG["job_extractions"]),
        "job_table_edges": make.edges(("j1", "read", "a", "kept")),
        "table_join_edges": make.joins(),
    }
    out = rb.sync_edges(jobs, make.frame([], SOURCE_FILES), old, rb.by_fixture(fixture(make, {"etl": "new"})), "m", "v")
    assert rows(out["job_table_edges"], "table_name") == [("kept",)]
    assert out["extracted"].count() == 0


def test_invalid_output_is_retried_once_then_rejected(make, rows):
    def extractor(name, content):
        assert content.startswith(f"job name: {name}\n")
        if name == "never" or (name == "late" and "Respond again" not in content):
            return "oops"
        return json.dumps({"table_edges": [{**EDGE, "table": name}]})

    jobs = make.jobs(("j1", "glue", "first"), ("j2", "glue", "late"), ("j3", "glue", "never"))
    files = make.frame([(j, "a.py", "x") for j in ("j1", "j2", "j3")], SOURCE_FILES)
    old = {
        "job_extractions": make.frame([], CATALOG["job_extractions"]),
        "job_table_edges": make.edges(("j3", "read", "a", "before")),
        "table_join_edges": make.joins(),
    }
    out = rb.sync_edges(jobs, files, old, rb.by_extractor(ex.on_whole_prompt(extractor), 2), "m", "v")
    assert rows(out["extracted"]) == [("j1",), ("j2",)]
    assert rows(out["rejected"]) == [("j3",)]
    assert rows(out["job_table_edges"], "job_id", "table_name") == [("j1", "first"), ("j2", "late"), ("j3", "before")]


def test_missing_fixtures_are_listed(make, rows):
    jobs = make.jobs(("j1", "glue", "etl"), ("j2", "glue", "other"))
    assert rows(ex.missing_fixtures(jobs, fixture(make, {"etl": "t"})), "name") == [("other",)]
    output = rb.by_fixture(fixture(make, {"etl": "t"}))(jobs, None)
    assert rows(output, "name", "valid") == [("etl", True), ("other", False)]


def test_rehoming(make, rows):
    old = make.jobs(("o1", "glue", "etl"), ("o2", "glue", "gone"), ("o3", "lambda", "etl"))
    new = make.jobs(("n1", "glue", "etl"), ("n3", "lambda", "etl"))
    edges = make.edges(("o1", "read", "a", "x"), ("o2", "read", "a", "y"), ("o3", "read", "a", "z"), ("?", "read", "a", "w"))
    assert rows(ex.rehomed(edges, old, new), "job_id", "table_name") == [("n1", "x"), ("n3", "z")]


def test_plain_types_give_the_verdict_of_the_members(spark, monkeypatch):
    edge = {"database": "d", "table": "t", "direction": "read", "is_dynamic": True, "evidence": "e"}
    join = {f"{s}_{p}": "x" for s in ("left", "right") for p in ("database", "table", "column")} | {"evidence": "e"}
    good = [[edge], [edge | {"database": None}], [edge | {"is_dynamic": "yes"}], [edge | {"more": 1}], [edge, edge], []]
    bad = [
        [edge | {"direction": "scan"}], [edge | {"table": 1}], [edge, edge | {"evidence": None}], [{k: edge[k] for k in edge if k != "database"}],
        [{"database: STRING, direction": "read", "evidence": "e", "is_dynamic": True, "table": "t"}], "read", [None], [edge | {"database": 3}],
    ]
    docs = [({"table_edges": e}, True) for e in good] + [({"table_edges": e}, False) for e in bad] + [
        ({"join_edges": [join, join | {"left_database": None}]}, True), ({"join_edges": [join | {"right_column": None}]}, False),
        ({"join_edges": [join], "table_edges": [edge | {"table": None}]}, False), ({}, True),
    ]
    rows = [("j", json.dumps(doc)) for doc, _ in docs] + [("j", '{"table_edges":null}'), ("j", "{"), ("j", None)]
    table = spark.createDataFrame(rows, "job_id string, extraction string").coalesce(1)
    got = [r.valid for r in ex.validated(table).collect()]
    assert got[: len(docs)] == [valid for _, valid in docs]
    monkeypatch.setattr(ex, "PLAIN_TABLE_EDGES", ("",))
    monkeypatch.setattr(ex, "PLAIN_JOIN_EDGES", ("",))
    assert [r.valid for r in ex.validated(table).collect()] == got


def test_fixtures_are_asked_for_by_the_jobs_names_and_read_once(spark, make, rows):
    from tablewake.plans.rebuild import by_fixture

    asked = []

    def of(names):
        asked.append(rows(names))
        return make.frame([("a", "{}"), ("other", "{}")], "name string, extraction string")

    jobs = make.jobs(("1", "glue", "a"), ("2", "glue", "b"), ("3", "glue", None))
    found = by_fixture(of)(jobs, jobs)
    assert asked == [[("a",), ("b",), (None,)]]
    assert rows(found, "job_id", "valid") == [("1", True), ("2", False), ("3", False)]
