"""Every query by name, with its reference SQL where the check engine can express it.

A query takes (spark, sf_dir) and returns a DataFrame over the whole driver tables.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as docs
from ..functions import names, paths
from ..operators import audit, catalog, diagram
from ..operators import dependents as dep
from ..operators import extraction as ex
from ..operators.closure import walk
from ..operators.masks import named
from ..operators.spread import ITEMS_PER_PART, listed_text
from ..sources import code, inventory, snapshot
from ..sources.scratch import cut, new_path
from ..streaming import deletions as stream
from . import audit_run, check_delete
from . import closure_sql as cs
from . import rebuild as rb
from .views import base, view, with_views

if TYPE_CHECKING:
    import pandas as pd

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PROMPT_VERSION, MODEL = "v1", "fixture"
IGNORE_JOBS, IGNORE_TABLES = "^etl_1", "^tmp_[0-3]"
START = "TIMESTAMP '2024-01-15 00:00:00'"
WATCH = "SELECT * FROM lk_watch"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


#: The audit's clock and look-back; the earlier log reaches into it.
HOURS = 528
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def page_of(keys: str, item: str) -> str:
    """SQL of ``part``: the page of an item in the ordered list of its group."""
    return f"CAST((row_number() OVER (PARTITION BY {keys} ORDER BY {item}) - 1) // {ITEMS_PER_PART} AS INTEGER) AS part"


def now() -> F.Column:
    return F.expr("CAST('2024-02-01 00:00:00' AS TIMESTAMP_NTZ)")


def start() -> F.Column:
    return F.expr("CAST('2024-01-15 00:00:00' AS TIMESTAMP_NTZ)")


#: Columns by which the contents of catalog tables are compared.
CONTENT = {
    "databases": ("name",),
    "tables": ("database_name", "name"),
    "jobs": ("id", "type", "name", "runtime"),
    "job_artifacts": ("job_id", "reference"),
    "job_extractions": ("job_id",),
    "job_table_edges": ("job_id", "database_name", "table_name", "direction", "is_dynamic", "evidence"),
    "table_join_edges": (
        "job_id", "left_database", "left_table", "left_column", "right_database", "right_table", "right_column", "evidence",
    ),
    "extracted": ("job_id",),
}


def content_of(df: DataFrame, table: str) -> DataFrame:
    """(table_name, n, content): rows, and a sum of their hashes that any change of a row changes."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in CONTENT[table]))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(18,0)")
    total = F.coalesce(F.sum(part), F.lit(0).cast("decimal(28,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), total.alias("content")).select(F.lit(table).alias("table_name"), "n", "content")


def content_sql(source: str, table: str) -> str:
    text = f"concat_ws('|', {', '.join(f'coalesce(CAST({c} AS VARCHAR), {chr(39)}?{chr(39)})' for c in CONTENT[table])})"
    part = f"CAST('0x' || substr(sha256({text}), 1, 12) AS BIGINT)"
    return f"SELECT '{table}' AS table_name, count(*) AS n, CAST(coalesce(sum({part}), 0) AS VARCHAR) AS content FROM {source} AS c_{table}"


# ---------------------------------------------------------------- scans, sources, sinks


@query(
    "scan_inventory",
    """SELECT 'database' AS kind, name, NULL AS parent FROM lk_databases
       UNION ALL SELECT 'table', name, database_name FROM lk_tables
       UNION ALL SELECT 'glue', name, NULL FROM lk_glue_jobs
       UNION ALL SELECT 'lambda', name, NULL FROM lk_functions""",
)
def scan_inventory(spark: SparkSession, sf: str) -> DataFrame:
    landing = new_path(spark, "landing")
    sources = {
        "databases": "lk_databases", "tables": "lk_tables", "glue_jobs": "lk_glue_jobs",
        "lambda_functions": "lk_functions",
    }
    for kind, name in sources.items():
        view(spark, sf, name).write.json(f"{landing}/{kind}")
    found = inventory.scan_inventory(spark, landing, "json")
    none = "CAST(NULL AS STRING) AS parent"
    return (
        found["databases"].selectExpr("'database' AS kind", "name", none)
        .unionByName(found["tables"].selectExpr("'table' AS kind", "name", "database_name AS parent"))
        .unionByName(found["glue_jobs"].selectExpr("'glue' AS kind", "name", none))
        .unionByName(found["lambda_functions"].selectExpr("'lambda' AS kind", "name", none))
    )


@query(
    "scan_events",
    f"SELECT * FROM lk_events WHERE event_name = 'DeleteTable' AND event_time >= {START}",
)
def scan_events(spark: SparkSession, sf: str) -> DataFrame:
    return audit.since(view(spark, sf, "lk_events"), audit.DELETE_TABLE, start())


@query(
    "scan_scripts",
    """SELECT g.name, 's3://code/' || g.name || '.py' AS path, d.text AS contents
       FROM lk_glue_jobs AS g JOIN documents AS d ON g.name = 'etl_' || d.doc_id
       WHERE g.command IS NOT NULL
       UNION ALL
       SELECT g.name, 's3://code/' || g.name || '.py', d.text FROM lk_glue_jobs AS g
       JOIN documents AS d ON g.name = 'etl_' || d.doc_id
       WHERE contains(g.default_arguments, 'lib.zip')""",
)
def scan_scripts(spark: SparkSession, sf: str) -> DataFrame:
    jobs = view(spark, sf, "lk_glue_jobs")
    objects = base(spark, sf, "documents").selectExpr(
        "concat('/lake/code/etl_', doc_id, '.py') AS location", "CAST(text AS BINARY) AS content"
    )
    ids = jobs.select(names.job_id(F.lit("glue"), F.col("name")).alias("job_id"), "name")
    return code.script_files(jobs, objects, "/lake").join(ids, "job_id").select("name", "path", "contents")


def _packages(spark: SparkSession, sf: str) -> DataFrame:
    """One package per document: the file, vendored modules with their RECORD, a folder."""

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            rows = []
            for doc, path, text in zip(batch["doc_id"], batch["path"], batch["contents"], strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as archive:
                    archive.writestr("app/", "")
                    archive.writestr(path, text)
                    archive.writestr("app/vendored.py", "import os\n")
                    archive.writestr("lib-1.0.dist-info/RECORD", "app/vendored.py,sha256=x,10\nlib-1.0.dist-info/RECORD,,\n")
                    archive.writestr("deps/tool-2.dist-info/RECORD", "tool.py,,\r\n other.py ,x\n")
                    archive.writestr("deps/tool.py", "tool = 1\n")
                    archive.writestr("deps/kept.sql", "SELECT 1\n")
                rows.append((f"pkg_{doc}", data.getvalue()))
            yield pd.DataFrame(rows, columns=["name", "content"])

    files = base(spark, sf, "documents").selectExpr(
        "doc_id", "concat('app/f_', doc_id, if(source = 'src1', '_test.py', '.py')) AS path",
        "text AS contents",
    )
    zips = files.mapInPandas(zipped, "name string, content binary")
    return zips.withColumn("package_type", F.lit("Zip"))


PACKAGE_MEMBERS = """pm AS (
  SELECT 'pkg_' || doc_id AS name, 'app/f_' || doc_id || CASE WHEN source = 'src1' THEN '_test.py' ELSE '.py' END AS path,
         length(text) AS n_chars, source = 'src1' AS test, false AS dependency FROM documents
  UNION ALL SELECT 'pkg_' || doc_id, 'app/vendored.py', 10, false, true FROM documents
  UNION ALL SELECT 'pkg_' || doc_id, 'deps/tool.py', 9, false, true FROM documents
  UNION ALL SELECT 'pkg_' || doc_id, 'deps/kept.sql', 9, false, false FROM documents)"""


@query(
    "scan_packages",
    f"WITH {PACKAGE_MEMBERS} SELECT name, path, n_chars FROM pm WHERE NOT test AND NOT dependency",
)
def scan_packages(spark: SparkSession, sf: str) -> DataFrame:
    members = cut(code.package_members(_packages(spark, sf)))
    return code.authored_members(members).selectExpr("name", "path", "char_length(contents) AS n_chars")


@query(
    "drop_dependencies",
    f"WITH {PACKAGE_MEMBERS} SELECT name, path FROM pm WHERE NOT dependency",
)
def drop_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    members = cut(code.package_members(_packages(spark, sf)))
    own = members.where(paths.is_source_path(F.col("path")))
    return own.join(code.dependency_paths(members), ["name", "path"], "left_anti").select("name", "path")


def _small_catalog(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The views in the shape of the catalog tables."""
    return {
        "databases": view(spark, sf, "lk_databases"),
        "tables": view(spark, sf, "lk_tables"),
        "jobs": view(spark, sf, "lk_jobs"),
        "job_table_edges": view(spark, sf, "lk_edges"),
        "table_join_edges": view(spark, sf, "lk_join_edges"),
    }


def _all_tables(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Fill up missing columns and tables of the catalog schema."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    from ..schemas import CATALOG

    spark = next(iter(frames.values())).sparkSession
    full = {}
    for name, ddl in CATALOG.items():
        schema: StructType = _parse_datatype_string(ddl)
        df = frames.get(name)
        if df is None:
            df = spark.createDataFrame([], schema)
        full[name] = df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema
            ]
        )
    return full


SNAPSHOT_SOURCES = {
    "databases": "lk_databases", "tables": "lk_tables", "jobs": "lk_jobs",
    "job_artifacts": "(SELECT 'job_' || doc_id AS job_id, 's3://code/' || source AS reference FROM documents)",
    "job_extractions": "(SELECT DISTINCT job_id FROM lk_files)", "job_table_edges": "lk_edges", "table_join_edges": "lk_join_edges",
}


@query("write_snapshot", "SELECT *, 1 AS snapshot FROM (" + " UNION ALL ".join(content_sql(s, t) for t, s in SNAPSHOT_SOURCES.items()) + ") AS z")
def write_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "catalog")
    artifacts = base(spark, sf, "documents").selectExpr("concat('job_', doc_id) AS job_id", "concat('s3://code/', source) AS reference")
    extractions = view(spark, sf, "lk_files").select("job_id").distinct()
    tables = _all_tables({**_small_catalog(spark, sf), "job_artifacts": artifacts, "job_extractions": extractions})
    snapshot.write_snapshot(spark, root, {name: df.where("false") for name, df in tables.items()})
    snapshot.write_snapshot(spark, root, tables)
    number = snapshot.current_snapshot(spark, root)
    read = snapshot.read_snapshot(spark, root)
    rows = reduce(DataFrame.unionByName, (content_of(read[name], name) for name in SNAPSHOT_SOURCES))
    return rows.withColumn("snapshot", F.lit(number).cast("int"))


@query("snapshot_age", "SELECT count(*) AS n_jobs, true AS fresh FROM lk_jobs")
def snapshot_age(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "catalog")
    snapshot.write_snapshot(spark, root, _all_tables({"jobs": view(spark, sf, "lk_jobs")}))
    age = snapshot.snapshot_age(spark, root).selectExpr("0L AS n", "hours")
    jobs = snapshot.read_snapshot(spark, root)["jobs"].selectExpr("1L AS n", "CAST(NULL AS DOUBLE) AS hours")
    both = jobs.unionByName(age).agg(F.sum("n").alias("n_jobs"), F.max("hours").alias("hours"))
    return both.selectExpr("n_jobs", "hours BETWEEN -1 AND 1 AS fresh")


@query(
    "upsert_by_job",
    """SELECT * FROM lk_edges AS e WHERE NOT EXISTS (
         SELECT 1 FROM lk_jobs AS j WHERE j.id = e.job_id AND j.type = 'lambda')
       UNION ALL
       SELECT id, 'db_new', 'rewritten', 'write', false, 'new' FROM lk_jobs WHERE type = 'lambda'""",
)
def upsert_by_job(spark: SparkSession, sf: str) -> DataFrame:
    edges, jobs = view(spark, sf, "lk_edges"), view(spark, sf, "lk_jobs")
    stale = jobs.where("type = 'lambda'").selectExpr("id AS job_id")
    new = stale.selectExpr(
        "job_id", "'db_new' AS database_name", "'rewritten' AS table_name", "'write' AS direction",
        "false AS is_dynamic", "'new' AS evidence",
    )
    return snapshot.upsert_by_job(edges, new, stale)


RECORDS_SQL = """WITH req AS (
  SELECT *, CASE WHEN json_valid(cloud_trail_event) AND json_type(cloud_trail_event) = 'OBJECT'
                  AND json_type(cloud_trail_event, '$.requestParameters') = 'OBJECT'
                 THEN json_extract(cloud_trail_event, '$.requestParameters') END AS parameters
  FROM lk_events WHERE event_source = 'glue.amazonaws.com'),
listed AS (
  SELECT *, CASE WHEN event_name = 'DeleteTable' THEN [json_extract(parameters, '$.name')]
                 WHEN json_type(parameters, '$.tablesToDelete') = 'ARRAY' THEN json_extract(parameters, '$.tablesToDelete[*]')
            END AS entries
  FROM req WHERE parameters IS NOT NULL AND event_id <> ''),
strings AS (
  SELECT *, list_filter(list_transform(entries, lambda e: CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') END),
                        lambda t: t <> '') AS texts FROM listed),
del AS MATERIALIZED (
  SELECT event_id, json_extract_string(parameters, '$.databaseName') AS database_name,
         unnest(texts) AS table_name, event_name, event_time, username, region,
         generate_subscripts(texts, 1) - 1 AS position FROM strings),
kept AS MATERIALIZED (
  SELECT * FROM del WHERE NOT (regexp_matches(table_name, '^tmp_[0-3]')
    OR coalesce(regexp_matches(nullif(database_name, '') || '.' || table_name, '^tmp_[0-3]'), false))),
fresh AS MATERIALIZED (SELECT * FROM kept WHERE event_id NOT IN (SELECT event_id FROM lk_seen)),
del_f AS MATERIALIZED (SELECT row_number() OVER () AS fid, fdb, ft FROM (
  SELECT DISTINCT nullif(database_name, '') AS fdb, table_name AS ft FROM del) AS x),
dep AS MATERIALIZED (
  SELECT DISTINCT f.fid FROM del_f AS f JOIN lk_edges AS e ON e.table_name = f.ft AND e.direction = 'read'
    AND (f.fdb IS NULL OR e.database_name IS NULL OR e.database_name = f.fdb)
  UNION
  SELECT f.fid FROM del_f AS f JOIN lk_join_edges AS j ON j.left_table = f.ft OR j.right_table = f.ft
  WHERE (j.left_table = f.ft AND (f.fdb IS NULL OR j.left_database IS NULL OR j.left_database = f.fdb))
     <> (j.right_table = f.ft AND (f.fdb IS NULL OR j.right_database IS NULL OR j.right_database = f.fdb))),
flagkeys AS MATERIALIZED (SELECT fdb, ft FROM del_f JOIN dep USING (fid)),
flagged AS MATERIALIZED (
  SELECT d.* FROM fresh AS d WHERE EXISTS (
    SELECT 1 FROM flagkeys AS k WHERE k.ft = d.table_name AND k.fdb IS NOT DISTINCT FROM nullif(d.database_name, ''))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY database_name, table_name
              ORDER BY event_name <> 'DeleteTable', event_time, event_id, position) AS nth FROM flagged)"""


def _deletions(spark: SparkSession, sf: str) -> DataFrame:
    return audit.parse_deletions(view(spark, sf, "lk_events"))


def _fresh(spark: SparkSession, sf: str) -> DataFrame:
    kept = audit.kept(_deletions(spark, sf), IGNORE_TABLES)
    return audit.new_events(kept, view(spark, sf, "lk_seen"))


def _edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf, "lk_edges"), view(spark, sf, "lk_join_edges")


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return audit.flagged_deletions(_fresh(spark, sf), *_edges(spark, sf))


LATEST = """last AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, table_name
    ORDER BY event_name <> 'DeleteTable' DESC, event_time DESC, position DESC) AS back FROM fresh) AS x WHERE back = 1),
rec AS (
  SELECT l.event_id, l.database_name, l.table_name, l.event_name, l.event_time, l.username, l.region,
         EXISTS (SELECT 1 FROM flagged AS g WHERE g.event_id = l.event_id AND g.table_name = l.table_name) AS flagged
  FROM last AS l)"""


@query(
    "append_audit_log",
    f"""{RECORDS_SQL}, {LATEST} SELECT event_id, database_name, table_name, event_name, event_time,
        username, region, flagged FROM rec""",
)
def append_audit_log(spark: SparkSession, sf: str) -> DataFrame:
    records = audit.audit_records(_fresh(spark, sf), *_edges(spark, sf))
    path = new_path(spark, "log")
    snapshot.write_audit_log(spark, path, records, "first")
    snapshot.write_audit_log(spark, path, snapshot.read_audit_log(spark, path), "again")
    log = snapshot.read_audit_log(spark, path)
    return log.drop("reported_at").withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query("list_databases", "SELECT name, description FROM lk_databases")
def list_databases(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_databases(view(spark, sf, "lk_databases"))


@query("list_tables", "SELECT * FROM lk_tables")
def list_tables(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_tables(view(spark, sf, "lk_tables"))


@query("tables_of_database", "SELECT * FROM lk_tables WHERE database_name = 'db_1'")
def tables_of_database(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.tables_of_database(view(spark, sf, "lk_tables"), "db_1")


@query("get_table", "SELECT * FROM lk_tables WHERE database_name = 'db_2' AND name = 't_2'")
def get_table(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.get_table(view(spark, sf, "lk_tables"), "db_2", "t_2")


@query("tables_by_names", "SELECT * FROM lk_tables WHERE name IN (SELECT table_name FROM lk_watch)")
def tables_by_names(spark: SparkSession, sf: str) -> DataFrame:
    wanted = view(spark, sf, "lk_watch").selectExpr("table_name AS name")
    tables = view(spark, sf, "lk_tables")
    return catalog.tables_by_names(tables, wanted).select(*tables.columns)


@query("list_jobs", "SELECT * FROM lk_jobs")
def list_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_jobs(view(spark, sf, "lk_jobs"))


@query("jobs_by_ids", "SELECT * FROM lk_jobs WHERE id IN (SELECT job_id FROM lk_edges WHERE table_name = 'hub')")
def jobs_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = view(spark, sf, "lk_edges").where("table_name = 'hub'").selectExpr("job_id AS id")
    return catalog.jobs_by_ids(view(spark, sf, "lk_jobs"), ids)


# Distinct script uris at their first position, and arns: uris (type, name, uri, position).
URIS_SQL = """raw AS (
  SELECT name, CASE WHEN json_valid(command) THEN json_extract_string(command, '$.ScriptLocation') END AS script,
         CASE WHEN json_valid(default_arguments) THEN json_extract_string(default_arguments, '$."--extra-py-files"') END AS extra
  FROM lk_glue_jobs),
cleaned AS (
  SELECT name, list_filter(list_transform(list_concat([script], string_split(coalesce(extra, ''), ',')), lambda u: regexp_replace(u, '^[\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x{85}]+|[\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x{85}]+$', '', 'g')),
                           lambda u: u <> '') AS uris FROM raw),
uris AS (SELECT name, unnest(uris) AS uri, generate_subscripts(uris, 1) - 1 AS position FROM cleaned),
arts AS (
  SELECT sha256('glue' || chr(0) || name) AS job_id, uri AS reference, min(position) AS position FROM uris GROUP BY name, uri
  UNION ALL SELECT sha256('lambda' || chr(0) || name), arn, 0 FROM lk_functions WHERE arn <> '')"""


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.job_artifacts(view(spark, sf, "lk_glue_jobs"), view(spark, sf, "lk_functions"))


@query("list_artifacts", f"WITH {URIS_SQL} SELECT job_id, reference FROM arts")
def list_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_artifacts(_artifacts(spark, sf)).select("job_id", "reference")


@query("job_artifacts", f"WITH {URIS_SQL} SELECT job_id, reference, position FROM arts")
def job_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return _artifacts(spark, sf)


@query("list_extractions", "SELECT job_id, extraction FROM lk_extractions")
def list_extractions(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_extractions(view(spark, sf, "lk_extractions"))


@query("cache_keys", "SELECT job_id, cache_key FROM lk_cached")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.cache_keys(view(spark, sf, "lk_cached"))


@query("list_edges", "SELECT * FROM lk_edges")
def list_edges(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_edges(view(spark, sf, "lk_edges"))


@query("edges_by_tables", "SELECT * FROM lk_edges WHERE table_name IN (SELECT table_name FROM lk_watch)")
def edges_by_tables(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.edges_by_tables(view(spark, sf, "lk_edges"), view(spark, sf, "lk_watch"))


@query("edges_by_jobs", "SELECT * FROM lk_edges WHERE job_id IN (SELECT id FROM lk_jobs WHERE type = 'lambda')")
def edges_by_jobs(spark: SparkSession, sf: str) -> DataFrame:
    ids = view(spark, sf, "lk_jobs").where("type = 'lambda'").selectExpr("id AS job_id")
    return catalog.edges_by_jobs(view(spark, sf, "lk_edges"), ids)


@query("list_join_edges", "SELECT * FROM lk_join_edges")
def list_join_edges(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_join_edges(view(spark, sf, "lk_join_edges"))


@query(
    "join_edges_of_table",
    """SELECT w.table_name AS focus_table, j.* FROM (SELECT DISTINCT table_name FROM lk_watch) AS w
       JOIN lk_join_edges AS j ON j.left_table = w.table_name OR j.right_table = w.table_name""",
)
def join_edges_of_table(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.join_edges_of_tables(view(spark, sf, "lk_join_edges"), view(spark, sf, "lk_watch"))


@query(
    "seen_event_ids",
    """SELECT DISTINCT e.event_id FROM lk_events AS e WHERE e.event_id IN (SELECT event_id FROM lk_seen)""",
)
def seen_event_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = view(spark, sf, "lk_events").select("event_id").distinct()
    return ids.join(view(spark, sf, "lk_seen"), "event_id", "left_semi")


@query(
    "get_function",
    "SELECT name, arn, runtime, package_type FROM lk_functions WHERE name = (SELECT min(name) FROM lk_functions)",
)
def get_function(spark: SparkSession, sf: str) -> DataFrame:
    functions = view(spark, sf, "lk_functions")
    first = functions.agg(F.min("name").alias("name")).first()["name"]
    return catalog.first_function(functions, first).select("name", "arn", "runtime", "package_type")


# ---------------------------------------------------------------- projections


@query(
    "decode_json",
    """SELECT name, CASE WHEN json_valid(default_arguments) THEN json_type(default_arguments) END AS kind,
              coalesce(default_arguments <> '' AND NOT json_valid(default_arguments), false) AS rejected
       FROM lk_glue_jobs""",
)
def decode_json(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("default_arguments")
    kind = F.when(docs.is_json_object(docs.decoded(text)), "OBJECT")
    return view(spark, sf, "lk_glue_jobs").select(
        "name", kind.alias("kind"), docs.is_rejected(text).alias("rejected")
    )


GLUE_ATTRIBUTES = """json_object(
    'command', CASE WHEN json_valid(command) THEN CAST(command AS JSON) END,
    'default_arguments', CASE WHEN json_valid(default_arguments) THEN CAST(default_arguments AS JSON) END,
    'non_overridable_arguments', NULL, 'connections', NULL, 'glue_version', glue_version,
    'execution_class', NULL, 'worker_type', worker_type, 'number_of_workers', number_of_workers,
    'max_capacity', NULL, 'max_retries', NULL, 'timeout', NULL, 'tags', NULL)"""

JOBS_SQL = f"""nj AS (
  SELECT sha256('glue' || chr(0) || name) AS id, 'glue' AS type, name, description, role,
         CASE WHEN json_valid(command) THEN json_extract_string(command, '$.PythonVersion') END AS runtime,
         last_modified_on AS last_modified, CAST({GLUE_ATTRIBUTES} AS VARCHAR) AS attributes
  FROM lk_glue_jobs
  UNION ALL
  SELECT sha256('lambda' || chr(0) || name), 'lambda', name, description, role, runtime, last_modified,
         CAST(json_object('handler', NULL, 'code_sha_256', NULL, 'code_size', code_size, 'version', NULL,
           'package_type', package_type, 'state', NULL, 'memory_size', NULL, 'timeout', NULL,
           'architectures', CAST(architectures AS JSON), 'environment_variables', NULL, 'layers', NULL,
           'ephemeral_storage', NULL, 'vpc_id', NULL, 'vpc_security_group_ids', NULL, 'vpc_subnet_ids', NULL,
           'tracing_config', NULL, 'logging_config', NULL, 'url_config', NULL, 'tags', NULL) AS VARCHAR)
  FROM lk_functions)"""


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.normalized_jobs(view(spark, sf, "lk_glue_jobs"), view(spark, sf, "lk_functions"))


@query("attributes_json", f"WITH {JOBS_SQL} SELECT type, name, attributes FROM nj")
def attributes_json(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf).select("type", "name", "attributes")


@query("normalize_jobs", f"WITH {JOBS_SQL} SELECT * FROM nj")
def normalize_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf)


@query("job_runtime", f"WITH {JOBS_SQL} SELECT type, name, runtime FROM nj")
def job_runtime(spark: SparkSession, sf: str) -> DataFrame:
    return _normalized(spark, sf).select("type", "name", "runtime")


@query("job_row_plugin", f"WITH {JOBS_SQL} SELECT type, count(*) AS n, count(runtime) AS n_runtime FROM nj GROUP BY type")
def job_row_plugin(spark: SparkSession, sf: str) -> DataFrame:
    sources = {"glue": view(spark, sf, "lk_glue_jobs"), "lambda": view(spark, sf, "lk_functions")}
    rows = None
    for kind in inventory.JOB_MAPPINGS:
        part = inventory.job_rows(sources[kind], kind)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count("runtime").alias("n_runtime")
    )


@query("script_uris", f"WITH {URIS_SQL} SELECT name, position, uri FROM uris")
def script_uris(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.script_uris(view(spark, sf, "lk_glue_jobs"))


@query(
    "split_s3_uri",
    f"""WITH {URIS_SQL} SELECT reference, nullif(regexp_extract(reference, '^s3://([^/]+)/(.+)$', 1), '') AS bucket,
        nullif(regexp_extract(reference, '^s3://([^/]+)/(.+)$', 2), '') AS key FROM (SELECT DISTINCT reference FROM arts) AS x""",
)
def split_s3_uri(spark: SparkSession, sf: str) -> DataFrame:
    refs = _artifacts(spark, sf).select("reference").distinct()
    uri = F.col("reference")
    return refs.select("reference", names.s3_bucket(uri).alias("bucket"), names.s3_key(uri).alias("key"))


@query(
    "table_key",
    """SELECT DISTINCT CASE WHEN coalesce(database_name, '') = '' THEN table_name
                            ELSE database_name || '.' || table_name END AS table_key FROM lk_edges""",
)
def table_key(spark: SparkSession, sf: str) -> DataFrame:
    key = names.table_key(F.col("database_name"), F.col("table_name"))
    return view(spark, sf, "lk_edges").select(key.alias("table_key")).distinct()


LABELLED = """SELECT DISTINCT e.job_id, coalesce(j.type || ': ' || j.name, e.job_id) AS label
              FROM lk_edges AS e LEFT JOIN lk_jobs AS j ON j.id = e.job_id"""


@query("job_label", LABELLED)
def job_label(spark: SparkSession, sf: str) -> DataFrame:
    ids = view(spark, sf, "lk_edges").select("job_id").distinct()
    return dep.with_label(ids, view(spark, sf, "lk_jobs"))


@query(
    "label_jobs",
    """SELECT e.job_id, e.direction, coalesce(j.type || ': ' || j.name, e.job_id) AS label, count(*) AS n
       FROM lk_edges AS e LEFT JOIN lk_jobs AS j ON j.id = e.job_id GROUP BY 1, 2, 3""",
)
def label_jobs(spark: SparkSession, sf: str) -> DataFrame:
    counts = view(spark, sf, "lk_edges").groupBy("job_id", "direction").agg(F.count(F.lit(1)).alias("n"))
    return dep.with_label(counts, view(spark, sf, "lk_jobs"))


@query(
    "partition_names",
    """SELECT database_name, name, array_to_string(list_transform(json_extract(coalesce(partition_keys, '[]'), '$[*]'),
              lambda k: json_extract_string(k, '$.Name')), ', ') AS partitions FROM lk_tables""",
)
def partition_names(spark: SparkSession, sf: str) -> DataFrame:
    parts = docs.partition_names(F.col("partition_keys"))
    return view(spark, sf, "lk_tables").select(
        "database_name", "name", F.array_join(parts, ", ").alias("partitions")
    )


@query(
    "table_columns",
    """WITH x AS (
         SELECT database_name, name AS table_name, json_extract_string(storage_descriptor, '$.Location') AS location,
                false AS is_partition, json_extract(storage_descriptor, '$.Columns[*]') AS entries FROM lk_tables
         UNION ALL SELECT database_name, name, json_extract_string(storage_descriptor, '$.Location'), true,
                json_extract(partition_keys, '$[*]') FROM lk_tables WHERE partition_keys IS NOT NULL),
       y AS (SELECT *, unnest(entries) AS entry, generate_subscripts(entries, 1) - 1 AS position FROM x)
       SELECT database_name, table_name, json_extract_string(entry, '$.Name') AS column_name,
              json_extract_string(entry, '$.Type') AS column_type, json_extract_string(entry, '$.Comment') AS comment,
              is_partition, position, location FROM y""",
)
def table_columns(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.table_columns(view(spark, sf, "lk_tables"))


# CRC-32 by bits: each byte is added to the register, which is shifted eight times.
@query(
    "accent",
    f"""WITH named AS (SELECT DISTINCT coalesce(database_name, name) AS name FROM lk_tables),
    coded AS (SELECT name, hex(encode(name)) AS h FROM named),
    crc AS (SELECT name, xor(4294967295, list_reduce(
        list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
        lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[],
          lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)),
        4294967295)) AS code FROM coded)
    SELECT name, CAST(code % {names.ACCENT_STEPS} + 1 AS INTEGER) AS ramp FROM crc""",
)
def accent(spark: SparkSession, sf: str) -> DataFrame:
    keys = view(spark, sf, "lk_tables").selectExpr("coalesce(database_name, name) AS name").distinct()
    return keys.select("name", names.accent(F.col("name")).alias("ramp"))


def _authored(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return view(spark, sf, "lk_files").where(paths.is_source_path(path) & paths.is_authored_path(path))


AUTHORED = """regexp_matches(path, '\\.(py|sql)$') AND NOT regexp_matches(path, '(^|/)\\.')
  AND NOT regexp_matches(path, '(^|/)__pycache__(/|$)') AND NOT regexp_matches(path, '\\.(dist-info|egg-info)/')
  AND NOT regexp_matches(path, '(^|/)(site-packages|test|tests)/') AND NOT regexp_matches(path, '^(bin|lib|lib64|venv|python)/')
  AND NOT regexp_matches(path, '(^|/)(conftest\\.py|test_[^/]*|[^/]*_test\\.(py|sql))$')"""

OWN_FILES = f"own AS MATERIALIZED (SELECT * FROM lk_files WHERE {AUTHORED})"

KEYS_SQL = f"""{OWN_FILES}, file_buckets AS (
  SELECT job_id, substr(sha256(path), 1, 2) AS bucket,
         sha256(string_agg(path || chr(0) || sha256(contents) || chr(0), '' ORDER BY path, sha256(contents))) AS digest
  FROM own GROUP BY 1, 2),
fresh_keys AS MATERIALIZED (
  SELECT job_id, sha256('{PROMPT_VERSION}' || chr(0) || '{MODEL}' || chr(0)
    || string_agg(bucket || digest, '' ORDER BY bucket)) AS cache_key
  FROM file_buckets GROUP BY job_id)"""

CACHED_SQL = """stored AS MATERIALIZED (
  SELECT job_id, cache_key FROM lk_cached
  UNION ALL
  SELECT k.job_id, k.cache_key FROM fresh_keys AS k JOIN lk_jobs AS j ON j.id = k.job_id
  WHERE j.runtime = '3' AND k.job_id NOT IN (SELECT job_id FROM lk_cached)),
stale AS MATERIALIZED (
  SELECT k.job_id, k.cache_key FROM fresh_keys AS k LEFT JOIN stored AS s ON s.job_id = k.job_id
  WHERE s.cache_key IS DISTINCT FROM k.cache_key)"""


@query(
    "render_prompt",
    f"""WITH {OWN_FILES} SELECT j.id AS job_id, j.name, 0 AS kind, '' AS path, 0 AS piece, 'job name: ' || j.name || chr(10)
           || 'job type: ' || j.type || chr(10) || 'runtime: ' || coalesce(j.runtime, 'unknown') AS content
       FROM lk_jobs AS j WHERE j.id IN (SELECT job_id FROM own)
       UNION ALL
       SELECT f.job_id, j.name, 1, f.path, CAST(p.piece AS INTEGER), CASE WHEN p.piece = 0 THEN chr(10) || chr(10) || '<file path=' || f.path || '>' || chr(10) ELSE '' END
         || substr(f.contents, CAST(p.piece * {ex.PAGE_CHARS} + 1 AS BIGINT), {ex.PAGE_CHARS})
         || CASE WHEN (p.piece + 1) * {ex.PAGE_CHARS} >= length(f.contents) THEN chr(10) || '</file>' ELSE '' END
       FROM own AS f JOIN lk_jobs AS j ON j.id = f.job_id,
         LATERAL (SELECT unnest(range(greatest(1, (length(f.contents) + {ex.PAGE_CHARS} - 1) // {ex.PAGE_CHARS}))) AS piece) AS p""",
)
def render_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return ex.render_prompt(view(spark, sf, "lk_jobs"), _authored(spark, sf))


VALID_SQL = """val AS MATERIALIZED (
  SELECT job_id, extraction, CASE WHEN NOT json_valid(extraction) THEN false ELSE
    coalesce(list_bool_and(list_transform(json_extract(extraction, '$.table_edges[*]'), lambda e:
      coalesce(json_type(e, '$.database') IN ('VARCHAR', 'NULL') AND json_type(e, '$.table') = 'VARCHAR'
        AND json_extract_string(e, '$.direction') IN ('read', 'write') AND json_type(e, '$.is_dynamic') = 'BOOLEAN'
        AND json_type(e, '$.evidence') = 'VARCHAR', false))), true)
    AND coalesce(list_bool_and(list_transform(json_extract(extraction, '$.join_edges[*]'), lambda e:
      coalesce(json_type(e, '$.left_table') = 'VARCHAR' AND json_type(e, '$.right_table') = 'VARCHAR'
        AND json_type(e, '$.left_database') IN ('VARCHAR', 'NULL') AND json_type(e, '$.right_database') IN ('VARCHAR', 'NULL')
        AND json_type(e, '$.left_column') = 'VARCHAR' AND json_type(e, '$.right_column') = 'VARCHAR'
        AND json_type(e, '$.evidence') = 'VARCHAR', false))), true) END AS valid
  FROM lk_extractions)"""

EXTRACTED_SQL = VALID_SQL + """, xt AS MATERIALIZED (
  SELECT job_id, json_extract_string(e, '$.database') AS database_name, json_extract_string(e, '$.table') AS table_name,
         json_extract_string(e, '$.direction') AS direction, json_extract_string(e, '$.is_dynamic') = 'true' AS is_dynamic,
         json_extract_string(e, '$.evidence') AS evidence
  FROM (SELECT job_id, unnest(json_extract(extraction, '$.table_edges[*]')) AS e FROM val WHERE valid) AS a),
xj AS MATERIALIZED (
  SELECT job_id, json_extract_string(e, '$.left_database') AS left_database, json_extract_string(e, '$.left_table') AS left_table,
         json_extract_string(e, '$.left_column') AS left_column, json_extract_string(e, '$.right_database') AS right_database,
         json_extract_string(e, '$.right_table') AS right_table, json_extract_string(e, '$.right_column') AS right_column,
         json_extract_string(e, '$.evidence') AS evidence
  FROM (SELECT job_id, unnest(json_extract(extraction, '$.join_edges[*]')) AS e FROM val WHERE valid) AS a)"""


@query("validate_extraction", f"WITH {VALID_SQL} SELECT job_id, extraction, valid FROM val")
def validate_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return ex.validated(view(spark, sf, "lk_extractions"))


@query(
    "explode_extractions",
    f"""WITH {EXTRACTED_SQL} SELECT 'table' AS kind, job_id, database_name, table_name, direction, is_dynamic,
            NULL AS left_column, NULL AS right_table, NULL AS right_column, evidence FROM xt
        UNION ALL SELECT 'join', job_id, left_database, left_table, NULL, NULL, left_column, right_table, right_column, evidence FROM xj""",
)
def explode_extractions(spark: SparkSession, sf: str) -> DataFrame:
    valid = cut(ex.validated(view(spark, sf, "lk_extractions"))).where("valid")
    none = "CAST(NULL AS STRING)"
    tables = ex.table_edges(valid).selectExpr(
        "'table' AS kind", "job_id", "database_name", "table_name", "direction", "is_dynamic",
        f"{none} AS left_column", f"{none} AS right_table", f"{none} AS right_column", "evidence",
    )
    joins = ex.join_edges(valid).selectExpr(
        "'join' AS kind", "job_id", "left_database AS database_name", "left_table AS table_name",
        f"{none} AS direction", "CAST(NULL AS BOOLEAN) AS is_dynamic", "left_column", "right_table",
        "right_column", "evidence",
    )
    return tables.unionByName(joins)


# ---------------------------------------------------------------- filters


@query("ignore_jobs", f"SELECT type, name, regexp_matches(name, '{IGNORE_JOBS}') AS ignored FROM lk_jobs")
def ignore_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "lk_jobs").select(
        "type", "name", paths.is_ignored_job(F.col("name"), IGNORE_JOBS).alias("ignored")
    )


@query(
    "split_ignored",
    f"""{RECORDS_SQL} SELECT event_id, database_name, table_name, position,
        regexp_matches(table_name, '{IGNORE_TABLES}') AS ignored FROM del""",
)
def split_ignored(spark: SparkSession, sf: str) -> DataFrame:
    return audit.split_ignored(_deletions(spark, sf), IGNORE_TABLES).select(
        "event_id", "database_name", "table_name", "position", "ignored"
    )


@query("source_paths", "SELECT job_id, path FROM lk_files WHERE path LIKE '%.py' OR path LIKE '%.sql'")
def source_paths(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "lk_files")
    return files.where(paths.is_source_path(F.col("path"))).select("job_id", "path")


@query("authored_paths", f"SELECT job_id, path, {AUTHORED.replace('regexp_matches(path, ' + chr(39) + chr(92) + '.(py|sql)$' + chr(39) + ') AND ', '')} AS authored FROM lk_files")
def authored_paths(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "lk_files").select(
        "job_id", "path", paths.is_authored_path(F.col("path")).alias("authored")
    )


@query(
    "drop_empty_members",
    """SELECT job_id, path FROM (SELECT job_id, path FROM lk_files
         UNION ALL SELECT DISTINCT job_id, regexp_extract(path, '^(.*/)', 1) FROM lk_files) AS x
       WHERE path NOT LIKE '%/'""",
)
def drop_empty_members(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "lk_files").select("job_id", "path")
    folders = files.selectExpr("job_id", "regexp_extract(path, '^(.*/)', 1) AS path").distinct()
    return files.unionByName(folders).where(~paths.is_directory_entry(F.col("path")))


@query(
    "lookback",
    f"""SELECT event_id, event_name, event_time FROM lk_events
        WHERE event_name IN ('DeleteTable', 'BatchDeleteTable') AND event_time >= {START}""",
)
def lookback(spark: SparkSession, sf: str) -> DataFrame:
    found = audit.deletions_since(view(spark, sf, "lk_events"), start())
    return found.select("event_id", "event_name", "event_time")


@query("union_deletes", f"SELECT * FROM lk_events WHERE event_name IN ('DeleteTable', 'BatchDeleteTable') AND event_time >= {START}")
def union_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return audit.deletions_since(view(spark, sf, "lk_events"), start())


SEARCH_SQL = """WITH n AS (
  SELECT database_name, name AS table_name,
         list_concat(json_extract(storage_descriptor, '$.Columns[*]'), json_extract(coalesce(partition_keys, '[]'), '$[*]')) AS cols
  FROM lk_tables),
m AS (
  SELECT database_name, table_name, list_sort(list_distinct(list_filter(
           list_transform(cols, lambda c: json_extract_string(c, '$.Name')), lambda x: contains(lower(x), 'ring')))) AS hits FROM n)
SELECT database_name, table_name, array_to_string(hits, ', ') AS matches FROM m WHERE len(hits) > 0
ORDER BY table_name, database_name LIMIT 50"""


@query("search_columns", SEARCH_SQL)
def search_columns(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search_columns(view(spark, sf, "lk_tables"), " RING ")


@query("package_type_filter", "SELECT name, arn FROM lk_functions WHERE package_type = 'Zip'")
def package_type_filter(spark: SparkSession, sf: str) -> DataFrame:
    functions = view(spark, sf, "lk_functions")
    return functions.where(F.col("package_type") == code.ZIP_PACKAGE).select("name", "arn")


# ---------------------------------------------------------------- joins


@query(
    "wildcard_join",
    """SELECT l.database_name AS left_database, l.table_name AS left_table, r.database_name AS right_database, count(*) AS n
       FROM lk_watch AS l JOIN lk_edges AS r ON r.table_name = l.table_name
        AND (l.database_name IS NULL OR r.database_name IS NULL OR l.database_name = r.database_name)
       GROUP BY 1, 2, 3""",
)
def wildcard_join(spark: SparkSession, sf: str) -> DataFrame:
    pairs = dep.matching_tables(view(spark, sf, "lk_watch"), view(spark, sf, "lk_edges"))
    return pairs.groupBy("left_database", "left_table", "right_database").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rehome_rows",
    """SELECT 'new_' || j.id AS job_id, e.database_name, e.table_name, e.direction
       FROM lk_edges AS e JOIN lk_jobs AS j ON j.id = e.job_id WHERE j.type = 'glue'""",
)
def rehome_rows(spark: SparkSession, sf: str) -> DataFrame:
    jobs = view(spark, sf, "lk_jobs")
    rows = view(spark, sf, "lk_edges").select("job_id", "database_name", "table_name", "direction")
    new = jobs.where("type = 'glue'").selectExpr("concat('new_', id) AS id", "type", "name")
    return ex.rehomed(rows, jobs, new)


def _stored_keys(fresh: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Earlier keys: out of date for some jobs, up to date for others, none for the rest."""
    cached, jobs = view(spark, sf, "lk_cached"), view(spark, sf, "lk_jobs")
    current = jobs.where("runtime = '3'").selectExpr("id AS job_id")
    hits = fresh.join(current, "job_id", "left_semi").join(cached, "job_id", "left_anti")
    return cached.unionByName(hits.select("job_id", "cache_key"))


def _fresh_keys(spark: SparkSession, sf: str) -> DataFrame:
    return ex.cache_key(_authored(spark, sf), PROMPT_VERSION, MODEL)


@query("job_cache_key", f"WITH {KEYS_SQL} SELECT job_id, cache_key FROM fresh_keys")
def job_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return _fresh_keys(spark, sf)


@query("stale_jobs", f"WITH {KEYS_SQL}, {CACHED_SQL} SELECT job_id, cache_key FROM stale")
def stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    fresh = _fresh_keys(spark, sf)
    return ex.stale_jobs(fresh, _stored_keys(fresh, spark, sf))


ANCHORED_SQL = """SELECT j.* FROM lk_join_edges AS j
  WHERE EXISTS (SELECT 1 FROM lk_edges AS e WHERE e.job_id = j.job_id AND e.table_name = j.left_table)
    AND EXISTS (SELECT 1 FROM lk_edges AS e WHERE e.job_id = j.job_id AND e.table_name = j.right_table)"""


@query("anchor_joins", ANCHORED_SQL)
def anchor_joins(spark: SparkSession, sf: str) -> DataFrame:
    return ex.anchored(*_edges(spark, sf))


DELETION_COLUMNS = "event_id, database_name, table_name, event_name, event_time, username, region, position"


@query("new_events", f"{RECORDS_SQL} SELECT {DELETION_COLUMNS} FROM fresh")
def new_events(spark: SparkSession, sf: str) -> DataFrame:
    return _fresh(spark, sf)


@query(
    "backfill_database",
    f"""WITH {cs.KNOWN} SELECT DISTINCT w.table_name AS focus_table, e.table_name,
        coalesce(e.database_name, CASE WHEN e.table_name <> w.table_name THEN kd.db END) AS database_name
        FROM lk_watch AS w JOIN lk_edges AS f ON f.table_name = w.table_name
        JOIN lk_edges AS e ON e.job_id = f.job_id LEFT JOIN kd ON kd.name = e.table_name""",
)
def backfill_database(spark: SparkSession, sf: str) -> DataFrame:
    edges = view(spark, sf, "lk_edges")
    touched = edges.join(
        view(spark, sf, "lk_watch").selectExpr("table_name AS focus_table"), F.expr("table_name = focus_table")
    ).select("focus_table", "job_id").distinct()
    near = touched.join(edges, "job_id").select("focus_table", "database_name", "table_name").distinct()
    return dep.backfilled(near, view(spark, sf, "lk_tables")).distinct()


@query(
    "join_refs",
    f"""WITH {cs.foci(WATCH)}, {cs.JOIN_REFS} SELECT f.fdb AS focus_database, f.ft AS focus_table, jr.job_id,
        jr.db AS database_name, jr.t AS table_name, jr.evidence FROM jr JOIN f USING (fid)""",
)
def join_refs(spark: SparkSession, sf: str) -> DataFrame:
    return dep.join_refs(view(spark, sf, "lk_join_edges"), view(spark, sf, "lk_watch"))


@query(
    "job_flows",
    """SELECT DISTINCT r.job_id, r.table_name AS source, w.table_name AS target FROM lk_edges AS r
       JOIN lk_edges AS w ON w.job_id = r.job_id AND r.direction = 'read' AND w.direction = 'write'
       WHERE r.table_name <> w.table_name""",
)
def job_flows(spark: SparkSession, sf: str) -> DataFrame:
    return diagram.job_flows(view(spark, sf, "lk_edges"))


@query(
    "in_catalog",
    """SELECT DISTINCT w.database_name, w.table_name, EXISTS (SELECT 1 FROM lk_tables AS t
         WHERE t.database_name = w.database_name AND t.name = w.table_name) AS in_catalog FROM lk_watch AS w""",
)
def in_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return dep.in_catalog(view(spark, sf, "lk_watch"), view(spark, sf, "lk_tables"))


@query("flagged_deletions", f"{RECORDS_SQL} SELECT {DELETION_COLUMNS} FROM flagged")
def flagged_deletions(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf)


@query(
    "check_constraints",
    f"""{RECORDS_SQL} SELECT 'databases.unique' AS constraint_name, name AS subject, count(*) AS n FROM lk_databases GROUP BY name HAVING count(*) > 1
       UNION ALL SELECT 'tables.unique', database_name || '.' || name, count(*) FROM lk_tables GROUP BY database_name, name HAVING count(*) > 1
       UNION ALL SELECT 'jobs.unique', type || ': ' || name, count(*) FROM lk_jobs GROUP BY type, name HAVING count(*) > 1
       UNION ALL SELECT 'extractions.unique', job_id, count(*) FROM lk_extractions GROUP BY job_id HAVING count(*) > 1
       UNION ALL SELECT DISTINCT 'tables.database', database_name, 1 FROM lk_tables
         WHERE database_name IS NOT NULL AND database_name NOT IN (SELECT name FROM lk_databases)
       UNION ALL SELECT DISTINCT 'edges.job', job_id, 1 FROM lk_edges WHERE job_id NOT IN (SELECT id FROM lk_jobs)
       UNION ALL SELECT 'events.not_null', 'event_id', count(*) FROM lk_events WHERE event_id IS NULL HAVING count(*) > 0
       UNION ALL SELECT DISTINCT 'extractions.job', job_id, 1 FROM lk_extractions WHERE job_id NOT IN (SELECT id FROM lk_jobs)
       UNION ALL SELECT DISTINCT 'joins.job', job_id, 1 FROM lk_join_edges WHERE job_id NOT IN (SELECT id FROM lk_jobs)
       UNION ALL SELECT 'joins.not_null', c, count(*) FROM (SELECT unnest(['job_id', 'left_table', 'left_column', 'right_table',
           'right_column', 'evidence']) AS c, unnest([job_id, left_table, left_column, right_table, right_column, evidence]) AS v
         FROM lk_join_edges) AS x WHERE v IS NULL GROUP BY c
       UNION ALL SELECT 'edges.not_null', c, count(*) FROM (SELECT unnest(['job_id', 'table_name', 'direction', 'evidence']) AS c,
           unnest([job_id, table_name, direction, evidence]) AS v FROM lk_edges
         UNION ALL SELECT 'is_dynamic', CAST(is_dynamic AS VARCHAR) FROM lk_edges) AS x WHERE v IS NULL GROUP BY c
       UNION ALL SELECT 'tables.not_null', c, count(*) FROM (SELECT unnest(['database_name', 'name']) AS c,
           unnest([database_name, name]) AS v FROM lk_tables) AS x WHERE v IS NULL GROUP BY c
       UNION ALL SELECT 'jobs.not_null', c, count(*) FROM (SELECT unnest(['type', 'name']) AS c, unnest([type, name]) AS v
         FROM lk_jobs) AS x WHERE v IS NULL GROUP BY c
       UNION ALL SELECT 'extractions.not_null', c, count(*) FROM (SELECT unnest(['job_id', 'extraction']) AS c,
           unnest([job_id, extraction]) AS v FROM lk_extractions) AS x WHERE v IS NULL GROUP BY c
       UNION ALL SELECT 'artifacts.unique', job_id || ': ' || path, count(*) FROM lk_files GROUP BY job_id, path HAVING count(*) > 1
       UNION ALL SELECT DISTINCT 'artifacts.job', job_id, 1 FROM lk_files WHERE job_id NOT IN (SELECT id FROM lk_jobs)
       UNION ALL SELECT 'log.unique', event_id || ': ' || table_name, count(*) FROM del
         GROUP BY event_id, table_name HAVING count(*) > 1""",
)
def check_constraints(spark: SparkSession, sf: str) -> DataFrame:
    c = _small_catalog(spark, sf)
    edges = cut(c["job_table_edges"])
    joins = cut(view(spark, sf, "lk_join_edges", lk_edges=edges))
    return catalog.check_constraints(
        c["databases"], c["tables"], c["jobs"], edges, view(spark, sf, "lk_events"),
        view(spark, sf, "lk_extractions", lk_edges=edges, lk_join_edges=joins), joins,
        view(spark, sf, "lk_files").selectExpr("job_id", "path AS reference"), _deletions(spark, sf),
    )


@query(
    "table_readers_writers",
    f"""SELECT table_name, direction, part, string_agg(label, ', ' ORDER BY label) AS labels
        FROM (SELECT *, {page_of('table_name, direction', 'label')} FROM (
              SELECT DISTINCT e.table_name, e.direction, j.type || ': ' || j.name AS label
              FROM lk_edges AS e JOIN lk_jobs AS j ON j.id = e.job_id) AS x) AS y GROUP BY 1, 2, 3""",
)
def table_readers_writers(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.table_readers_writers(view(spark, sf, "lk_edges"), view(spark, sf, "lk_jobs"))


# ---------------------------------------------------------------- aggregations


@query(
    "group_findings",
    f"""{RECORDS_SQL} SELECT o.database_name, o.table_name, c.n AS n_events, o.event_name <> 'DeleteTable' AS first_is_batch,
        o.event_time AS first_time, o.event_id AS first_event_id, o.position AS first_position
        FROM ordered AS o JOIN (SELECT database_name, table_name, count(*) AS n FROM flagged GROUP BY 1, 2) AS c
          ON c.table_name = o.table_name AND c.database_name IS NOT DISTINCT FROM o.database_name
        WHERE o.nth = 1""",
)
def group_findings(spark: SparkSession, sf: str) -> DataFrame:
    return audit.group_findings(_flagged(spark, sf))


@query(
    "deletion_actors",
    f"""{RECORDS_SQL} SELECT database_name, table_name, event_name, coalesce(nullif(username, ''), 'unknown') AS actor,
        count(*) AS n FROM flagged GROUP BY 1, 2, 3, 4""",
)
def deletion_actors(spark: SparkSession, sf: str) -> DataFrame:
    return audit.deletion_actors(_flagged(spark, sf)).drop("first_seen")


@query(
    "deletion_span",
    f"""{RECORDS_SQL} SELECT database_name, table_name, min(event_time) AS first_time, max(event_time) AS last_time,
        coalesce(string_agg(DISTINCT nullif(region, ''), ', ' ORDER BY nullif(region, '')), '') AS regions FROM flagged GROUP BY 1, 2""",
)
def deletion_span(spark: SparkSession, sf: str) -> DataFrame:
    return audit.deletion_span(_flagged(spark, sf))


@query(
    "audit_totals",
    f"""{RECORDS_SQL} SELECT (SELECT count(*) FROM fresh) AS deletions,
        (SELECT count(*) FROM (SELECT DISTINCT database_name, table_name FROM flagged) AS a) AS flagged_tables,
        (SELECT count(*) FROM del WHERE regexp_matches(table_name, '{IGNORE_TABLES}')) AS ignored_deletions,
        (SELECT count(*) FROM (SELECT DISTINCT database_name, table_name FROM del WHERE regexp_matches(table_name, '{IGNORE_TABLES}')) AS b) AS ignored_tables""",
)
def audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    split = audit.split_ignored(_deletions(spark, sf), IGNORE_TABLES)
    return audit.audit_totals(split, view(spark, sf, "lk_seen"), *_edges(spark, sf))


@query(
    "tables_by_database",
    f"""SELECT coalesce(d.name, t.database_name) AS database_name, coalesce(t.part, 0) AS part, coalesce(t.tables, '') AS tables
        FROM lk_databases AS d FULL JOIN (SELECT database_name, part, string_agg(name, ', ' ORDER BY name) AS tables
          FROM (SELECT *, {page_of('database_name', 'name')} FROM (SELECT DISTINCT database_name, name FROM lk_tables) AS x) AS y
          GROUP BY 1, 2) AS t ON t.database_name = d.name""",
)
def tables_by_database(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.tables_by_database(view(spark, sf, "lk_databases"), view(spark, sf, "lk_tables"))


@query(
    "merge_arrow_jobs",
    f"""SELECT source, target, part, string_agg(label, ', ' ORDER BY label) AS jobs FROM (SELECT *, {page_of('source, target', 'label')} FROM (
         SELECT DISTINCT r.table_name AS source, w.table_name AS target, coalesce(j.type || ': ' || j.name, r.job_id) AS label
         FROM lk_edges AS r JOIN lk_edges AS w ON w.job_id = r.job_id AND r.direction = 'read' AND w.direction = 'write'
         LEFT JOIN lk_jobs AS j ON j.id = r.job_id WHERE r.table_name <> w.table_name) AS x) AS y GROUP BY 1, 2, 3""",
)
def merge_arrow_jobs(spark: SparkSession, sf: str) -> DataFrame:
    flows = dep.with_label(diagram.job_flows(view(spark, sf, "lk_edges")), view(spark, sf, "lk_jobs"))
    return listed_text(flows, ["source", "target"], "label", "jobs")


ERD = cs.erd(WATCH)


@query(
    "erd_join_columns",
    f"""WITH {ERD} SELECT f.fdb AS focus_database, f.ft AS focus_table, c.t AS table_name, c.part,
        string_agg(c.column_name, ', ' ORDER BY c.column_name) AS columns
        FROM (SELECT *, {page_of('fid, t', 'column_name')} FROM cols) AS c JOIN f USING (fid) GROUP BY 1, 2, 3, 4""",
)
def erd_join_columns(spark: SparkSession, sf: str) -> DataFrame:
    return diagram.erd_join_columns(*_erd_inputs(spark, sf))


def _erd_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return view(spark, sf, "lk_watch"), view(spark, sf, "lk_join_edges"), view(spark, sf, "lk_tables")


BLAST = """SELECT f.fdb AS focus_database, f.ft AS focus_table,
  (SELECT count(*) FROM (SELECT job_id FROM cj WHERE cj.fid = f.fid UNION SELECT job_id FROM jr WHERE jr.fid = f.fid) AS u) AS jobs_broken,
  (SELECT count(*) FROM ct WHERE ct.fid = f.fid) AS tables_orphaned FROM f"""


@query("blast_radius", f"WITH {cs.closure(WATCH)}, {cs.JOIN_REFS} {BLAST}")
def blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    edges, joins = _edges(spark, sf)
    return dep.blast_radius(walk(edges, view(spark, sf, "lk_watch")), joins)


ALL_TABLES = "SELECT database_name, name AS table_name FROM lk_tables"


@query("all_tables_blast_radius", f"WITH {cs.closure(ALL_TABLES)}, {cs.JOIN_REFS} {BLAST}")
def all_tables_blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    edges, joins = _edges(spark, sf)
    foci = view(spark, sf, "lk_tables").selectExpr("database_name", "name AS table_name")
    return dep.blast_radius(walk(edges, foci), joins)


@query(
    "lineage_layers",
    f"""WITH {cs.closure(WATCH)}, {cs.KNOWN} SELECT f.fdb AS focus_database, f.ft AS focus_table, ct.hop AS layer,
        coalesce(ct.db, '') AS sort_database, ct.t AS table_name,
        {cs.table_key('coalesce(ct.db, CASE WHEN ct.t <> f.ft THEN kd.db END)', 'ct.t')} AS table_key
        FROM ct JOIN f USING (fid) LEFT JOIN kd ON kd.name = ct.t""",
)
def lineage_layers(spark: SparkSession, sf: str) -> DataFrame:
    result = walk(view(spark, sf, "lk_edges"), view(spark, sf, "lk_watch"))
    return dep.lineage_layers(result, view(spark, sf, "lk_tables"))


# ---------------------------------------------------------------- graph queries

CLOSURE = f"""WITH {cs.closure(WATCH)}, rows_ AS (
  SELECT f.fdb AS focus_database, f.ft AS focus_table, 'table' AS kind, hop, db AS database_name, t AS node FROM ct JOIN f USING (fid)
  UNION ALL SELECT f.fdb, f.ft, 'job', hop, NULL, job_id FROM cj JOIN f USING (fid))
SELECT * FROM rows_"""


@query("dependents_closure", CLOSURE)
def dependents_closure(spark: SparkSession, sf: str) -> DataFrame:
    return dep.dependents(view(spark, sf, "lk_edges"), view(spark, sf, "lk_watch"))


@query("direct_dependents", CLOSURE + " WHERE hop = 1")
def direct_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return dep.dependents(view(spark, sf, "lk_edges"), view(spark, sf, "lk_watch"), max_hops=1).where("hop = 1")


@query("transitive_dependents", CLOSURE + " WHERE hop > 1")
def transitive_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return dep.dependents(view(spark, sf, "lk_edges"), view(spark, sf, "lk_watch")).where("hop > 1")


REPORTS = cs.reports(WATCH)


def _reports(spark: SparkSession, sf: str) -> check_delete.Reports:
    edges, joins = _edges(spark, sf)
    return check_delete.dependents_reports(
        view(spark, sf, "lk_watch"), edges, joins, view(spark, sf, "lk_jobs"), view(spark, sf, "lk_tables")
    )


@query(
    "dependents_report",
    f"""WITH {REPORTS} SELECT fdb AS focus_database, ft AS focus_table, section, hop, job_id, label, db AS database_name,
        t AS table_name, evidence FROM items""",
)
def dependents_report(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).items


@query(
    "report_order",
    f"""WITH {REPORTS} SELECT fdb AS focus_database, ft AS focus_table, in_catalog, has_dependents, n_direct_jobs,
        n_direct_tables, n_join_refs, n_transitive_jobs, n_transitive_tables, jobs_broken, tables_orphaned FROM summary""",
)
def report_order(spark: SparkSession, sf: str) -> DataFrame:
    summary = _reports(spark, sf).summary
    return summary.orderBy(F.expr("coalesce(focus_database, '')"), "focus_table")


@query(
    "format_dependents",
    f"WITH {REPORTS} SELECT fdb AS focus_database, ft AS focus_table, section, line FROM lines",
)
def format_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).lines.select("focus_database", "focus_table", "section", "line")


@query(
    "lineage_dag",
    f"WITH {cs.dag(WATCH)} SELECT f.fdb AS focus_database, f.ft AS focus_table, layer, t AS table_name FROM dp JOIN f USING (fid)",
)
def lineage_dag(spark: SparkSession, sf: str) -> DataFrame:
    dag = diagram.lineage_dag(view(spark, sf, "lk_edges"), view(spark, sf, "lk_watch"))
    return diagram.dag_tables(dag)


@query(
    "diagram_databases",
    f"""WITH {cs.dag(WATCH)} SELECT f.fdb AS focus_database, f.ft AS focus_table, dd.layer, dd.t AS table_name,
        dd.db AS database_name FROM dd JOIN f USING (fid)""",
)
def diagram_databases(spark: SparkSession, sf: str) -> DataFrame:
    edges = view(spark, sf, "lk_edges")
    dag = diagram.lineage_dag(edges, view(spark, sf, "lk_watch"))
    return named(diagram.database_masks(dag, view(spark, sf, "lk_tables")), dag.foci)


@query(
    "dag_arrows",
    f"""WITH {cs.dag(WATCH)} SELECT f.fdb AS focus_database, f.ft AS focus_table, x.source_key, x.target_key, x.part, x.jobs
        FROM (SELECT fid, source_key, target_key, part, string_agg(label, ', ' ORDER BY label) AS jobs
          FROM (SELECT *, {page_of('fid, source_key, target_key', 'label')} FROM (
          SELECT DISTINCT r.fid, {cs.table_key('a.db', 'a.t')} AS source_key, {cs.table_key('b.db', 'b.t')} AS target_key,
                 coalesce(j.type || ': ' || j.name, r.job_id) AS label
          FROM de AS r JOIN de AS w ON w.fid = r.fid AND w.job_id = r.job_id AND r.direction = 'read' AND w.direction = 'write' AND r.t <> w.t
          JOIN dd AS a ON a.fid = r.fid AND a.t = r.t JOIN dd AS b ON b.fid = w.fid AND b.t = w.t
          LEFT JOIN lk_jobs AS j ON j.id = r.job_id) AS y) AS z GROUP BY 1, 2, 3, 4) AS x JOIN f USING (fid)""",
)
def dag_arrows(spark: SparkSession, sf: str) -> DataFrame:
    edges = view(spark, sf, "lk_edges")
    dag = diagram.lineage_dag(edges, view(spark, sf, "lk_watch"))
    return diagram.dag_arrows(dag, view(spark, sf, "lk_jobs"), view(spark, sf, "lk_tables"))


VERDICT = f"""WITH {cs.foci(WATCH)}, {cs.JOIN_REFS}, hd AS (
  SELECT f.fid FROM f JOIN lk_edges AS e ON e.table_name = f.ft AND e.direction = 'read'
    AND (f.fdb IS NULL OR e.database_name IS NULL OR e.database_name = f.fdb)
  UNION SELECT fid FROM jr)"""


@query(
    "has_dependents",
    VERDICT + " SELECT fdb AS database_name, ft AS table_name, fid IN (SELECT fid FROM hd) AS has_dependents FROM f",
)
def has_dependents(spark: SparkSession, sf: str) -> DataFrame:
    return dep.with_dependents_flag(view(spark, sf, "lk_watch"), *_edges(spark, sf))


@query(
    "delete_verdict",
    f"""{VERDICT.replace(WATCH, ALL_TABLES)} SELECT fdb AS database_name, ft AS table_name, fid IN (SELECT fid FROM hd) AS has_dependents,
        fid NOT IN (SELECT fid FROM hd) AS safe FROM f""",
)
def delete_verdict(spark: SparkSession, sf: str) -> DataFrame:
    foci = view(spark, sf, "lk_tables").selectExpr("database_name", "name AS table_name")
    return dep.delete_verdicts(foci, *_edges(spark, sf))


@query(
    "join_diagram",
    f"""WITH {ERD}, keyed AS (SELECT fid, t, {cs.table_key('db', 't')} AS key FROM cards),
        lab AS (SELECT DISTINCT fe.fid, a.key AS left_key, fe.left_column, b.key AS right_key, fe.right_column,
                       coalesce(j.type || ': ' || j.name, fe.job_id) AS label
                FROM fe JOIN keyed AS a ON a.fid = fe.fid AND a.t = fe.left_table
                JOIN keyed AS b ON b.fid = fe.fid AND b.t = fe.right_table LEFT JOIN lk_jobs AS j ON j.id = fe.job_id)
        SELECT f.fdb AS focus_database, f.ft AS focus_table, 'arrow' AS kind, left_key, left_column, right_key, right_column,
               part, string_agg(label, ', ' ORDER BY label) AS detail
        FROM (SELECT *, {page_of('fid, left_key, left_column, right_key, right_column', 'label')} FROM lab) AS p JOIN f USING (fid)
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
        UNION ALL SELECT f.fdb, f.ft, 'partition', p.t, p.column_name, NULL, NULL, 0, CAST(p.position AS VARCHAR) FROM parts AS p JOIN f USING (fid)
        UNION ALL SELECT f.fdb, f.ft, 'column', c.t, c.column_name, NULL, NULL, 0, NULL FROM cols AS c JOIN f USING (fid)""",
)
def join_diagram(spark: SparkSession, sf: str) -> DataFrame:
    foci, joins, tables = _erd_inputs(spark, sf)
    joins = diagram.focus_edges(foci, joins)
    arrows = diagram.erd_arrows(foci, joins, view(spark, sf, "lk_jobs"), tables).selectExpr(
        "focus_database", "focus_table", "'arrow' AS kind", "left_key", "left_column", "right_key",
        "right_column", "part", "jobs AS detail",
    )
    rows = diagram.erd_rows(foci, joins, tables).selectExpr(
        "focus_database", "focus_table", "if(is_partition, 'partition', 'column') AS kind",
        "table_name AS left_key", "column_name AS left_column", "CAST(NULL AS STRING) AS right_key",
        "CAST(NULL AS STRING) AS right_column", "0 AS part", "CAST(position AS STRING) AS detail",
    )
    return arrows.unionByName(rows)


# ---------------------------------------------------------------- order, sets


@query(
    "last_record_per_key",
    f"{RECORDS_SQL}, {LATEST} SELECT event_id, table_name, database_name, event_name, event_time, username, region FROM last",
)
def last_record_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return audit.last_per_key(_fresh(spark, sf)).drop("position")


@query(
    "first_value_per_key",
    """SELECT table_name, database_name FROM (
         SELECT table_name, database_name, row_number() OVER (PARTITION BY table_name ORDER BY job_id, database_name) AS nth
         FROM lk_edges WHERE database_name <> '') AS x WHERE nth = 1""",
)
def first_value_per_key(spark: SparkSession, sf: str) -> DataFrame:
    named = view(spark, sf, "lk_edges").where("database_name <> ''")
    first = F.min_by("database_name", F.struct("job_id", "database_name"))
    return named.groupBy("table_name").agg(first.alias("database_name"))


@query(
    "first_n_tables",
    "SELECT database_name, name FROM lk_tables ORDER BY name, database_name LIMIT 50",
)
def first_n_tables(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "lk_tables").select("database_name", "name").orderBy("name", "database_name").limit(50)


@query(
    "new_jobs_except",
    """SELECT DISTINCT job_id FROM lk_edges WHERE direction = 'read'
       EXCEPT SELECT job_id FROM lk_edges WHERE direction = 'read' AND table_name = 'hub'""",
)
def new_jobs_except(spark: SparkSession, sf: str) -> DataFrame:
    reads = view(spark, sf, "lk_edges").where("direction = 'read'")
    visited = reads.where("table_name = 'hub'").select("job_id")
    return reads.select("job_id").distinct().join(visited, "job_id", "left_anti")


# ---------------------------------------------------------------- audit


@query(
    "request_parameters",
    f"""{RECORDS_SQL} SELECT event_id, event_time, parameters IS NOT NULL AS usable,
        json_extract_string(parameters, '$.databaseName') AS database_name FROM req""",
)
def request_parameters(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "lk_events").where(F.col("event_source") == audit.EVENT_SOURCE)
    parsed = events.withColumn("parameters", audit.request_parameters(F.col("cloud_trail_event")))
    return parsed.select(
        "event_id", "event_time", F.col("parameters").isNotNull().alias("usable"),
        F.try_variant_get("parameters", "$.databaseName", "string").alias("database_name"),
    )


@query("parse_deletions", f"{RECORDS_SQL} SELECT {DELETION_COLUMNS} FROM del")
def parse_deletions(spark: SparkSession, sf: str) -> DataFrame:
    return _deletions(spark, sf)


@query(
    "malformed_events",
    f"""{RECORDS_SQL} SELECT r.event_id, r.event_name, r.event_time,
        CASE WHEN r.parameters IS NULL OR r.event_id IS NULL THEN 'malformed' ELSE 'no tables' END AS reason
        FROM req AS r LEFT JOIN strings AS s ON s.event_id = r.event_id
        WHERE r.parameters IS NULL OR r.event_id IS NULL OR coalesce(len(s.texts), 0) = 0""",
)
def malformed_events(spark: SparkSession, sf: str) -> DataFrame:
    return audit.malformed_events(view(spark, sf, "lk_events"))


@query("audit_records", f"{RECORDS_SQL}, {LATEST} SELECT * FROM rec")
def audit_records(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_records(_fresh(spark, sf), *_edges(spark, sf))


WINDOW_SQL = RECORDS_SQL.replace(
    "FROM lk_events WHERE",
    f"FROM lk_events WHERE event_name IN ('DeleteTable', 'BatchDeleteTable') AND event_time >= {NOW} - INTERVAL {HOURS} HOUR AND",
)


def _findings(spark: SparkSession, sf: str, show_all: bool) -> DataFrame:
    return audit_run.findings(
        view(spark, sf, "lk_events"), view(spark, sf, "lk_seen"), *_edges(spark, sf), IGNORE_TABLES, show_all, HOURS, now()
    )


@query("audit_findings", f"{WINDOW_SQL} SELECT {DELETION_COLUMNS} FROM flagged")
def audit_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf, show_all=False)


@query(
    "audit_findings_all",
    WINDOW_SQL.replace("WHERE event_id NOT IN (SELECT event_id FROM lk_seen)", "") + f" SELECT {DELETION_COLUMNS} FROM flagged",
)
def audit_findings_all(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the look-back whether or not they were reported before."""
    return _findings(spark, sf, show_all=True)


FINDING_LINES = f"""{WINDOW_SQL}, heads AS (
  SELECT database_name, table_name, 0 AS section, 'DELETED WITH DEPENDENTS: ' || {cs.table_key('database_name', 'table_name')} AS line
  FROM flagged GROUP BY database_name, table_name
  UNION ALL
  SELECT database_name, table_name, 1, '  ' || CAST(sum(n) AS BIGINT) || ' deletion(s): ' || string_agg(label || ' (' || n || ')', ', ' ORDER BY first_nth)
  FROM (SELECT database_name, table_name, event_name || ' by ' || coalesce(nullif(username, ''), 'unknown') AS label,
               count(*) AS n, min(nth) AS first_nth FROM ordered GROUP BY 1, 2, 3) AS a GROUP BY database_name, table_name
  UNION ALL
  SELECT database_name, table_name, 2, '  when: ' || CASE WHEN a = b THEN a ELSE a || ' to ' || b END
         || CASE WHEN regions <> '' THEN ' (' || regions || ')' ELSE '' END
  FROM (SELECT database_name, table_name, strftime(min(event_time), '%Y-%m-%dT%H:%M:%S') AS a,
               strftime(max(event_time), '%Y-%m-%dT%H:%M:%S') AS b,
               coalesce(string_agg(DISTINCT nullif(region, ''), ', ' ORDER BY nullif(region, '')), '') AS regions
        FROM flagged GROUP BY 1, 2) AS s
  UNION ALL SELECT database_name, table_name, 3, '' FROM flagged GROUP BY database_name, table_name)"""


REPORT_LINES = FINDING_LINES + ", " + cs.reports("SELECT database_name, table_name FROM flagged") + f""", report AS (
    SELECT section, line FROM heads UNION ALL SELECT section + 10, line FROM lines
    UNION ALL SELECT 99, '' FROM f
    UNION ALL SELECT 0, 'audit: ' || (SELECT count(*) FROM fresh) || ' glue deletion(s) in the last {HOURS}h, '
      || (SELECT count(*) FROM f) || ' table(s) deleted with dependents'
    UNION ALL SELECT 0, ''
    UNION ALL SELECT 0, 'none had dependents' WHERE NOT EXISTS (SELECT 1 FROM flagged))"""


@query("format_findings", f"{REPORT_LINES} SELECT section, line FROM report")
def format_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).lines.select("section", "line")


def _audit(spark: SparkSession, sf: str) -> audit_run.AuditRun:
    edges, joins = _edges(spark, sf)
    return audit_run.audit_run(
        view(spark, sf, "lk_events"), view(spark, sf, "lk_seen"), edges, joins,
        view(spark, sf, "lk_jobs"), view(spark, sf, "lk_tables"), HOURS, IGNORE_TABLES, now=now(),
    )


@query("write_audit_report", f"{REPORT_LINES} SELECT line FROM report")
def write_audit_report(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "report")
    snapshot.write_report(_audit(spark, sf).lines, path, *audit_run.REPORT_ORDER)
    return spark.read.text(path).withColumnRenamed("value", "line")


# ---------------------------------------------------------------- streaming


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events view, read as a stream of the files it is landed in."""
    landed = new_path(spark, "events")
    events = view(spark, sf, "lk_events")
    events.write.parquet(landed)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return stream.read_event_stream(spark, landed, schema=schema)


def _run_to_end(df: DataFrame) -> DataFrame:
    """Run a stream over everything that has landed and return what it wrote."""
    spark = df.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    started = df.writeStream.format("parquet").option("checkpointLocation", state).option("path", out)
    started.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("stream_deletions", f"{RECORDS_SQL} SELECT {DELETION_COLUMNS} FROM del")
def stream_deletions(spark: SparkSession, sf: str) -> DataFrame:
    return _run_to_end(stream.stream_deletions(_event_stream(spark, sf)))


@query("stream_dedup", f"{RECORDS_SQL} SELECT DISTINCT event_id, table_name FROM del")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    # The look-back covers all landed events, so that no event counts as late.
    deduplicated = stream.stream_dedup(stream.stream_deletions(_event_stream(spark, sf)), hours=24 * 366)
    return _run_to_end(deduplicated).select("event_id", "table_name")


STREAM_RECORDS = RECORDS_SQL.replace("WHERE event_id NOT IN (SELECT event_id FROM lk_seen)", "")


@query(
    "stream_audit",
    f"{STREAM_RECORDS}, {LATEST} SELECT event_id, database_name, table_name, event_name, username, region, flagged FROM rec",
)
def stream_audit(spark: SparkSession, sf: str) -> DataFrame:
    root, log = new_path(spark, "catalog"), new_path(spark, "log")
    snapshot.write_snapshot(spark, root, _all_tables(_small_catalog(spark, sf)))
    running = stream.stream_audit(
        _event_stream(spark, sf), root, log, new_path(spark, "reports"), new_path(spark, "state"),
        ignore_tables=IGNORE_TABLES,
    )
    running.awaitTermination()
    return snapshot.read_audit_log(spark, log).select(
        "event_id", "database_name", "table_name", "event_name", "username", "region", "flagged"
    )


# ---------------------------------------------------------------- extraction


def _stand_in_extractor() -> ex.Extractor:
    """An extractor that names one table after the job.

    Its first answer for every prompt whose length is odd is broken.
    """

    def extract(name: str, pages: Iterator[str]) -> str:
        length, last = 0, ""
        for last in pages:
            length += len(last)
        if "does not match the schema" not in last and length % 2:
            return "not json"
        return f'{{"table_edges":[{{"database":null,"table":"{name}","direction":"read","is_dynamic":false,"evidence":"x"}}]}}'

    return extract


@query(
    "extract_edges",
    f"""WITH {OWN_FILES} SELECT o.job_id, j.name AS table_name, 'read' AS direction
        FROM (SELECT DISTINCT job_id FROM own) AS o JOIN lk_jobs AS j ON j.id = o.job_id""",
)
def extract_edges(spark: SparkSession, sf: str) -> DataFrame:
    prompts = cut(ex.render_prompt(view(spark, sf, "lk_jobs"), _authored(spark, sf)))
    output = rb.by_extractor(_stand_in_extractor())(view(spark, sf, "lk_jobs"), prompts)
    return ex.table_edges(output.where("valid")).select("job_id", "table_name", "direction")


def _fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Canned extractor output by job name."""
    jobs = view(spark, sf, "lk_jobs").selectExpr("id AS job_id", "name")
    return view(spark, sf, "lk_extractions").join(jobs, "job_id").select("name", "extraction")


def _fixtures_of(spark: SparkSession, sf: str, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Canned extractor output of the jobs of these names.

    The jobs are looked up first and only their edges are taken, so no other job's output is made. A view's rows of a job come
    from that job's edges alone.
    """
    jobs = cut(view(spark, sf, "lk_jobs").selectExpr("id AS job_id", "name").join(names, "name", "left_semi"))
    ids = jobs.select("job_id")
    few = edges.join(ids, "job_id", "left_semi")
    own = view(spark, sf, "lk_extractions", lk_edges=few).join(ids, "job_id", "left_semi")
    return own.join(jobs, "job_id").select("name", "extraction")


@query(
    "fixture_extractor",
    f"""WITH {EXTRACTED_SQL}, outputs AS (
          SELECT job_id, bool_and(valid) AS valid, CASE WHEN count(DISTINCT extraction) = 1 THEN min(extraction) END AS only_output FROM val GROUP BY 1),
        te AS (SELECT job_id, count(*) AS n FROM (SELECT DISTINCT * FROM xt) AS a GROUP BY 1),
        je AS (SELECT job_id, count(*) AS n FROM (SELECT DISTINCT * FROM xj) AS a GROUP BY 1)
        SELECT j.id AS job_id, j.name, coalesce(o.valid, false) AS valid, o.only_output,
          CASE WHEN o.valid THEN coalesce(te.n, 0) END AS n_table_edges, CASE WHEN o.valid THEN coalesce(je.n, 0) END AS n_join_edges,
          CASE WHEN o.job_id IS NULL THEN 'no fixture named ' || j.name WHEN NOT o.valid THEN 'does not match the schema' END AS reason
        FROM lk_jobs AS j LEFT JOIN outputs AS o ON o.job_id = j.id LEFT JOIN te ON te.job_id = j.id LEFT JOIN je ON je.job_id = j.id""",
)
def fixture_extractor(spark: SparkSession, sf: str) -> DataFrame:
    fixtures = cut(_fixtures(spark, sf))
    found = cut(ex.fixture_extractions(view(spark, sf, "lk_jobs"), fixtures))
    counted = F.when(F.col("valid"), F.expr("coalesce(size(edges), 0)")).cast("bigint")
    sizes = found
    for kind in ("table", "join"):
        loose = ex.EXTRACTION.replace("is_dynamic:boolean", "is_dynamic:string")
        sizes = sizes.withColumn("edges", F.array_distinct(F.from_json("extraction", loose)[f"{kind}_edges"])).withColumn(f"n_{kind}_edges", counted)
    several = fixtures.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("name").alias("merged_name"))
    only = F.when(F.col("merged_name").isNull(), F.col("extraction")).alias("only_output")
    return sizes.join(several, F.expr("name = merged_name"), "left").select(
        "job_id", "name", "valid", only, "n_table_edges", "n_join_edges", "reason"
    )


@query(
    "file_reader_plugin",
    f"""WITH {PACKAGE_MEMBERS} SELECT 'lambda' AS kind, count(*) AS n FROM pm WHERE NOT test AND NOT dependency
        UNION ALL SELECT 'glue', sum(1 + CASE WHEN contains(g.default_arguments, 'lib.zip') THEN 1 ELSE 0 END
                                     - CASE WHEN g.command IS NULL THEN 1 ELSE 0 END)
        FROM lk_glue_jobs AS g JOIN documents AS d ON g.name = 'etl_' || d.doc_id
        WHERE g.command IS NOT NULL OR contains(g.default_arguments, 'lib.zip')""",
)
def file_reader_plugin(spark: SparkSession, sf: str) -> DataFrame:
    objects = base(spark, sf, "documents").selectExpr(
        "concat('/lake/code/etl_', doc_id, '.py') AS location", "CAST(text AS BINARY) AS content"
    )
    files = code.source_files(
        {"glue": (view(spark, sf, "lk_glue_jobs"), objects, "/lake"), "lambda": (cut(_packages(spark, sf)),)}
    )
    kind = "if(path LIKE 's3://%', 'glue', 'lambda') AS kind"
    return files.selectExpr(kind).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Jobs whose fixture output has any invalid part keep their earlier edges.
SYNC_SQL = f"""WITH {KEYS_SQL}, {CACHED_SQL}, {EXTRACTED_SQL},
eligible AS (SELECT id FROM lk_jobs WHERE NOT regexp_matches(name, '{IGNORE_JOBS}')),
rejected AS (SELECT DISTINCT job_id FROM val WHERE NOT valid),
done AS MATERIALIZED (
  SELECT s.job_id FROM stale AS s WHERE s.job_id IN (SELECT id FROM eligible)
    AND s.job_id IN (SELECT job_id FROM val) AND s.job_id NOT IN (SELECT job_id FROM rejected)),
te AS MATERIALIZED (SELECT DISTINCT x.* FROM xt AS x JOIN done USING (job_id)),
known AS MATERIALIZED (SELECT DISTINCT job_id, table_name FROM te),
je AS MATERIALIZED (
  SELECT DISTINCT x.* FROM xj AS x JOIN done USING (job_id)
  JOIN known AS l ON l.job_id = x.job_id AND l.table_name = x.left_table
  JOIN known AS r ON r.job_id = x.job_id AND r.table_name = x.right_table),
synced AS (
  SELECT e.job_id, e.database_name, e.table_name, e.direction FROM lk_edges AS e LEFT JOIN done AS d ON d.job_id = e.job_id WHERE d.job_id IS NULL
  UNION ALL SELECT job_id, database_name, table_name, direction FROM te),
synced_joins AS (
  SELECT e.job_id, left_table, right_table FROM lk_join_edges AS e LEFT JOIN done AS d ON d.job_id = e.job_id WHERE d.job_id IS NULL
  UNION ALL SELECT job_id, left_table, right_table FROM je)"""


def _synced(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    # Written once: the join edges are made from the edges, and both are read again.
    edges = cut(view(spark, sf, "lk_edges"))
    joins = view(spark, sf, "lk_join_edges", lk_edges=edges)
    stored = cut(_stored_keys(cut(_fresh_keys(spark, sf)), spark, sf))
    none = "CAST(NULL AS STRING)"
    old = {
        "job_extractions": stored.selectExpr(
            "job_id", "cache_key", f"{none} AS model", f"{none} AS prompt_version",
            f"{none} AS extraction", "CAST(NULL AS TIMESTAMP) AS extracted_at",
        ),
        "job_table_edges": edges,
        "table_join_edges": joins,
    }
    return rb.sync_edges(
        view(spark, sf, "lk_jobs"), _authored(spark, sf), old, rb.by_fixture(partial(_fixtures_of, spark, sf, edges)),
        MODEL, PROMPT_VERSION, IGNORE_JOBS,
    )


@query(
    "sync_edges",
    f"""{SYNC_SQL} SELECT 'edge' AS kind, job_id, database_name, table_name AS a, direction AS b FROM synced
        UNION ALL SELECT 'join', job_id, NULL, left_table, right_table FROM synced_joins
        UNION ALL SELECT 'extracted', job_id, NULL, NULL, NULL FROM done
        UNION ALL SELECT 'stored', job_id, NULL, NULL, NULL FROM (
          SELECT job_id FROM stored WHERE job_id NOT IN (SELECT job_id FROM done) UNION ALL SELECT job_id FROM done) AS z""",
)
def sync_edges(spark: SparkSession, sf: str) -> DataFrame:
    out = _synced(spark, sf)
    none = "CAST(NULL AS STRING)"
    return (
        out["job_table_edges"].selectExpr("'edge' AS kind", "job_id", "database_name", "table_name AS a", "direction AS b")
        .unionByName(
            out["table_join_edges"].selectExpr(
                "'join' AS kind", "job_id", f"{none} AS database_name", "left_table AS a", "right_table AS b"
            )
        )
        .unionByName(
            out["extracted"].selectExpr(
                "'extracted' AS kind", "job_id", f"{none} AS database_name", f"{none} AS a", f"{none} AS b"
            )
        )
        .unionByName(
            out["job_extractions"].selectExpr(
                "'stored' AS kind", "job_id", f"{none} AS database_name", f"{none} AS a", f"{none} AS b"
            )
        )
    )


# A first rebuild: nothing is stored, every job with valid canned output is extracted.
REBUILD_SQL = f"""WITH {OWN_FILES}, {URIS_SQL}, {EXTRACTED_SQL}, {JOBS_SQL},
numbered AS (SELECT j.id AS old_id, n.id, n.name FROM lk_jobs AS j JOIN nj AS n ON n.type = j.type AND n.name = j.name),
done AS MATERIALIZED (
  SELECT DISTINCT n.id AS job_id, n.old_id FROM numbered AS n JOIN own AS o ON o.job_id = n.old_id
  WHERE NOT regexp_matches(n.name, '{IGNORE_JOBS}') AND n.old_id IN (SELECT job_id FROM val)
    AND n.old_id NOT IN (SELECT job_id FROM val WHERE NOT valid)),
te AS MATERIALIZED (
  SELECT DISTINCT d.job_id, x.database_name, x.table_name, x.direction, x.is_dynamic, x.evidence FROM xt AS x JOIN done AS d ON d.old_id = x.job_id),
known AS (SELECT DISTINCT job_id, table_name FROM te),
je AS MATERIALIZED (
  SELECT DISTINCT d.job_id, x.left_database, x.left_table, x.left_column, x.right_database, x.right_table, x.right_column, x.evidence
  FROM xj AS x JOIN done AS d ON d.old_id = x.job_id JOIN known AS l ON l.job_id = d.job_id AND l.table_name = x.left_table
  JOIN known AS r ON r.job_id = d.job_id AND r.table_name = x.right_table)
""" + " UNION ALL ".join(
    content_sql(source, table)
    for table, source in {
        "databases": "lk_databases", "tables": "lk_tables", "jobs": "nj", "job_artifacts": "arts", "job_extractions": "done",
        "job_table_edges": "te", "table_join_edges": "je", "extracted": "done",
    }.items()
)


@query("rebuild_catalog", REBUILD_SQL)
def rebuild_catalog(spark: SparkSession, sf: str) -> DataFrame:
    root = new_path(spark, "catalog")
    raw = {
        "databases": view(spark, sf, "lk_databases"), "tables": view(spark, sf, "lk_tables"),
        "glue_jobs": view(spark, sf, "lk_glue_jobs"), "lambda_functions": view(spark, sf, "lk_functions"),
    }
    ids = view(spark, sf, "lk_jobs").select(
        F.col("id").alias("job_id"), names.job_id(F.col("type"), F.col("name")).alias("new_id")
    )
    files = _authored(spark, sf).join(ids, "job_id").selectExpr("new_id AS job_id", "path", "contents")
    fixtures = partial(_fixtures_of, spark, sf, view(spark, sf, "lk_edges"))
    extracted = rb.rebuild(spark, root, raw, files, rb.by_fixture(fixtures), MODEL, PROMPT_VERSION, IGNORE_JOBS)
    tables = {**snapshot.read_snapshot(spark, root), "extracted": extracted}
    return reduce(DataFrame.unionByName, (content_of(tables[name], name) for name in CONTENT))


