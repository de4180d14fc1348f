"""Catalog, inventory and event views over the driver's tables.

Each view is one portable SELECT that Spark and DuckDB read alike, over whole tables: no row
is filtered out to make a query cheap. Rows that should be absent from a view (a table missing
from the catalog, a job without a row) are kept under another name instead.

Orders are jobs, line items are the table edges of those jobs, parts are tables, documents
are source files, events are audit-trail events. Jobs and tables fall into domains of 450
orders and 60 parts, so the walk from an ordinary table stays inside one domain however large
the data is; the table ``hub`` is read by a tenth of all reads and reaches everything.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

# Job to table edges; a job reads layer n and writes layer n + 1, some write back to layer 0.
VIEWS["lk_edges"] = """
SELECT DISTINCT 'job_' || o AS job_id,
       CASE WHEN s % 9 = 0 THEN NULL WHEN hub THEN 'db_0' ELSE 'db_' || (k % 3) END AS database_name,
       CASE WHEN hub THEN 'hub' ELSE 't_' || (k - k % 2) END AS table_name,
       direction, (s % 5 = 0) AS is_dynamic,
       direction || ' t_' || (k - k % 2) AS evidence
FROM (SELECT o, s, direction, hub,
             60 * domain + 6 * (p % 10)
               + CASE WHEN direction = 'read' THEN layer WHEN o % 17 = 0 THEN 0 ELSE layer + 1 END AS k
      FROM (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s,
                   CASE WHEN l_linenumber % 3 = 1 THEN 'write' ELSE 'read' END AS direction,
                   (l_linenumber % 3 <> 1 AND l_quantity > 45) AS hub,
                   CAST(FLOOR(l_orderkey / 450) AS BIGINT) AS domain,
                   l_orderkey % 5 AS layer
            FROM lineitem) AS a) AS b
"""

# Catalog tables; every seventh has a name no job uses, every fiftieth an unlisted database.
VIEWS["lk_tables"] = """
SELECT CASE WHEN p_partkey % 50 = 3 THEN 'db_ghost' ELSE 'db_' || (p_partkey % 3) END AS database_name,
       CASE WHEN p_partkey % 7 = 0 THEN 'x_' ELSE 't_' END || (p_partkey - p_partkey % 2) AS name,
       p_type AS table_type, p_brand AS owner, p_size AS retention,
       '{"Columns":[{"Name":"id","Type":"bigint"},{"Name":"' || replace(p_name, ' ', '_')
         || '","Type":"string","Comment":"from ' || p_brand || '"}],"Location":"s3://lake/'
         || p_partkey || '"}' AS storage_descriptor,
       CASE WHEN p_partkey % 3 = 0 THEN '[{"Name":"ds","Type":"string"},{"Name":"c_1","Type":"int"}]'
            WHEN p_partkey % 3 = 1 THEN '[]' END AS partition_keys
FROM part
"""

# Listed databases; those above db_2 have no tables.
VIEWS["lk_databases"] = """
SELECT 'db_' || c_custkey AS name, c_name AS description FROM customer
"""

# Catalog jobs; every eleventh has an id that no edge uses.
VIEWS["lk_jobs"] = """
SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'gone_' ELSE 'job_' END || o_orderkey AS id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'lambda' ELSE 'glue' END AS type,
       'etl_' || o_orderkey AS name, CASE WHEN o_orderstatus = 'F' THEN '3' END AS runtime
FROM orders
"""

# Raw join edges: each read joined to the job's next read; returned items name a dataframe.
VIEWS["lk_join_edges"] = """
SELECT job_id, left_database, left_table, left_column, right_database, right_table,
       right_column, left_table || ' = ' || right_table AS evidence
FROM (SELECT job_id, database_name AS left_database, table_name AS left_table,
             'c_' || (length(evidence) % 4) AS left_column,
             lead(database_name) OVER w AS right_database,
             lead(table_name) OVER w AS right_table,
             'c_' || (lead(length(evidence)) OVER w % 3) AS right_column
      FROM lk_edges WHERE direction = 'read'
      WINDOW w AS (PARTITION BY job_id ORDER BY table_name, coalesce(database_name, ''), is_dynamic, evidence)) AS a
WHERE right_table IS NOT NULL
UNION ALL
SELECT DISTINCT 'job_' || l_orderkey, CAST(NULL AS VARCHAR(20)), 'df_' || l_linenumber, 'id', 'db_0',
       't_' || (l_partkey - l_partkey % 2), 'id', 'df merge'
FROM lineitem
"""

# Audit-trail events: null ids, foreign sources, broken payloads, members that are no strings.
VIEWS["lk_events"] = """
SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'evt-' || event_id END AS event_id,
       CASE WHEN event_type = 'purchase' THEN 'BatchDeleteTable' ELSE 'DeleteTable' END AS event_name,
       CASE WHEN event_type = 'error' THEN 's3.amazonaws.com' ELSE 'glue.amazonaws.com' END AS event_source,
       ts AS event_time, CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'user_' || (user_id % 5) END AS username,
       CASE WHEN user_id % 3 = 0 THEN 'us-east-1' WHEN user_id % 3 = 1 THEN 'us-west-2' END AS region,
       CASE WHEN event_id % 31 = 0 THEN 'not json' WHEN event_id % 37 = 0 THEN NULL
            WHEN event_id % 41 = 0 THEN '{"requestParameters":null}'
            WHEN event_id % 43 = 0 THEN '{"requestParameters":{}}'
            WHEN event_id % 47 = 0 THEN '[1, 2]'
            WHEN event_type = 'purchase' THEN '{"requestParameters":{"databaseName":"db_' || (event_id % 3)
              || '","tablesToDelete":["t_' || twin || '","tmp_' || (event_id % 7) || '",3,""]}}'
            WHEN event_id % 29 = 0 THEN '{"requestParameters":{"databaseName":"db_0","name":"hub"}}'
            WHEN event_id % 11 = 0 THEN '{"requestParameters":{"name":"t_' || twin || '"}}'
            ELSE '{"requestParameters":{"databaseName":"db_' || (event_id % 3) || '","name":"t_'
              || twin || '"}}' END AS cloud_trail_event
FROM (SELECT *, 2 * CAST(FLOOR(event_id / 10) AS BIGINT) AS twin FROM events) AS e
"""

# The earlier audit log: what was reported before the look-back of the current run began.
VIEWS["lk_seen"] = """
SELECT DISTINCT 'evt-' || event_id AS event_id FROM events WHERE ts < TIMESTAMP '2024-01-12 00:00:00'
"""

# Source files per job; one source holds a job with many files.
VIEWS["lk_files"] = """
SELECT CASE WHEN source = 'src0' THEN 'job_0' ELSE 'job_' || CAST(FLOOR(doc_id / 5) AS BIGINT) END AS job_id,
       CASE WHEN doc_id % 12 = 0 THEN 'tests/f_' WHEN doc_id % 12 = 1 THEN 'site-packages/f_'
            WHEN doc_id % 12 = 2 THEN 'lib/f_' WHEN doc_id % 12 = 3 THEN '.cache/f_'
            WHEN doc_id % 12 = 4 THEN 'app/test_' WHEN doc_id % 12 = 5 THEN 'app/lib/f_'
            WHEN doc_id % 12 = 6 THEN 'pkg.dist-info/f_' ELSE 'app/f_' END || doc_id
       || CASE WHEN doc_id % 5 = 0 THEN '.sql' WHEN doc_id % 5 = 1 THEN '.zip'
               WHEN doc_id % 5 = 2 THEN '_test.py' ELSE '.py' END AS path,
       text AS contents
FROM documents
"""

# Raw job inventory with script and extra files.
VIEWS["lk_glue_jobs"] = """
SELECT 'etl_' || o_orderkey AS name, 'job of ' || o_custkey AS description, 'role_' || (o_custkey % 7) AS role,
       o_orderdate AS last_modified_on, '4.0' AS glue_version, 'G.1X' AS worker_type,
       o_orderkey % 10 AS number_of_workers,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL
            ELSE '{"PythonVersion":"3","ScriptLocation":"s3://code/etl_' || o_orderkey || '.py"}' END AS command,
       CASE WHEN o_orderkey % 5 = 0 THEN '{"--extra-py-files":"s3://code/a.py, s3://code/lib.zip,,s3://code/etl_'
              || o_orderkey || '.py"}' WHEN o_orderkey % 5 = 1 THEN '{}'
            WHEN o_orderkey % 5 = 2 THEN '' WHEN o_orderkey % 35 = 3 THEN '{broken' END AS default_arguments
FROM orders WHERE o_orderpriority <> '1-URGENT'
"""

# Raw function inventory; some without arn, some image packages.
VIEWS["lk_functions"] = """
SELECT 'etl_' || o_orderkey AS name, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'arn:fn:' || o_orderkey END AS arn,
       'fn of ' || o_custkey AS description, 'role_' || (o_custkey % 7) AS role,
       'python3.' || (o_orderkey % 4 + 9) AS runtime, o_orderdate AS last_modified,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Image' ELSE 'Zip' END AS package_type,
       o_orderkey % 1000 AS code_size, '["x86_64"]' AS architectures
FROM orders WHERE o_orderpriority = '1-URGENT'
"""

# Cache keys of an earlier run, all out of date.
VIEWS["lk_cached"] = """
SELECT DISTINCT job_id, 'stale' AS cache_key FROM lk_files WHERE path LIKE '%.sql'
"""

# Extractor output, one edge per row; wrong direction, missing field and broken text included.
VIEWS["lk_extractions"] = """
SELECT job_id, CASE WHEN length(job_id || table_name) % 11 = 0 THEN '{"table_edges":['
            ELSE '{"table_edges":[{"database":' || coalesce('"' || database_name || '"', 'null') || ',"table":"' || table_name
              || '","direction":"' || CASE WHEN database_name = 'db_2' AND is_dynamic THEN 'scan' ELSE direction END
              || '",' || CASE WHEN database_name = 'db_1' AND is_dynamic THEN '' ELSE '"is_dynamic":' || CASE WHEN is_dynamic
                   THEN 'true' ELSE 'false' END || ',' END
              || '"evidence":"' || evidence || '"}]}' END AS extraction
FROM lk_edges
UNION ALL
SELECT job_id, '{"join_edges":[{"left_database":' || coalesce('"' || left_database || '"', 'null')
         || ',"left_table":"' || left_table || '","left_column":"' || left_column
         || '","right_database":' || coalesce('"' || right_database || '"', 'null')
         || ',"right_table":"' || right_table || '","right_column":"' || right_column
         || '","evidence":"' || evidence || '"}],"table_edges":[]}' AS extraction
FROM lk_join_edges
"""

# Tables somebody asks about: one per supplier, the first being the hub.
VIEWS["lk_watch"] = """
SELECT CASE WHEN s_suppkey % 13 = 7 THEN NULL ELSE 'db_' || (s_suppkey % 3) END AS database_name,
       CASE WHEN s_suppkey = 0 THEN 'hub' ELSE 't_' || (s_suppkey * 6) END AS table_name
FROM supplier
"""


def dependencies(sql: str, known: Collection[str] = ()) -> list[str]:
    """Views a statement names, dependencies first, without the known ones and what only they need."""
    found: list[str] = []
    for name in re.findall(r"\blk_\w+", sql):
        if name in VIEWS and name not in known:
            for inner in [*dependencies(VIEWS[name], known), name]:
                if inner not in found:
                    found.append(inner)
    return found


def with_views(sql: str, known: Collection[str] = ()) -> str:
    """A statement with the views it names as leading CTEs, for the check engine."""
    ctes = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in dependencies(sql, known))
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


_schemas: dict[str, StructType] = {}


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Scan of a driver table; its schema is read from the file once."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str, **written: DataFrame) -> DataFrame:
    """One of the views over the tables in ``sf_dir``; views that are ``written`` already are read, not made again."""
    sql = with_views(f"SELECT * FROM {name}", written)
    for other, rows in written.items():
        rows.createOrReplaceTempView(f"written_{other}")
        sql = re.sub(rf"\b{other}\b", f"written_{other}", sql)
    for table in BASE_TABLES:
        if re.search(rf"\b(FROM|JOIN)\s+{table}\b", sql):
            base(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(sql)
