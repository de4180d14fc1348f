"""Reference SQL of the walks, unrolled hop by hop for the check engine.

These statements follow the definition directly, one row per (focus, node), so that they
share nothing with the bit-mask form they check.
"""

from __future__ import annotations

HOPS = 14


def foci(select: str) -> str:
    """CTE ``f`` (fid, fdb, ft) from a SELECT of database_name, table_name."""
    return f"""f AS MATERIALIZED (
  SELECT row_number() OVER () AS fid, database_name AS fdb, table_name AS ft
  FROM (SELECT DISTINCT nullif(database_name, '') AS database_name, table_name FROM ({select}) AS s0) AS s1)"""


def closure(select: str, hops: int = HOPS) -> str:
    """CTEs ``f``, ``cj`` (fid, hop, job_id) and ``ct`` (fid, hop, db, t)."""
    parts = [
        foci(select),
        "rd AS MATERIALIZED (SELECT DISTINCT job_id, database_name AS db, table_name AS t FROM lk_edges WHERE direction = 'read')",
        "wr AS MATERIALIZED (SELECT DISTINCT job_id, database_name AS db, table_name AS t FROM lk_edges WHERE direction = 'write')",
        "n_0 AS MATERIALIZED (SELECT fid, fdb AS db, ft AS t FROM f)",
        "p_0 AS MATERIALIZED (SELECT fid, 0 AS hop, fdb AS db, ft AS t FROM f)",
        "v_0 AS MATERIALIZED (SELECT CAST(NULL AS BIGINT) AS fid, 0 AS hop, '' AS job_id WHERE false)",
    ]
    wild = "({a}.db IS NULL OR {b}.db IS NULL OR {a}.db = {b}.db)"
    for h in range(1, hops + 1):
        parts += [
            f"""j_{h} AS MATERIALIZED (
  SELECT DISTINCT n.fid, r.job_id FROM n_{h - 1} AS n JOIN rd AS r ON r.t = n.t AND {wild.format(a='n', b='r')}
  WHERE NOT EXISTS (SELECT 1 FROM v_{h - 1} AS v WHERE v.fid = n.fid AND v.job_id = r.job_id))""",
            f"v_{h} AS MATERIALIZED (SELECT * FROM v_{h - 1} UNION ALL SELECT fid, {h} AS hop, job_id FROM j_{h})",
            f"c_{h} AS MATERIALIZED (SELECT DISTINCT j.fid, w.db, w.t FROM j_{h} AS j JOIN wr AS w ON w.job_id = j.job_id)",
            f"""n_{h} AS MATERIALIZED (
  SELECT fid, db, t FROM (
    SELECT c.fid, c.db, c.t, max(c.db) OVER (PARTITION BY c.fid, c.t) AS known FROM c_{h} AS c
    WHERE NOT EXISTS (SELECT 1 FROM p_{h - 1} AS p WHERE p.fid = c.fid AND p.t = c.t AND {wild.format(a='p', b='c')})) AS x
  WHERE db IS NOT NULL OR known IS NULL)""",
            f"p_{h} AS MATERIALIZED (SELECT * FROM p_{h - 1} UNION ALL SELECT fid, {h} AS hop, db, t FROM n_{h})",
        ]
    parts += [
        f"cj AS (SELECT fid, hop, job_id FROM v_{hops})",
        f"ct AS (SELECT fid, hop, db, t FROM p_{hops} WHERE hop > 0)",
    ]
    return ", ".join(parts)


# Join edges touching a focus on exactly one side: jr (fid, job_id, db, t, evidence).
JOIN_REFS = """jr AS (
  SELECT f.fid, e.job_id,
         CASE WHEN e.left_hit THEN e.right_database ELSE e.left_database END AS db,
         CASE WHEN e.left_hit THEN e.right_table ELSE e.left_table END AS t, e.evidence
  FROM (SELECT f.fid, j.*,
               j.left_table = f.ft AND (f.fdb IS NULL OR j.left_database IS NULL OR j.left_database = f.fdb) AS left_hit,
               j.right_table = f.ft AND (f.fdb IS NULL OR j.right_database IS NULL OR j.right_database = f.fdb) AS right_hit
        FROM f JOIN lk_join_edges AS j ON j.left_table = f.ft OR j.right_table = f.ft) AS e
  JOIN f ON f.fid = e.fid WHERE e.left_hit <> e.right_hit)"""

# Catalog names known in exactly one database: kd (name, db).
KNOWN = """kd AS (
  SELECT name, min(database_name) AS db FROM lk_tables GROUP BY name
  HAVING count(DISTINCT coalesce(database_name, '?null')) = 1)"""

LABELS = "lb AS (SELECT id, type || ': ' || name AS label FROM lk_jobs)"


def table_key(db: str, t: str) -> str:
    return f"CASE WHEN coalesce({db}, '') = '' THEN {t} ELSE {db} || '.' || {t} END"


def report_items() -> str:
    """CTE ``items`` over f, cj, ct, jr, kd, lb: every entry of every report."""
    resolved = "coalesce({a}.db, CASE WHEN {a}.t <> f.ft THEN kd.db END)"
    return f"""items AS MATERIALIZED (
  SELECT f.fid, f.fdb, f.ft, CASE WHEN hop = 1 THEN 'direct_jobs' ELSE 'transitive_jobs' END AS section, hop,
         cj.job_id, coalesce(lb.label, cj.job_id) AS label, NULL AS db, NULL AS t, NULL AS evidence
  FROM cj JOIN f ON f.fid = cj.fid LEFT JOIN lb ON lb.id = cj.job_id
  UNION ALL
  SELECT f.fid, f.fdb, f.ft, CASE WHEN hop = 1 THEN 'direct_tables' ELSE 'transitive_tables' END, hop,
         NULL, NULL, {resolved.format(a='ct')}, ct.t, NULL
  FROM ct JOIN f ON f.fid = ct.fid LEFT JOIN kd ON kd.name = ct.t
  UNION ALL
  SELECT f.fid, f.fdb, f.ft, 'join_refs', 1, jr.job_id, coalesce(lb.label, jr.job_id),
         {resolved.format(a='jr')}, jr.t, jr.evidence
  FROM jr JOIN f ON f.fid = jr.fid LEFT JOIN kd ON kd.name = jr.t LEFT JOIN lb ON lb.id = jr.job_id)"""


SUMMARY = """summary AS MATERIALIZED (
  SELECT f.fid, f.fdb, f.ft,
         EXISTS (SELECT 1 FROM lk_tables AS k WHERE k.name = f.ft AND k.database_name = f.fdb) AS in_catalog,
         count(i.section) FILTER (WHERE i.section IN ('direct_jobs', 'join_refs')) > 0 AS has_dependents,
         count(i.section) FILTER (WHERE i.section = 'direct_jobs') AS n_direct_jobs,
         count(i.section) FILTER (WHERE i.section = 'direct_tables') AS n_direct_tables,
         count(i.section) FILTER (WHERE i.section = 'join_refs') AS n_join_refs,
         count(i.section) FILTER (WHERE i.section = 'transitive_jobs') AS n_transitive_jobs,
         count(i.section) FILTER (WHERE i.section = 'transitive_tables') AS n_transitive_tables,
         count(DISTINCT i.job_id) AS jobs_broken,
         count(i.section) FILTER (WHERE i.section IN ('direct_tables', 'transitive_tables')) AS tables_orphaned
  FROM f LEFT JOIN items AS i ON i.fid = f.fid GROUP BY f.fid, f.fdb, f.ft)"""


def report_lines() -> str:
    """CTE ``lines`` (fdb, ft, section, line) over items and summary."""
    focus = table_key("fdb", "ft")
    key = table_key("db", "t")
    return f"""lines AS (
  SELECT fdb, ft, 0 AS section, {focus} || ' has no dependents' AS line FROM summary WHERE NOT has_dependents
  UNION ALL SELECT fdb, ft, 0, {focus} || ' has dependents:' FROM summary WHERE has_dependents
  UNION ALL SELECT fdb, ft, 1, '' FROM summary WHERE has_dependents
  UNION ALL SELECT fdb, ft, 2, '  jobs reading ' || {focus} || ' (' || n_direct_jobs || '):' FROM summary WHERE n_direct_jobs > 0
  UNION ALL SELECT fdb, ft, 3, '    - ' || label FROM items WHERE section = 'direct_jobs'
  UNION ALL SELECT fdb, ft, 4, '  tables written by those jobs (' || n_direct_tables || '):' FROM summary WHERE has_dependents AND n_direct_tables > 0
  UNION ALL SELECT fdb, ft, 5, '    - ' || {key} FROM items WHERE section = 'direct_tables'
  UNION ALL SELECT fdb, ft, 6, '  join references (' || count(DISTINCT label || ' ' || {key}) || '):' FROM items WHERE section = 'join_refs' GROUP BY fdb, ft
  UNION ALL SELECT DISTINCT fdb, ft, 7, '    - ' || label || ' joins ' || {focus} || ' <-> ' || {key} FROM items WHERE section = 'join_refs'
  UNION ALL SELECT fdb, ft, 8, '  transitive blast radius: ' || n_transitive_tables || ' more table(s), ' || n_transitive_jobs || ' more job(s)'
    FROM summary WHERE has_dependents AND n_transitive_tables + n_transitive_jobs > 0
  UNION ALL SELECT fdb, ft, 9, '    - ' || {key} FROM items WHERE section = 'transitive_tables'
  UNION ALL SELECT fdb, ft, 10, '' FROM summary WHERE has_dependents
  UNION ALL SELECT fdb, ft, 11, 'NOT SAFE: deleting ' || {focus} || ' breaks ' || jobs_broken || ' job(s) and orphans ' || tables_orphaned || ' table(s)'
    FROM summary WHERE has_dependents)"""


def reports(select: str) -> str:
    return ", ".join([closure(select), JOIN_REFS, KNOWN, LABELS, report_items(), SUMMARY, report_lines()])


def dag(select: str, depth: int = 2) -> str:
    """CTEs ``f``, ``dp`` (fid, layer, t) and ``dj`` (fid, job_id) of the lineage diagram."""
    parts = [
        foci(select),
        "ed AS MATERIALIZED (SELECT DISTINCT job_id, table_name AS t, direction FROM lk_edges)",
        "dp_0 AS (SELECT fid, 0 AS layer, ft AS t FROM f)",
        "dj_0 AS (SELECT CAST(NULL AS BIGINT) AS fid, '' AS job_id WHERE false)",
    ]
    step = 0
    for sign, inbound, outbound in ((1, "read", "write"), (-1, "write", "read")):
        for hop in range(1, depth + 1):
            step += 1
            layer = sign * (hop - 1)
            parts += [
                f"""dn_{step} AS MATERIALIZED (
  SELECT DISTINCT p.fid, e.job_id FROM dp_{step - 1} AS p JOIN ed AS e ON e.t = p.t AND e.direction = '{inbound}'
  WHERE p.layer = {layer} AND NOT EXISTS (SELECT 1 FROM dj_{step - 1} AS v WHERE v.fid = p.fid AND v.job_id = e.job_id))""",
                f"dj_{step} AS MATERIALIZED (SELECT * FROM dj_{step - 1} UNION ALL SELECT * FROM dn_{step})",
                f"""dp_{step} AS MATERIALIZED (SELECT * FROM dp_{step - 1} UNION ALL
  SELECT DISTINCT n.fid, {sign * hop} AS layer, e.t FROM dn_{step} AS n JOIN ed AS e ON e.job_id = n.job_id AND e.direction = '{outbound}'
  WHERE NOT EXISTS (SELECT 1 FROM dp_{step - 1} AS p WHERE p.fid = n.fid AND p.t = e.t))""",
            ]
    parts += [f"dp AS (SELECT * FROM dp_{step})", f"dj AS (SELECT * FROM dj_{step})"]
    # Edges of walked jobs on placed tables, and each placed table's database.
    parts += [
        """de AS MATERIALIZED (
  SELECT DISTINCT dj.fid, dj.job_id, e.table_name AS t, e.direction, e.database_name AS db
  FROM dj JOIN lk_edges AS e ON e.job_id = dj.job_id JOIN dp ON dp.fid = dj.fid AND dp.t = e.table_name)""",
        """dd AS MATERIALIZED (
  SELECT dp.fid, dp.layer, dp.t, CASE WHEN dp.t = f.ft THEN f.fdb ELSE coalesce(x.db, k.db) END AS db
  FROM dp JOIN f ON f.fid = dp.fid
  LEFT JOIN (SELECT fid, t, min(nullif(db, '')) AS db FROM de GROUP BY fid, t) AS x ON x.fid = dp.fid AND x.t = dp.t
  LEFT JOIN (SELECT name, min(database_name) AS db FROM lk_tables GROUP BY name) AS k ON k.name = dp.t)""",
    ]
    return ", ".join(parts)


def erd(select: str) -> str:
    """CTEs ``f``, ``fe`` (focus edges), ``ends`` and ``cards`` of the join diagram."""
    return ", ".join([
        foci(select),
        """fe AS MATERIALIZED (SELECT f.fid, f.fdb, f.ft, j.* FROM f JOIN lk_join_edges AS j ON j.left_table = f.ft OR j.right_table = f.ft)""",
        """ends AS MATERIALIZED (
  SELECT fid, left_table AS t, left_database AS db, left_column AS c FROM fe
  UNION ALL SELECT fid, right_table, right_database, right_column FROM fe)""",
        """cards AS MATERIALIZED (
  SELECT f.fid, f.fdb, f.ft, x.t, CASE WHEN x.t = f.ft THEN f.fdb ELSE coalesce(x.edge_db, k.db) END AS db,
         CASE WHEN x.t = f.ft THEN f.fdb ELSE k.db END AS cat_db
  FROM (SELECT fid, t, min(nullif(db, '')) AS edge_db FROM ends GROUP BY fid, t
        UNION ALL SELECT fid, ft, NULL FROM f WHERE NOT EXISTS (SELECT 1 FROM ends AS e WHERE e.fid = f.fid AND e.t = f.ft)) AS x
  JOIN f ON f.fid = x.fid
  LEFT JOIN (SELECT name, min(database_name) AS db FROM lk_tables GROUP BY name) AS k ON k.name = x.t)""",
        """parts AS MATERIALIZED (
  SELECT c.fid, c.t, json_extract_string(pk.entry, '$.Name') AS column_name, pk.pos - 1 AS position
  FROM cards AS c JOIN (
    SELECT database_name, name, unnest(json_extract(partition_keys, '$[*]')) AS entry,
           generate_subscripts(json_extract(partition_keys, '$[*]'), 1) AS pos
    FROM lk_tables WHERE partition_keys IS NOT NULL) AS pk ON pk.name = c.t AND pk.database_name = c.cat_db)""",
        """cols AS MATERIALIZED (
  SELECT DISTINCT e.fid, e.t, e.c AS column_name FROM ends AS e
  WHERE NOT EXISTS (SELECT 1 FROM parts AS p WHERE p.fid = e.fid AND p.t = e.t AND p.column_name = e.c))""",
    ])
