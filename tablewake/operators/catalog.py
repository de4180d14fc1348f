"""Lookups and derived tables over the catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import (
    COLUMN_LIST,
    column_list,
    descriptor,
    descriptor_columns,
    named,
)
from ..sources.scratch import cut
from .spread import listed_text


def sorted_by(df: DataFrame, *columns: str) -> DataFrame:
    """A listing in order: a range-partitioned sort, not a single task."""
    return df.orderBy(*columns)


def list_databases(databases: DataFrame) -> DataFrame:
    return sorted_by(databases, "name")


def list_tables(tables: DataFrame) -> DataFrame:
    return sorted_by(tables, "name")


def tables_of_database(tables: DataFrame, database: str) -> DataFrame:
    return sorted_by(tables.where(F.col("database_name") == database), "name")


def get_table(tables: DataFrame, database: str, table: str) -> DataFrame:
    """At most one row: (database_name, name) is unique in the catalog."""
    return tables.where((F.col("database_name") == database) & (F.col("name") == table)).limit(1)


def tables_by_names(tables: DataFrame, names: DataFrame) -> DataFrame:
    """Catalog rows whose name is in ``names`` (one column, ``name``)."""
    return sorted_by(tables.join(names, "name", "left_semi"), "name")


def list_jobs(jobs: DataFrame) -> DataFrame:
    return sorted_by(jobs, "type", "name")


def jobs_by_ids(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids, "id", "left_semi")


def list_artifacts(artifacts: DataFrame) -> DataFrame:
    return sorted_by(artifacts, "reference")


def list_extractions(extractions: DataFrame) -> DataFrame:
    return sorted_by(extractions, "job_id")


def cache_keys(extractions: DataFrame) -> DataFrame:
    return extractions.select("job_id", "cache_key")


def list_edges(edges: DataFrame) -> DataFrame:
    return sorted_by(edges, "job_id", "table_name")


def edges_by_tables(edges: DataFrame, names: DataFrame) -> DataFrame:
    return edges.join(names, "table_name", "left_semi")


def edges_by_jobs(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids, "job_id", "left_semi")


def list_join_edges(join_edges: DataFrame) -> DataFrame:
    return sorted_by(join_edges, "left_table", "right_table")


def join_edges_of_tables(join_edges: DataFrame, names: DataFrame) -> DataFrame:
    """(focus_table, edge columns) for join edges naming the table on either side.

    The edges are read once, with a row for each name they have.
    """
    focus = names.select(F.col("table_name").alias("focus_table")).distinct()
    named = join_edges.withColumn("focus_table", F.explode(F.array_distinct(F.array("left_table", "right_table"))))
    return focus.join(named, "focus_table").select("focus_table", *join_edges.columns)


def first_function(functions: DataFrame, name: str) -> DataFrame:
    return functions.where(F.col("name") == name).limit(1)


def tables_by_database(databases: DataFrame, tables: DataFrame) -> DataFrame:
    """Databases with their tables: (database_name, part, tables); empty databases are kept.

    Databases that only tables mention are appended.
    """
    names = listed_text(
        tables.selectExpr("database_name", "name AS table_name"),
        ["database_name"], "table_name", "tables",
    )
    known = databases.selectExpr("name AS known_name").distinct()
    joined = known.join(names, F.expr("known_name <=> database_name"), "full")
    return joined.selectExpr(
        "coalesce(known_name, database_name) AS database_name",
        "coalesce(part, 0) AS part",
        "coalesce(tables, '') AS tables",
    )


def table_columns(tables: DataFrame) -> DataFrame:
    """Every column and partition key of every table, in position order per kind."""
    columns = descriptor_columns(F.col("storage_descriptor"))
    parsed = tables.select(
        "database_name", "name", descriptor(F.col("storage_descriptor"))["Location"].alias("location"),
        columns.alias("columns"), column_list(F.col("partition_keys")).alias("keys"),
    )

    def rows(source: str, is_partition: bool) -> DataFrame:
        return parsed.select(
            "database_name", "name", "location", F.lit(is_partition).alias("is_partition"),
            F.posexplode(source).alias("position", "entry"),
        ).selectExpr(
            "database_name", "name AS table_name", "entry.Name AS column_name",
            "entry.Type AS column_type", "entry.Comment AS comment", "is_partition",
            "position", "location",
        )

    return rows("columns", False).unionByName(rows("keys", True))


def partition_columns(tables: DataFrame) -> DataFrame:
    """(database_name, table_name, position, column_name) of non-empty partition keys."""
    return tables.select(
        "database_name", F.col("name").alias("table_name"),
        F.posexplode(named(column_list(F.col("partition_keys")))).alias("position", "entry"),
    ).selectExpr("database_name", "table_name", "position", "entry.Name AS column_name")


def search_columns(tables: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Tables with a column or partition key containing ``query``, ignoring case.

    The first ``limit`` tables in name order, each with its distinct matches sorted. The
    match stays inside the row of a table; the limit is a top-k, not a sort of everything.
    """
    needle = query.strip().lower()
    if not needle:
        tables, needle = tables.where("false"), " "
    entries = F.concat(
        descriptor_columns(F.col("storage_descriptor")),
        column_list(F.col("partition_keys")),
    )
    matches = F.array_sort(
        F.array_distinct(
            F.filter(
                F.transform(named(entries.cast(COLUMN_LIST)), lambda c: c["Name"]),
                lambda n: F.lower(n).contains(needle),
            )
        )
    )
    found = tables.select(
        "database_name", F.col("name").alias("table_name"), matches.alias("matches")
    ).where("size(matches) > 0")
    return (
        found.orderBy("table_name", "database_name")
        .limit(limit)
        .selectExpr("database_name", "table_name", "array_join(matches, ', ') AS matches")
    )


def table_readers_writers(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """Labels of the jobs that read or write each table name: (table_name, direction, part, labels).

    By name only, whatever the database; jobs without a row are left out.
    """
    labels = jobs.selectExpr("id AS job_id", "concat(type, ': ', name) AS label")
    pairs = edges.select("table_name", "direction", "job_id").distinct().join(labels, "job_id")
    return listed_text(pairs, ["table_name", "direction"], "label", "labels")


# Columns of the catalog that must not be null.
NOT_NULL = {
    "tables": ("database_name", "name"),
    "jobs": ("type", "name"),
    "edges": ("job_id", "table_name", "direction", "is_dynamic", "evidence"),
    "extractions": ("job_id", "cache_key", "model", "prompt_version", "extraction"),
}


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) for keys that occur more than once; rows with a null key are never equal."""
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parents(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct values of a foreign key that the parent does not have."""
    values = child.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return values.join(parent.select(F.col(key).alias("value")), "value", "left_anti")


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n) of columns that must not be null but are."""
    counts = ", ".join(f"'{c}', count_if({c} IS NULL)" for c in columns)
    return (
        df.agg(F.expr(f"map({counts}) AS counts"))
        .selectExpr("explode(counts) AS (column_name, n)")
        .where("n > 0")
    )


def key_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of each key as ``n_rows`` and nulls of each column as ``no_<column>``, written once: (keys, n_rows, no_...)."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns]
    return cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *nulls))


def repeated(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Like :func:`unique_violations`, from key counts."""
    present = reduce(Column.__and__, [F.col(key).isNotNull() for key in keys])
    return counted.where(present & (F.col("n_rows") > 1)).select(*keys, F.col("n_rows").alias("n"))


def null_totals(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Like :func:`null_violations`, from key counts."""
    totals = ", ".join(f"'{c}', sum(no_{c})" for c in columns)
    return (
        counted.agg(F.expr(f"map({totals}) AS counts"))
        .selectExpr("explode(counts) AS (column_name, n)")
        .where("n > 0")
    )


def check_constraints(
    databases: DataFrame,
    tables: DataFrame,
    jobs: DataFrame,
    edges: DataFrame,
    events: DataFrame,
    extractions: DataFrame,
    join_edges: DataFrame | None = None,
    artifacts: DataFrame | None = None,
    log: DataFrame | None = None,
) -> DataFrame:
    """Violations of the catalog's keys and not-null columns: (constraint_name, subject, n).

    Tables that are not given, and columns that a table does not have, are not checked.
    """
    def named_rows(df: DataFrame, name: str, subject: str, n: str = "1L") -> DataFrame:
        return df.selectExpr(f"'{name}' AS constraint_name", f"{subject} AS subject", f"{n} AS n")

    def nulls(name: str, counted: DataFrame, columns: Sequence[str]) -> DataFrame:
        return named_rows(null_totals(counted, columns), f"{name}.not_null", "column_name", "n")

    checks = [
        named_rows(unique_violations(databases, ["name"]), "databases.unique", "name", "n"),
        named_rows(
            null_violations(events, ["event_id", "event_name"]), "events.not_null", "column_name", "n"
        ),
    ]
    # Each of the other tables is read once: what its checks ask for is counted by key.
    required = {
        name: [c for c in NOT_NULL[name] if c in rows.columns]
        for name, rows in (("tables", tables), ("jobs", jobs), ("edges", edges), ("extractions", extractions))
    }
    own = key_counts(tables, ["database_name", "name"], required["tables"])
    twice = repeated(own, ["database_name", "name"])
    checks.append(named_rows(twice, "tables.unique", "concat(database_name, '.', name)", "n"))
    checks.append(named_rows(missing_parents(own, "database_name", databases, "name"), "tables.database", "value"))
    checks.append(nulls("tables", own, required["tables"]))
    own = key_counts(jobs, ["type", "name"], required["jobs"])
    checks.append(named_rows(repeated(own, ["type", "name"]), "jobs.unique", "concat(type, ': ', name)", "n"))
    checks.append(nulls("jobs", own, required["jobs"]))
    own = key_counts(edges, ["job_id"], required["edges"])
    children = {"edges.job": own}
    checks.append(nulls("edges", own, required["edges"]))
    own = key_counts(extractions, ["job_id"], required["extractions"])
    children["extractions.job"] = own
    checks.append(named_rows(repeated(own, ["job_id"]), "extractions.unique", "job_id", "n"))
    checks.append(nulls("extractions", own, required["extractions"]))
    if join_edges is not None:
        sides = [f"{side}_{part}" for side in ("left", "right") for part in ("table", "column")]
        columns = ["job_id", *sides, "evidence"]
        children["joins.job"] = own = key_counts(join_edges, ["job_id"], columns)
        checks.append(nulls("joins", own, columns))
    if artifacts is not None:
        columns = ["job_id", "reference"]
        children["artifacts.job"] = own = key_counts(artifacts, columns, columns)
        checks.append(named_rows(repeated(own, columns), "artifacts.unique", "concat(job_id, ': ', reference)", "n"))
        checks.append(nulls("artifacts", own, columns))
    # All ids that should be a job's are looked up in the jobs together.
    ids = [own.select(F.lit(name).alias("constraint_name"), F.col("job_id").alias("subject")) for name, own in children.items()]
    lost = reduce(DataFrame.unionByName, ids).where("subject IS NOT NULL").distinct()
    lost = lost.join(jobs.select(F.col("id").alias("subject")), "subject", "left_anti")
    checks.append(lost.selectExpr("constraint_name", "subject", "1L AS n"))
    if log is not None:
        twice = unique_violations(log, ["event_id", "table_name"])
        checks.append(named_rows(twice, "log.unique", "concat(event_id, ': ', table_name)", "n"))
    return reduce(DataFrame.unionByName, checks)
