"""Deletions in the audit trail and what they broke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import decoded, is_json_object, is_json_string
from ..functions.names import known_database, table_key
from ..functions.paths import is_ignored_table
from .dependents import with_dependents_flag
from .spread import listed

# The event source and names of table deletions.
EVENT_SOURCE = "glue.amazonaws.com"
DELETE_TABLE = "DeleteTable"
BATCH_DELETE_TABLE = "BatchDeleteTable"

DELETION = (
    "event_id", "database_name", "table_name", "event_name", "event_time", "username",
    "region", "position",
)


def since(events: DataFrame, event_name: str, start: Column) -> DataFrame:
    """Events of one name from ``start`` on, inclusive; both conditions reach the scan."""
    return events.where((F.col("event_name") == event_name) & (F.col("event_time") >= start))


def deletion_events(events: DataFrame) -> DataFrame:
    """Single deletions and batch deletions; the condition reaches the scan."""
    return events.where(F.col("event_name").isin(DELETE_TABLE, BATCH_DELETE_TABLE))


def deletions_since(events: DataFrame, start: Column) -> DataFrame:
    """Single deletions and batch deletions in the look-back window."""
    return deletion_events(events).where(F.col("event_time") >= start)


def request_parameters(payload: Column) -> Column:
    """The ``requestParameters`` object of an event payload, null when unusable."""
    value = F.try_variant_get(decoded(payload), "$.requestParameters", "variant")
    return F.when(is_json_object(value), value)


def _with_parameters(events: DataFrame) -> DataFrame:
    relevant = events.where(F.col("event_source") == EVENT_SOURCE)
    return relevant.withColumn("parameters", request_parameters(F.col("cloud_trail_event")))


def _deleted_tables() -> Column:
    """Named tables of an event as strings; entries that are no strings or empty are dropped.

    Only ``DeleteTable`` names a single table; every other event name carries a list.
    """
    single = F.array(F.try_variant_get(F.col("parameters"), "$.name", "variant"))
    many = F.try_variant_get(F.col("parameters"), "$.tablesToDelete", "array<variant>")
    named = F.when(F.coalesce(F.col("event_name"), F.lit("")) == DELETE_TABLE, single).otherwise(many)
    texts = F.transform(named, lambda v: F.when(is_json_string(v), v.cast("string")))
    return F.coalesce(
        F.filter(texts, lambda t: F.coalesce(t != "", F.lit(False))),
        F.array().cast("array<string>"),
    )


def _usable() -> Column:
    return F.col("parameters").isNotNull() & F.coalesce(F.col("event_id") != "", F.lit(False))


def parse_deletions(events: DataFrame) -> DataFrame:
    """One row per deleted table; a batch event gives several rows with one event id."""
    rows = _with_parameters(events).where(_usable())
    return rows.select(
        "event_id",
        F.try_variant_get("parameters", "$.databaseName", "string").alias("database_name"),
        F.coalesce("event_name", F.lit("")).alias("event_name"), "event_time", "username", "region",
        F.posexplode(_deleted_tables()).alias("position", "table_name"),
    ).select(*DELETION)


def malformed_events(events: DataFrame) -> DataFrame:
    """Events of the right source that give no deletion, with the reason."""
    rows = _with_parameters(events).withColumn(
        "reason",
        F.when(~_usable(), "malformed").when(F.size(_deleted_tables()) == 0, "no tables"),
    )
    return rows.where("reason IS NOT NULL").select("event_id", "event_name", "event_time", "reason")


def split_ignored(deletions: DataFrame, pattern: str | None) -> DataFrame:
    """Flag deletions whose bare or qualified table name matches the pattern."""
    return deletions.withColumn(
        "ignored", is_ignored_table(F.col("database_name"), F.col("table_name"), pattern)
    )


def kept(deletions: DataFrame, pattern: str | None) -> DataFrame:
    return split_ignored(deletions, pattern).where("NOT ignored").drop("ignored")


def new_events(deletions: DataFrame, log: DataFrame) -> DataFrame:
    """Deletions whose event id the audit log does not have."""
    return deletions.join(log.select("event_id").distinct(), "event_id", "left_anti")


def table_flags(deletions: DataFrame, edges: DataFrame, join_edges: DataFrame) -> DataFrame:
    """Each distinct deleted table with ``has_dependents``."""
    tables = deletions.select("database_name", "table_name").distinct()
    return with_dependents_flag(tables, edges, join_edges)


def flag_deletions(
    deletions: DataFrame, edges: DataFrame, join_edges: DataFrame, flags: DataFrame | None = None
) -> DataFrame:
    """Add ``flagged``: the deleted table had dependents. Each distinct table is tested once.

    ``flags`` are those of :func:`table_flags` for these deletions or more, where a run needs them several times.
    """
    flags = table_flags(deletions, edges, join_edges) if flags is None else flags
    keyed = deletions.withColumn("known_database", known_database(F.col("database_name")))
    joined = keyed.join(
        flags.selectExpr("database_name AS flag_database", "table_name AS flag_table", "has_dependents"),
        F.expr("table_name = flag_table AND known_database <=> flag_database"),
        "left",
    )
    return joined.select(*deletions.columns, F.col("has_dependents").alias("flagged"))


def flagged_deletions(
    deletions: DataFrame, edges: DataFrame, join_edges: DataFrame, flags: DataFrame | None = None
) -> DataFrame:
    return flag_deletions(deletions, edges, join_edges, flags).where("flagged").drop("flagged")


def arrival() -> Column:
    """Order of deletions: single ones, then batches, by time, event id and list position."""
    return F.struct(
        (F.col("event_name") != DELETE_TABLE).alias("batch"), "event_time", "event_id", "position"
    )


def group_findings(flagged: DataFrame) -> DataFrame:
    """One row per deleted table with its number of events and its first event.

    The events themselves stay rows of ``flagged``; tables are in order of ``first_seen``.
    """
    return flagged.groupBy("database_name", "table_name").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(arrival()).alias("first_seen"),
    ).select(
        "database_name", "table_name", "n_events",
        F.col("first_seen.batch").alias("first_is_batch"),
        F.col("first_seen.event_time").alias("first_time"),
        F.col("first_seen.event_id").alias("first_event_id"),
        F.col("first_seen.position").alias("first_position"),
    )


def deletion_actors(flagged: DataFrame) -> DataFrame:
    """Deletions per table, event name and principal, with each actor's first event."""
    actor = F.coalesce(F.nullif("username", F.lit("")), F.lit("unknown"))
    return flagged.groupBy(
        "database_name", "table_name", "event_name", actor.alias("actor")
    ).agg(F.count(F.lit(1)).alias("n"), F.min(arrival()).alias("first_seen"))


def deletion_span(flagged: DataFrame) -> DataFrame:
    """First and last time and the sorted regions per deleted table.

    Regions are names of data centres: a set of them is small however many deletions a table has.
    """
    regions = F.array_join(F.array_sort(F.collect_set(F.nullif("region", F.lit("")))), ", ")
    return flagged.groupBy("database_name", "table_name").agg(
        F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"), regions.alias("regions")
    )


def audit_totals(
    split: DataFrame, log: DataFrame, edges: DataFrame, join_edges: DataFrame, flags: DataFrame | None = None
) -> DataFrame:
    """Run totals in one row: deletions considered, flagged tables, ignored deletions and tables."""
    considered = new_events(split.where("NOT ignored").drop("ignored"), log)
    columns = ["database_name", "table_name", "ignored", "flagged"]
    rows = (
        flag_deletions(considered, edges, join_edges, flags)
        .withColumn("ignored", F.lit(False))
        .select(*columns)
        .unionByName(split.where("ignored").withColumn("flagged", F.lit(False)).select(*columns))
    )
    tables = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    zero = "CAST(0 AS BIGINT)"
    return tables.agg(
        F.expr(f"coalesce(sum(if(ignored, 0L, n)), {zero}) AS deletions"),
        F.expr("count_if(flagged) AS flagged_tables"),
        F.expr(f"coalesce(sum(if(ignored, n, 0L)), {zero}) AS ignored_deletions"),
        F.expr("count_if(ignored) AS ignored_tables"),
    )


def last_per_key(records: DataFrame) -> DataFrame:
    """One record per (event_id, table_name), the last one by arrival."""
    fields = [c for c in records.columns if c not in ("event_id", "table_name")]
    latest = F.max_by(F.struct(*fields), arrival())
    return records.groupBy("event_id", "table_name").agg(latest.alias("r")).select(
        "event_id", "table_name", *[F.col(f"r.{f}").alias(f) for f in fields]
    )


def audit_records(
    deletions: DataFrame, edges: DataFrame, join_edges: DataFrame, flags: DataFrame | None = None
) -> DataFrame:
    """Records for the log. ``flagged`` is decided per (event id, table), any database."""
    flagged = flag_deletions(deletions, edges, join_edges, flags)
    fields = ("database_name", "event_name", "event_time", "username", "region")
    latest = F.max_by(F.struct(*fields), arrival())
    return flagged.groupBy("event_id", "table_name").agg(latest.alias("r"), F.max("flagged").alias("flagged")).selectExpr(
        "event_id", "r.database_name", "table_name", "r.event_name", "r.event_time", "r.username", "r.region", "flagged"
    )


def finding_lines(flagged: DataFrame, time_format: str = "yyyy-MM-dd'T'HH:mm:ss") -> DataFrame:
    """Head lines of each finding: (database_name, table_name, section, part, line).

    Actors are in order of their first event; each page of them (``part``) has a line.
    """
    keys = ["database_name", "table_name"]
    actors = deletion_actors(flagged).withColumn(
        "entry",
        F.struct(
            "first_seen",
            F.format_string("%s by %s (%d)", "event_name", "actor", "n").alias("text"),
        ),
    )
    texts = listed(actors, keys, "entry").selectExpr(
        *keys, "part", "array_join(transform(items, i -> i.text), ', ') AS actors"
    )
    totals = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"))
    counted = texts.join(
        totals.selectExpr("database_name AS d", "table_name AS t", "n_events"),
        F.expr("table_name = t AND database_name <=> d"),
    )
    name = table_key(F.col("database_name"), F.col("table_name"))
    title = totals.select(*keys, F.lit(0).alias("section"), F.lit(0).alias("part"), F.concat(F.lit("DELETED WITH DEPENDENTS: "), name).alias("line"))
    actor_lines = counted.select(
        *keys, F.lit(1).alias("section"), "part",
        F.format_string("  %d deletion(s): %s", "n_events", "actors").alias("line"),
    )
    spans = deletion_span(flagged).where("first_time IS NOT NULL").select(
        *keys, "regions",
        F.date_format("first_time", time_format).alias("first"),
        F.date_format("last_time", time_format).alias("last"),
    )
    span_lines = spans.selectExpr(
        *keys, "2 AS section", "0 AS part",
        """concat('  when: ', if(first = last, first, concat(first, ' to ', last)),
                  if(regions <> '', concat(' (', regions, ')'), '')) AS line""",
    )
    blank = totals.select(*keys, F.lit(3).alias("section"), F.lit(0).alias("part"), F.lit("").alias("line"))
    return title.unionByName(actor_lines).unionByName(span_lines).unionByName(blank)
