"""The audit of a window of deletion events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit
from ..sources.scratch import cut
from .check_delete import dependents_reports


@dataclass(frozen=True)
class AuditRun:
    """Findings, their text rows, totals and the records for the log."""

    flagged: DataFrame
    findings: DataFrame
    lines: DataFrame
    totals: DataFrame
    records: DataFrame


def look_back(events: DataFrame, hours: int = 24, now: Column | None = None) -> DataFrame:
    """Deletion events of the last ``hours`` before ``now`` (the clock, by default)."""
    clock = F.current_timestamp() if now is None else now
    return audit.deletions_since(events, clock - F.make_dt_interval(hours=F.lit(hours)))


def findings(
    events: DataFrame, log: DataFrame, edges: DataFrame, join_edges: DataFrame,
    ignore_tables: str | None = None, show_all: bool = False, hours: int = 24, now: Column | None = None,
) -> DataFrame:
    """Flagged deletions of the look-back, ignored tables and (by default) seen events left out."""
    deletions = audit.kept(audit.parse_deletions(look_back(events, hours, now)), ignore_tables)
    fresh = deletions if show_all else audit.new_events(deletions, log)
    return audit.flagged_deletions(fresh, edges, join_edges)


def report_lines(
    flagged: DataFrame, totals: DataFrame, edges: DataFrame, join_edges: DataFrame,
    jobs: DataFrame, tables: DataFrame, hours: int,
) -> DataFrame:
    """Report text as rows ordered by (finding_rank, database_name, table_name, section, rank_a, rank_b).

    The first row is the headline. Findings are in order of their first event; ``finding_rank`` is
    their number in the order of (batch, time, event id, position).
    """
    grouped = cut(audit.group_findings(flagged))
    ranks = ranked_findings(grouped)
    empty = F.lit("")
    heads = audit.finding_lines(flagged).select(
        "database_name", "table_name", "section", F.lpad(F.col("part").cast("string"), 10, "0").alias("rank_a"),
        empty.alias("rank_b"), "line",
    )
    reports = dependents_reports(
        grouped.select("database_name", "table_name"), edges, join_edges, jobs, tables,
        ranks.withColumnRenamed("finding_rank", "mark"),
    )
    bodies = reports.lines.selectExpr(
        "mark AS finding_rank", "focus_database AS database_name", "focus_table AS table_name",
        "section + 10 AS section", "rank_a", "rank_b", "line",
    )
    gaps = grouped.selectExpr(
        "database_name", "table_name", "99 AS section", "'' AS rank_a", "'' AS rank_b", "'' AS line"
    )
    numbers = ranks.selectExpr("finding_rank", "database_name AS rank_database", "table_name AS rank_table")
    blocks = heads.unionByName(gaps)
    ranked = blocks.join(
        numbers, F.expr("table_name = rank_table AND nullif(database_name, '') <=> nullif(rank_database, '')")
    ).select("finding_rank", *blocks.columns)
    headline = totals.select(
        F.lit(-1).cast("bigint").alias("finding_rank"), F.lit(None).cast("string").alias("database_name"),
        F.lit("").alias("table_name"), F.lit(0).alias("section"), empty.alias("rank_a"),
        empty.alias("rank_b"),
        F.explode(
            F.array(
                F.format_string(
                    "audit: %d glue deletion(s) in the last %dh, %d table(s) deleted with dependents",
                    "deletions", F.lit(hours), "flagged_tables",
                ),
                empty,
            )
        ).alias("line"),
    )
    quiet = totals.where("flagged_tables = 0").selectExpr(
        "0L AS finding_rank", "CAST(NULL AS STRING) AS database_name", "'' AS table_name",
        "0 AS section", "'' AS rank_a", "'' AS rank_b", "'none had dependents' AS line",
    )
    ordered_head = headline.withColumn("rank_b", F.when(F.col("line") == "", "1").otherwise("0"))
    return ordered_head.unionByName(ranked).unionByName(bodies).unionByName(quiet)


def ranked_findings(grouped: DataFrame) -> DataFrame:
    """(database_name, table_name, finding_rank) of findings, numbered in order of their first event.

    The numbers come from sorted range partitions, so no single task numbers them, and are written
    out because a recomputed partition might number its rows differently.
    """
    first = F.concat_ws(
        "|",
        F.when(F.col("first_is_batch"), "1").otherwise("0"),
        F.date_format("first_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "first_event_id", F.lpad(F.col("first_position").cast("string"), 10, "0"),
    )
    order = ["first", "database_name", "table_name"]
    ordered = grouped.select(first.alias("first"), "database_name", "table_name").repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.select("database_name", "table_name", F.monotonically_increasing_id().alias("finding_rank")))


REPORT_ORDER = ("finding_rank", "database_name", "table_name", "section", "rank_a", "rank_b")


def audit_run(
    events: DataFrame, log: DataFrame, edges: DataFrame, join_edges: DataFrame,
    jobs: DataFrame, tables: DataFrame, hours: int = 24,
    ignore_tables: str | None = None, show_all: bool = False, now: Column | None = None,
) -> AuditRun:
    """The audit of the last ``hours`` before ``now`` (the clock, by default)."""
    window = look_back(events, hours, now)
    return audit_landed(window, log, cut(edges), cut(join_edges), jobs, tables, hours, ignore_tables, show_all)


def audit_landed(
    events: DataFrame, log: DataFrame, edges: DataFrame, join_edges: DataFrame,
    jobs: DataFrame, tables: DataFrame, hours: int = 24,
    ignore_tables: str | None = None, show_all: bool = False,
) -> AuditRun:
    """Parse, filter, flag, group and print all given events; records are for new events only.

    ``hours`` is what the headline says. Payloads are parsed and tables are tested once, and written out for all that the
    run does with them; edges are read several times, so they should be stored. Events are dealt out and written before they are
    parsed, which takes far longer than reading them; a filter on what is parsed would else move back to the scan.
    """
    dealt = cut(events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    split = cut(audit.split_ignored(audit.parse_deletions(dealt), ignore_tables))
    deletions = split.where("NOT ignored").drop("ignored")
    fresh = audit.new_events(deletions, log)
    reported = deletions if show_all else fresh
    flags = cut(audit.table_flags(deletions, edges, join_edges))
    flagged = cut(audit.flagged_deletions(reported, edges, join_edges, flags))
    nothing = log.where("false") if show_all else log
    totals = cut(audit.audit_totals(split, nothing, edges, join_edges, flags))
    return AuditRun(
        flagged=flagged,
        findings=audit.group_findings(flagged),
        lines=report_lines(flagged, totals, edges, join_edges, jobs, tables, hours),
        totals=totals,
        records=audit.audit_records(fresh, edges, join_edges, flags),
    )
