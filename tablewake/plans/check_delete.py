"""Dependents reports for tables that somebody wants to delete."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import known_database
from ..operators import dependents as dep
from ..operators.closure import walk
from ..sources.scratch import cut


@dataclass(frozen=True)
class Reports:
    """Entries, per-focus summary and text rows of the reports of many tables."""

    items: DataFrame
    summary: DataFrame
    lines: DataFrame
    layers: DataFrame


def dependents_reports(
    foci: DataFrame, edges: DataFrame, join_edges: DataFrame, jobs: DataFrame, tables: DataFrame,
    marks: DataFrame | None = None,
) -> Reports:
    """One walk for all foci; job masks and references are written once and then summarised and printed.

    ``marks`` (database_name, table_name, mark): the lines of a focus come once for each of its marks and bear it.
    """
    result = walk(edges, foci)
    numbered = result.foci if marks is None else _marked(result.foci, marks)
    entries = dep.report_entries(result, join_edges, jobs, tables, numbered)
    # Evidence is in the entries but not in the text.
    printed = replace(entries, refs=cut(entries.refs.drop("evidence")))
    masks = cut(dep.report_jobs(printed))
    summary = cut(dep.report_summary(printed, masks, tables))
    labels, references = cut(dep.direct_labels(printed, masks)), cut(dep.reference_lines(printed))
    lines = dep.report_lines(printed, summary, labels, references)
    if marks is not None:
        lines = lines.withColumn("mark", F.explode("marks")).drop("marks")
    return Reports(dep.entry_items(entries), summary.drop("focus"), lines, dep.lineage_layers(result, tables))


def _marked(foci: DataFrame, marks: DataFrame) -> DataFrame:
    """Numbered foci with ``marks``, the list of their marks."""
    listed = marks.groupBy(
        known_database(F.col("database_name")).alias("mark_database"), F.col("table_name").alias("mark_table")
    ).agg(F.collect_list("mark").alias("marks"))
    joined = foci.join(listed, F.expr("table_name = mark_table AND database_name <=> mark_database"))
    return cut(joined.select(*foci.columns, "marks"))
